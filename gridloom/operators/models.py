"""The life of a model: fitting, saving, loading, scoring in batches with error rows, cross-validation, importances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORED = "predicted int, confidence double, error string"


def classifier(kind: str, **params):
    """An estimator over columns features and code, by name: logistic (1000 rounds), forest (200 trees), network."""
    common = {"featuresCol": "scaled", "labelCol": "code"}
    if kind == "logistic":
        return LogisticRegression(**({"maxIter": 1000} | common | params))
    if kind == "forest":
        return RandomForestClassifier(**({"numTrees": 200, "seed": 42} | common | params))
    if kind == "network":
        return MultilayerPerceptronClassifier(**({"seed": 42} | common | params))
    raise ValueError(f"no classifier is called {kind}")


def pipeline(kind: str, classes: list[str], **params) -> Pipeline:
    """Labels to codes in order, features to unit variance, a classifier, codes back to labels."""
    codes = StringIndexer(inputCol="label", outputCol="code", stringOrderType="alphabetAsc", handleInvalid="keep")
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[codes, scaled, classifier(kind, **params), IndexToString(inputCol="prediction", outputCol="predicted", labels=sorted(classes))])


def with_features(df: DataFrame, px: str = "px") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(px).cast("array<double>")))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scored(df: DataFrame, model: PipelineModel) -> DataFrame:
    """df with predicted, a label."""
    return model.transform(df).drop("code", "scaled", "rawPrediction", "probability", "prediction")


def cross_validated(df: DataFrame, estimator, folds: str, n: int, label: str = "code") -> float:
    """Mean accuracy over the folds that the column ``folds`` (0 to n - 1) says."""
    judge = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
    return CrossValidator(estimator=estimator, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=n, foldCol=folds).fit(df).avgMetrics[0]


def importances(model, names: list[str]) -> DataFrame:
    """(feature, weight) of a fitted forest (its importances) or linear model (the greatest |coefficient|), greatest first."""
    from pyspark.sql import SparkSession

    weights = model.featureImportances.toArray() if hasattr(model, "featureImportances") else np.abs(model.coefficientMatrix.toArray()).max(0)
    rows = SparkSession.getActiveSession().createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, weight double")
    return rows.orderBy(F.desc("weight"), "feature")


def forward(layers: list, x: np.ndarray) -> np.ndarray:
    """A network's output: (weights, biases, kind) in turn, kind being relu, softmax, sigmoid or none."""
    for w, b, kind in layers:
        x = x @ w + b
        if kind == "relu":
            x = np.maximum(x, 0)
        elif kind == "sigmoid":
            x = 1 / (1 + np.exp(-x))
        elif kind == "softmax":
            x = np.exp(x - x.max(1, keepdims=True))
            x /= x.sum(1, keepdims=True)
    return x


def scored_batches(df: DataFrame, layers: list, px: str, width: int, batch: int = 1024) -> DataFrame:
    """df without px, with predicted (the first greatest output), confidence and error, by a network whose layers go out with
    the tasks. Rasters are scored ``batch`` at a time; one that is null, of another size or not finite gives an error row
    with confidence 0 and no class, not a failed job."""
    names = [c for c in df.columns if c != px]
    schema = ", ".join([*(f"{c} {k}" for c, k in df.dtypes if c != px), SCORED])

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                values = part.column(part.schema.names.index(px)).to_pylist()
                wrong = ["no raster" if v is None else f"{len(v)} values" if len(v) != width else "not finite" if not all(x is not None and np.isfinite(x) for x in v) else None for v in values]
                good = [i for i, e in enumerate(wrong) if e is None]
                label, sure = np.zeros(len(values), object), np.zeros(len(values))
                label[:] = None
                if good:
                    out = forward(layers, np.array([values[i] for i in good], float))
                    label[good], sure[good] = out.argmax(1), out.max(1)
                arrays = [*(part.column(part.schema.names.index(n)) for n in names), pa.array(label.tolist(), pa.int32()), pa.array(sure), pa.array(wrong, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "predicted", "confidence", "error"])

    return df.mapInArrow(run, schema)


def decoded(code: Column, classes: DataFrame) -> Column:
    """The class of a code, from (class, id) rows that are few."""
    pairs = {int(r["id"]): r["class"] for r in classes.collect()}
    return F.element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), code) if pairs else F.lit(None).cast("string")
