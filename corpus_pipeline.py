"""A training-data pipeline over the documents table, in stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs, while the table before it is deleted. All but the last return the columns
of documents. All stages: whole texts of any length; an empty table gives an empty one; extra columns, whatever their
names, are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.llm.common import delete_table, materialize, sheltered, table
from gridloom.llm.mixing import mixed_documents
from gridloom.llm.pieces import encode
from gridloom.llm.quality_rules import STAGE_RATIOS, keep_quality
from gridloom.llm.queries import MODEL_FILE
from gridloom.llm.recompression import dedup_substrings
from gridloom.llm.simhash import drop_near_duplicates


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go.

    A null or empty text has no words and goes; a null lang or source is a group of its own; null ids are judged as all
    others; rows that are equal get the same verdict, so a repeated row stays as often as it came or not at all; of
    ratios that tie with a group's fence none is rejected."""
    return keep_quality(docs, STAGE_RATIOS)


def near_dedup(spark, docs, sf_dir):
    """One document of each SimHash component stays: that of the least doc_id.

    Null and empty texts have one fingerprint and are near each other; a null id is larger than all others; of rows that
    share the least id, and of repeated rows, one stays: that of the least fingerprint, then text."""
    return drop_near_duplicates(docs)


def substring_dedup(spark, docs, sf_dir):
    """Repeated windows of words go; a text that loses none stays as it is.

    The earliest of equal windows stays, by doc_id (null last), then start; rows that repeat a doc_id are one document's
    texts, so repeated rows lose nothing to each other. A null text stays null, a text that loses all is empty, and no
    row goes. n_chars, where it is, counts a text that was cut anew."""
    away, back = sheltered(docs, ("kept_text", "n_words", "n_removed"))
    cut = F.col("n_removed") > 0
    out = dedup_substrings(away).withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return back(out)


def mix(spark, docs, sf_dir):
    """Sources at their target weights, documents repeated or cut as the mix takes them.

    Null and empty texts have no words, so the mix takes none of them; a null source is the last source; null ids are
    mixed as all others; ties of the key go by doc_id and size, and equal rows are taken one after the other."""
    return mixed_documents(docs)


def tokens(spark, docs, sf_dir):
    """SentencePiece ids of each text: doc_id, lang, source, ids, n_ids.

    A null text has null ids (and n_ids null), an empty one none; null ids and repeated rows are encoded as all others."""
    away, back = sheltered(docs, ("ids", "n_ids"))
    return encode(away, MODEL_FILE).withColumn("n_ids", F.size("ids").cast("long")).select("doc_id", "lang", "source", "ids", "n_ids")


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mix sources", mix), ("sentencepiece", tokens)]

#: Training-free, but windows, fingerprints and merges are beyond SQL here; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        after = materialize(stage(spark, docs, sf_dir))
        if k:
            delete_table(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
