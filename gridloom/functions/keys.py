"""Composite file names of cells, lines (blobs), words and characters: parsing and building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = r"^cell_r(\d+)_c(\d+)(?:_blob_(\d+(?:_blob_\d+)?))?(?:_word_(\d+))?(?:_char_(\d+)(?:_(\d+))?)?\.png"


def parse_key(name: Column) -> Column:
    """struct(r, c, blob, word, char, part); null where the name is no key. A second line level joins the first: "a_b".

    The name is matched once: its parts are put between marks that no name begins with, then split."""
    mark = "\u0001"
    parts = F.split(F.regexp_replace(name, KEY + r"[\s\S]*$", mark + mark.join(f"${i}" for i in range(1, 7))), mark)

    def fields(p):
        number = lambda i: F.when(p[i] != "", p[i].cast("int"))
        blob = F.when(p[3] != "", F.replace(p[3], F.lit("_blob_"), F.lit("_")))
        return F.when((F.size(p) == 7) & (p[0] == ""), F.struct(number(1).alias("r"), number(2).alias("c"), blob.alias("blob"), number(4).alias("word"), number(5).alias("char"), number(6).alias("part")))

    return F.get(F.transform(F.array(parts), fields), F.lit(0))


def parent_key(name: Column) -> Column:
    """The line that a word or character belongs to."""
    return F.concat(F.substring_index(name, "_word", 1), F.lit(".png"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.png$", "")


def char_name(r: Column, c: Column, blob: Column, word: Column, char: Column) -> Column:
    return F.concat(F.lit("cell_r"), r.cast("string"), F.lit("_c"), c.cast("string"), F.lit("_blob_"), blob.cast("string"), F.lit("_word_"), word.cast("string"), F.lit("_char_"), F.lpad(char.cast("string"), 2, "0"), F.lit(".png"))


def child_name(name: Column, level: str, number: Column, part: Column | None = None) -> Column:
    """The key of a child: ``_blob_1``, ``_word_1`` (from 1), ``_char_00`` (from 0, two digits), and a split part's number."""
    digits = F.lpad(number.cast("string"), 2, "0") if level == "char" else number.cast("string")
    tail = [F.lit(f"_{level}_"), digits, *([F.lit("_"), part.cast("string")] if part is not None else []), F.lit(".png")]
    return F.concat(F.regexp_replace(name, r"\.png$", ""), *tail)


def cell_set(names: DataFrame, column: str = "filename") -> DataFrame:
    """The distinct (r, c) of the names that are keys."""
    return names.select(parse_key(F.col(column)).alias("k")).where("k is not null").select("k.r", "k.c").distinct()
