"""What a recognised token, an image's tokens, and a cell's readings are: number, word, text, or something else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the token rules.
NUMBER = r"^[+-]?\d+([.,]\d+)*$"
WORD = r"^[A-Za-zА-Яа-яЁё.,!?;:()\-\']+$"
PURE_NUMBER = r"^\d+[\.,]?\d*$"
LONG_LETTERS = "[a-zA-Zа-яА-Я]{4,}"
SOME_LETTERS = "[a-zA-Zа-яА-Я]{3,}"


def token_type(token: Column) -> Column:
    return F.when(token.rlike(NUMBER), "number").when(token.rlike(WORD), "word").otherwise("other")


def dominant(words: Column, numbers: Column, other: Column) -> Column:
    return (
        F.when(words + numbers + other == 0, "none")
        .when((words > numbers) & (words >= other), "words")
        .when((numbers > words) & (numbers >= other), "numbers")
        .when((words == 0) & (numbers == 0) & (other > 0), "other")
        .otherwise("mixed")
    )


def clean_number(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\d.,]", "")


def cell_type(cn: Column, distinct: Column, mw: Column, pure: Column, ratio: Column, n: Column) -> Column:
    """NUMBER, TEXT or EMPTY from the evidence counters of a cell's readings; the first rule that holds counts."""
    return (
        F.when(n == 0, "EMPTY").when(cn >= 5, "NUMBER").when(mw >= 3, "TEXT").when((distinct == 1) & (cn >= 3), "NUMBER").when((mw >= 2) & (cn <= 2), "TEXT").when((cn >= 3) & (mw == 0), "NUMBER")
        .when((mw >= 1) & (cn <= 2), "TEXT").when((pure >= 2) & (mw == 0), "NUMBER").when((ratio >= 0.6) & (mw == 0), "NUMBER").when((ratio <= 0.3) & (mw >= 1), "TEXT").when((cn >= 2) & (mw == 0), "NUMBER").otherwise("TEXT")
    )


def number_or_other(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p > threshold, "NUMBER").otherwise("OTHER")
