"""Repairs and sources for the names of persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import dictionaries as dic


def strip_us_prefix(entity_type: Column) -> Column:
    """``US_X`` becomes ``X``."""
    return F.regexp_replace(entity_type, "^US_", "")


def dehyphenate(text: Column) -> Column:
    """Words that a line end cut in two become one; offsets after them move."""
    return F.regexp_replace(text, r"([A-Za-z])-[ \t]*\n[ \t]*([a-z])", "$1$2")


def username_persons(df: DataFrame, names: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, username, score) of user names of two words, one of them a known name at least: 0.65 with a point between, with a line 0.80 where
    both are names, else 0.70. ``names`` is a bounded dictionary; the default holds first and last names."""
    known = [x.lower() for x in (names or dic.FIRST_NAMES + dic.LAST_NAMES)]
    rows = df.select(df[id_col].alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(df[text_col], F.lit(r"\b[A-Za-z]{2,}[._][A-Za-z]{2,}\b"), F.lit(0)))).alias("username"))
    parts = F.split(F.lower("username"), "[._]")
    first, last = parts[0].isin(known), parts[1].isin(known)
    score = F.when(F.contains("username", F.lit(".")), 0.65).when(first & last, 0.80).otherwise(0.70)
    return rows.where(first | last).select("doc_id", "username", score.alias("score"))
