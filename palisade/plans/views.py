"""Named tables for SQL text: every table of a folder, bound by the plan and not by name, so that sessions share nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(spark: SparkSession, sf_dir: str, sql: str, **extra: DataFrame) -> DataFrame:
    """Run ``sql`` over the tables of ``sf_dir`` that it names, and over ``extra``."""
    import re

    names = {t for t in TABLES if t not in extra and re.search(rf"(?i)\b(FROM|JOIN)\s+{t}\b", sql)}
    frames = {t: table(spark, sf_dir, t) for t in sorted(names)} | extra
    if not frames:
        return spark.sql(sql)
    named = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in frames)
    own = sql[5:] if sql.startswith("WITH ") else None
    if own is not None:
        return spark.sql(f"WITH {named}, {own.replace('{', '{{').replace('}', '}}')}", **frames)
    return spark.sql(f"WITH {named} {sql.replace('{', '{{').replace('}', '}}')}", **frames)
