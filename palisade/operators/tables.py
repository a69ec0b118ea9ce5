"""Profiling and masking of tables of any schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import DEFAULT_LABEL, LABELS
from .detect import detect
from .passes import run_sql


def sample_columns(df: DataFrame, per_column: int = 20) -> DataFrame:
    """(column_name, sample, sample_size): up to ``per_column`` distinct values of each column by their hash, joined by " | ".

    The columns become rows in one scan; distinct values and the choice among them are aggregates by column and value.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("cell")) for c in df.columns])).alias("x")).select("x.*")
    return run_sql(
        f"SELECT col AS column_name, count(*) AS sample_size, array_join(transform(array_sort(collect_list(struct(r, cell))), x -> x.cell), ' | ') AS sample FROM (SELECT col, cell, row_number() OVER (PARTITION BY col ORDER BY md5(concat(col, cell)), cell) AS r FROM (SELECT DISTINCT col, cell FROM cells WHERE cell IS NOT NULL) u) t WHERE r <= {per_column} GROUP BY col",
        cells=cells,
    )


def profile_columns(df: DataFrame, families: tuple[str, ...] | None = None, least: float = 0.5) -> DataFrame:
    """(column_name, primary_type, entity_types, density, mean_score, sample_size) of every column with matches.

    The primary type is the most frequent one, the first by name among equals.
    """
    sample = sample_columns(df)
    found = detect(sample, families, id_col="column_name", text_col="sample").where(F.col("score") >= least)
    by_type = found.groupBy("doc_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
    per = by_type.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "entity_type"))["entity_type"].alias("primary_type"), F.array_sort(F.collect_set("entity_type")).alias("entity_types"), F.sum("n").alias("hits"), (F.sum("total") / F.sum("n")).alias("mean_score"))
    return per.join(sample, per["doc_id"] == sample["column_name"]).select("column_name", "primary_type", "entity_types", (F.col("hits") / F.col("sample_size")).alias("density"), "mean_score", "sample_size")


def mask_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Values of the columns in ``types`` become the label of their type; nulls stay null, other columns are untouched."""
    return df.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(LABELS.get(types[c], DEFAULT_LABEL))).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])
