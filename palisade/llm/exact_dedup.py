"""Exact deduplication by content hash, in built-in functions only.

Rows are grouped by a 128-bit hash of the normalised text (A-Z lower-cased). Of equal texts the row with the largest id stays.
Inside every group of two rows or more the texts themselves are compared; a hash that two different texts share is split.

Null text counts as the empty text, so all null and empty rows are one group. A null id is smaller than any other. Rows that repeat an id
with the same text are copies like any others and exactly one stays. Other columns are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, key_bitmap, materialise, text_of, with_hit


def content_hash(norm: Column) -> Column:
    """The 128-bit hash, as 16 bytes."""
    return F.unhex(F.md5(norm))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Only hashes and ids are shuffled, and the texts of rows whose hash may repeat (told by a bitmap of fixed size); those are merged
    task by task before they move, so a group that holds a third of all rows is one row per task.
    """
    norm = ascii_lower(text_of(df, text_col))
    base = df.select(df[id_col].alias("id"), norm.alias("norm"))
    ids = materialise(
        base.select("id", F.monotonically_increasing_id().alias("rid"), hash_of(F.col("norm")).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")),
        "exact-ids",
    )

    def grouped(rows: DataFrame) -> DataFrame:
        return materialise(rows.groupBy("h").agg(F.max(F.struct("id", "rid")).alias("keep"), F.count(F.lit(1)).alias("n")), "exact-groups")

    groups = grouped(ids)
    clash = colliding(base.select(hash_of(F.col("norm")).alias("h"), "norm"), groups.where("n > 1"))
    if not clash.isEmpty():
        split = ids.join(clash.select("h", F.lit(True).alias("clash")), "h", "left")
        ids = materialise(split.withColumn("h", F.when(F.col("clash"), F.concat(F.col("h"), F.unhex("sha"))).otherwise(F.col("h"))).drop("clash"), "exact-split")
        groups = grouped(ids)
    return ids.join(groups, "h").select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def colliding(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Hashes of ``repeated`` under which ``rows`` (h, norm) has two different texts: the least and the greatest differ, byte by byte."""
    suspects = with_hit(rows, "h", key_bitmap(repeated, "h"), "hit").where("hit")
    both = suspects.groupBy("h").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    return materialise(both.where(F.col("lo") != F.col("hi")).select("h"), "exact-clash")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns kept. Rows without copies are never shuffled."""
    groups = exact_groups(df, id_col, text_col)
    h, hit = free_name(df, "_hash"), free_name(df, "_hit")
    keyed = df.withColumn(h, F.sha2(ascii_lower(text_of(df, text_col)).cast("binary"), 256))
    heads = materialise(groups.where("kept").select(F.col("text_sha256").alias(h), F.col("keep_id").alias("_keep"), "group_size"), "exact-heads")
    marked = with_hit(keyed, h, key_bitmap(heads.where("group_size > 1"), h), hit)
    alone = marked.where(~F.col(hit)).drop(h, hit)
    keep = free_name(df, "_keep")
    some = marked.where(F.col(hit)).drop(hit).join(heads.select(h, F.col("_keep").alias(keep)), h)
    kept = some.where(F.col(f"`{id_col}`").eqNullSafe(F.col(keep))).dropDuplicates([h]).drop(h, keep)
    return alone.unionByName(kept.select(*[F.col(f"`{c}`") for c in df.columns]))
