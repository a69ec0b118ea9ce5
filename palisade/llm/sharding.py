"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of id and text; pass two puts each bucket in random order by a seeded
Fisher-Yates shuffle and writes it. Buckets one after the other are a random permutation of all rows, which is cut into shards whose
counts differ by one at most (law ``rows``).

Rows that agree in both would share a bucket. Where a bucket is twice the usual size, those of its rows that repeat that often are found, and
for them the hash takes in the row's place in the partition that reads it; then the input must come alike whenever it is read, so the
result of anything but filters on a table is written first. Without such rows the result does not depend on partitions. Null text has size 1 and checksum
0; a null id is a key like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, fresh_path, free_name, materialise

#: Repeated rows of (id, text) up to which their table may be broadcast.
BROADCAST_ROWS = 200_000
#: Buckets whose places are summed up by one task.
GROUP = 4096


def row_bytes(df: DataFrame):
    """About how many bytes a row holds, all columns together."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    nested = [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    return sum([*wide, *nested], F.lit(16 * len(df.columns))).cast("long")


def reads_alike(df: DataFrame) -> bool:
    """Is ``df`` rows of a table, which come in the same partitions whenever they are read? A shuffle may deal them in another way."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return all(re.match(r"[\s:+-]*(Project|Filter|Relation|LocalRelation|LogicalRDD|Scan)\b", line) for line in plan.splitlines() if line.strip())


def shard_rows(df: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20, path: str | None = None) -> DataFrame:
    """Write the rows of ``df``, all columns, under ``path/shard=K/`` and return them with ``_slot``, ``_size``, ``_crc`` and ``shard``.

    ``bucket_bytes`` is what one task holds in memory in pass two; the number of buckets follows from the size of whole rows.
    """
    spark = df.sparkSession
    raw = F.col(f"`{text_col}`").cast("string").cast("binary")
    size = F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(raw), F.lit(0).cast("long"))
    names = {k: free_name(df, k) for k in ("_bucket", "_size", "_crc", "_base", "_slot", "_n", "_place", "_i", "_c", "shard")}
    b, base_name = names["_bucket"], names["_base"]
    rows, total = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    n_name, crc_name = names["_n"], names["_crc"]
    sized = df.withColumn(names["_size"], size).withColumn(crc_name, crc)
    deal = lambda of, *more: of.withColumn(b, F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(crc_name), *more), F.lit(buckets)))
    # One row per bucket; running sums, first over groups of buckets and then within each, are the places where buckets begin.
    count = lambda of: materialise(of.groupBy(b).agg(F.count(F.lit(1)).alias(n_name)).withColumn("group", F.expr(f"`{b}` div {GROUP}")), "shard-counts")
    dealt = deal(sized)
    counts = count(dealt)
    usual = rows / buckets
    full = counts.where(F.col(n_name) > 2 * usual + 8).select(b)
    if buckets > 1 and not full.isEmpty():
        again = dealt.select(F.col(f"`{id_col}`").alias("i"), F.col(crc_name).alias("c"), b).join(full, b, "left_semi").groupBy("i", "c").agg(F.count(F.lit(1)).alias("n"))
        often = materialise(again.where(F.col("n") > usual / 8).select("i", "c"), "shard-often")
        if n_often := often.count():
            sized = sized if reads_alike(df) else materialise(sized, "shard-input")
            placed = sized.withColumn(names["_place"], F.monotonically_increasing_id())
            often = F.broadcast(often) if n_often <= BROADCAST_ROWS else often.hint("merge")
            i, c = names["_i"], names["_c"]
            marked = placed.join(often.select(F.col("i").alias(i), F.col("c").alias(c)), F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.col(crc_name) == F.col(c)), "left")
            dealt = deal(marked, F.when(F.col(c).isNotNull(), F.col(names["_place"]))).drop(i, c, names["_place"])
            counts = count(dealt)
    groups = counts.groupBy("group").agg(F.sum(n_name).alias("n")).select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("before"))
    within = F.sum(n_name).over(Window.partitionBy("group").orderBy(b)) - F.col(n_name)
    offsets = materialise(counts.join(groups, "group").select(b, n_name, (F.col("before") + within).alias(base_name)), "shard-offsets")
    schema = T.StructType([*df.schema.fields, *[T.StructField(names[k], T.LongType()) for k in ("_size", "_crc", "_slot")], T.StructField(names["shard"], T.IntegerType())])
    few, extra = divmod(rows, shards)

    def shuffled(key, table):
        import numpy as np
        import pyarrow as pa

        order = table.select([id_col, names["_crc"]]).to_pandas()
        if len(order) != (expected := table.column(n_name)[0].as_py()):
            raise RuntimeError(f"bucket {key[0].as_py()} has {len(order)} rows, {expected} when it was counted: the input changed between two reads")
        keys = [order[names["_crc"]].to_numpy(), order[id_col].astype(str).to_numpy()] if order[id_col].dtype == object else [order[names["_crc"]].to_numpy(), order[id_col].to_numpy()]
        canonical = np.lexsort(keys)  # whatever order the rows arrived in
        perm = canonical[np.random.Generator(np.random.PCG64([seed, int(key[0].as_py())])).permutation(len(order))]
        at = int(table.column(base_name)[0].as_py()) + np.arange(len(order))
        long = extra * (few + 1)
        shard = np.where(at < long, at // (few + 1), extra + (at - long) // max(few, 1))
        slot = at - np.where(shard < extra, shard * (few + 1), long + (shard - extra) * few)
        out = table.take(pa.array(perm)).drop_columns([b, base_name, n_name])
        out = out.append_column(names["_slot"], pa.array(slot, pa.int64()))
        return out.append_column(names["shard"], pa.array(shard, pa.int32()))

    out = dealt.join(offsets, b).groupBy(b).applyInArrow(shuffled, schema)
    path = path or fresh_path(spark, "shards")
    with arrow_rows(spark):
        out.write.partitionBy(names["shard"]).parquet(path)
    return spark.read.schema(schema).parquet(path)
