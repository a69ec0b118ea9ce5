"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bitmap block holds this many bits (the size that ``bitmap_construct_agg`` builds).
BLOCK_BITS = 32768
#: Rows that a Python worker gets at once, while tables are written here.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent, in a local session, is a temporary folder made and recorded; a cluster without one is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            path = found.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            path = "file://" + tempfile.mkdtemp(prefix="palisade-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str, path: str | None = None, rows: int = ARROW_ROWS) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    with arrow_rows(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int = ARROW_ROWS) -> Iterator[None]:
    """Within it, batches between the JVM and Python workers hold ``most`` rows at most, so that neither side keeps large buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Hand freed memory back to the system: workers live on between tasks and stages, and allocators would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; when a task ends, its worker hands back what it no longer uses."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            from .words import forget

            forget()
            release()

    return tidied


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII rows take the fast built-in, which is the same there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, made longer until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bitmap_bits(n: int, most: int = 26) -> int:
    """Bits of a bitmap for ``n`` keys: eight for each key and one block at least, ``2**most`` (8 MB) at most."""
    return min(max((8 * n).bit_length(), BLOCK_BITS.bit_length() - 1), most)


def key_bitmap(keys: DataFrame, key: str, bits: int = 23) -> DataFrame:
    """A Bloom filter of one hash over ``keys[key]``: rows (block, bitmap).

    It never holds more than ``2**bits`` bits (1 MB by default), however many keys there are, so it may be broadcast.
    """
    at = keys.select(_bit(F.col(key), bits).alias("x"))
    return at.groupBy(F.shiftright("x", 15).alias("block")).agg(F.expr(f"bitmap_construct_agg(x & {BLOCK_BITS - 1})").alias("bitmap"))


def with_hit(df: DataFrame, key: str, bitmap: DataFrame, out: str, bits: int = 23) -> DataFrame:
    """Add the boolean ``out``: may the key be among those of ``bitmap``? False is certain."""
    b, m, x = free_name(df, "_block"), free_name(df, "_bitmap"), free_name(df, "_x")
    small = F.broadcast(bitmap.select(F.col("block").alias(b), F.col("bitmap").alias(m)))
    joined = df.withColumn(x, _bit(F.col(f"`{key}`"), bits)).withColumn(b, F.shiftright(x, 15)).join(small, b, "left")
    bit = F.col(x).bitwiseAND(BLOCK_BITS - 1)
    byte = F.conv(F.hex(F.substring(F.col(m), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, bit.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop(x, b, m)


def one_per_key(df: DataFrame, key: str, counts: DataFrame, n: str = "n") -> DataFrame:
    """One row of each key, where ``counts`` has (key, n).

    Only rows whose key may repeat are shuffled; copies that one task holds are merged before that.
    """
    hit = free_name(df, "_hit")
    seen = with_hit(df, key, key_bitmap(counts.where(F.col(n) > 1), key), hit)
    alone, many = seen.where(~F.col(hit)).drop(hit), seen.where(F.col(hit)).drop(hit)
    return alone.unionByName(many.dropDuplicates([key]))
