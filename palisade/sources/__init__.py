"""Readers and writers by kind of file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".orc": "orc", ".txt": "text"}
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp", ".heic")

#: One correction by a person (a JSON object per file, or one per line).
FEEDBACK = T.StructType.fromDDL("detectedText string, detectedEntityType string, confidence double, suggestedEntityTypes array<string>, notes string, fileName string, filePath string, timestamp string, bbox struct<x: double, y: double, width: double, height: double>, page int")
#: Corpora with labelled spans.
LABELLED = T.StructType.fromDDL("text string, spans array<struct<label: string, text: string, start: int, end: int>>")
#: Text blocks of pages, the contract with any recogniser of characters.
BLOCKS = T.StructType.fromDDL("doc_id bigint, page int, block bigint, text string, x1 double, y1 double, x2 double, y2 double, page_width double, page_height double, dpi double")


def file_type(path: str) -> str:
    """``table``, ``image``, ``pdf`` or ``unknown``, by the suffix."""
    suffix = "." + path.lower().rstrip("/").rsplit(".", 1)[-1]
    return "table" if suffix in TABLES or suffix == ".xlsx" else "image" if suffix in IMAGES else "pdf" if suffix == ".pdf" else "unknown"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table by its suffix. Without a schema, CSV columns are strings: masking and profiling read text anyway."""
    suffix = "." + path.lower().rstrip("/").rsplit(".", 1)[-1]
    if suffix == ".xlsx":
        raise NotImplementedError("spreadsheets in XLSX need openpyxl, which is not installed; save them as CSV")
    if suffix not in TABLES:
        raise ValueError(f"not a table: {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if TABLES[suffix] == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if suffix == ".tsv" else ",")
    return reader.format(TABLES[suffix]).load(path)


def read_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (*IMAGES, ".pdf")) -> DataFrame:
    """Images and PDFs as rows (path, length, content), for a recogniser that turns them into ``BLOCKS``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.where(F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)).isin(*suffixes)).select("path", "length", "content")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).option("multiLine", True).json(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled corpora (JSON lines, JSON or Parquet) as (sample_id, text, spans, ground_truth map of label to values)."""
    rows = spark.read.schema(LABELLED)
    rows = rows.parquet(path) if path.rstrip("/").endswith(".parquet") else rows.option("multiLine", path.endswith(".json")).json(path)
    spans = F.transform("spans", lambda s: F.struct(s["label"].alias("label"), F.coalesce(s["text"], F.substring("text", s["start"] + 1, s["end"] - s["start"])).alias("value"), s["start"].alias("start"), s["end"].alias("end")))
    out = rows.select(F.xxhash64("text").alias("sample_id"), "text", F.coalesce(spans, F.from_json(F.lit("[]"), "array<struct<label: string, value: string, start: int, end: int>>")).alias("spans"))
    labels = F.array_distinct(F.transform("spans", lambda s: s["label"]))
    truth = F.map_from_entries(F.transform(labels, lambda k: F.struct(k, F.transform(F.filter("spans", lambda s: s["label"] == k), lambda s: s["value"]))))
    return out.withColumn("ground_truth", truth)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table by the suffix of its folder."""
    suffix = "." + path.lower().rstrip("/").rsplit(".", 1)[-1]
    if suffix not in TABLES:
        raise ValueError(f"not a table: {path}")
    writer = df.write.mode(mode).format(TABLES[suffix])
    (writer.option("header", True).option("escape", '"').option("sep", "\t" if suffix == ".tsv" else ",") if TABLES[suffix] == "csv" else writer).save(path)
