"""From raw documents to packed sequences, in five stages.

Toxic documents go; of equal texts the one with the largest id stays; of near-duplicates one stays; documents that hold a benchmark item go;
the rest is packed. Every stage reads all that the stage before kept, from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import free_name, materialise
from palisade.llm.decontaminate import decontaminate
from palisade.llm.exact_dedup import deduplicate
from palisade.llm.near_dedup import deduplicate_near
from palisade.llm.packing import pack
from palisade.llm.queries import tokenizer_path
from palisade.llm.toxicity import fit, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = free_name(docs, "_toxicity")
    return score_toxicity(docs, model, out=out).where(F.col(out) < 0.5).drop(out)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return deduplicate_near(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack(docs, tokenizer_path()).drop("ids")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean_of_benchmark), ("packing", packed)]

#: SQL has no transducers, signatures, alignments or tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
