"""Queries of dictionaries, layout, evaluation and summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T
from ..functions.dialect import DUCK, SPARK
from ..operators.detect import detect
from ..operators.passes import run_sql
from ..operators.tokens import token_features
from . import reports as R
from .fixtures import corpus, corpus_sql
from .queries_spans import detections_sql
from .views import with_views

DOCUMENTS = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"

#: Over documents and invented rows.
ON_CORPUS = {
    "decode_scan": T.decode_scan,
    "labeled_fields": T.labeled_fields,
    "normalize_text": lambda d: f"SELECT doc_id, md5({T.normalized(d, 'text')}) AS text_md5, cast(length({T.normalized(d, 'text')}) as bigint) AS n_chars FROM corpus",
    "gazetteer_city": lambda d: R.gazetteer(d, "city"),
    "gazetteer_country": lambda d: R.gazetteer(d, "country"),
    "gazetteer_company": lambda d: R.gazetteer(d, "company"),
    "names_lookup": R.names_lookup,
    "token_features": T.token_features,
}
#: Over the driver's tables.
ON_TABLES = {n: getattr(R, n) for n in ("mask_columns", "merge_blocks", "table_rows", "table_columns", "header_context", "spatial_zone", "horizontal_anchor", "threshold_sweep", "optimal_threshold", "ivw_weights", "auto_adjust", "feedback_categories", "dataset_quality", "conversation_pii", "event_windows")}
#: Over detections of the documents.
ON_DETECTIONS = {n: getattr(R, n) for n in ("pii_by_source", "pii_rollup", "pii_topk_docs")}


def _corpus(make):
    return lambda spark, sf_dir: run_sql(make(SPARK), corpus=corpus(spark, sf_dir))


def _tables(make):
    return lambda spark, sf_dir: with_views(spark, sf_dir, make(SPARK))


def _detections(make):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return with_views(spark, sf_dir, make(SPARK), det=detect(docs, carry={"source": "source"}))

    return query


def person_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(R.person_vote(SPARK), det=detect(corpus(spark, sf_dir), ("person",)))


def _merged_with(d_sql: str, **ctes: str) -> str:
    """CTEs before a query that may begin with CTEs of its own."""
    head = ", ".join(f"{k} AS ({v})" for k, v in ctes.items())
    return f"WITH {head}, {d_sql[5:]}" if d_sql.startswith("WITH ") else f"WITH {head} {d_sql}"


COLUMN_FAMILIES = ("date", "phone", "company", "id", "username", "person", "email")


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types found in a sample of each column: primary type, density and mean score."""
    sample = with_views(spark, sf_dir, R.column_sample(SPARK)).selectExpr("concat(tab, '.', col) AS doc_id", "sample AS text", "sample_size")
    return run_sql(_PROFILE, det=detect(sample, COLUMN_FAMILIES), sample=sample)


_PROFILE = """SELECT doc_id AS column_name, entity_type AS primary_type, round(cast(n as double) / sample_size, 4) AS density, round(mean, 4) AS mean_score, sample_size FROM (
SELECT doc_id, entity_type, n, mean, sample_size, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, entity_type) AS r FROM (SELECT det.doc_id, det.entity_type, count(*) AS n, avg(det.score) AS mean, max(sample.sample_size) AS sample_size FROM det JOIN sample ON det.doc_id = sample.doc_id WHERE det.score >= 0.5 GROUP BY det.doc_id, det.entity_type) c) t WHERE r = 1"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered patterns by entity type."""
    from .catalog import Catalog

    rows = spark.createDataFrame(Catalog().recognizers(), "family string, entity_type string, pattern string, score double")
    return run_sql("SELECT entity_type, count(*) AS n_patterns, max(score) AS top_score FROM patterns GROUP BY entity_type", patterns=rows)


def _registry_sql() -> str:
    from .catalog import Catalog

    rows = ", ".join(f"('{e}', cast({s} as double))" for _, e, _, s in Catalog().recognizers())
    return f"SELECT entity_type, count(*) AS n_patterns, max(score) AS top_score FROM (VALUES {rows}) AS r(entity_type, score) GROUP BY entity_type"


def normalize_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator with NFKC, which SQL lacks."""
    return T.normalize(corpus(spark, sf_dir))


QUERIES = {n: _corpus(m) for n, m in ON_CORPUS.items()} | {n: _tables(m) for n, m in ON_TABLES.items()} | {n: _detections(m) for n, m in ON_DETECTIONS.items()}
QUERIES["token_features"] = lambda spark, sf_dir: token_features(corpus(spark, sf_dir))
QUERIES |= {"person_vote": person_vote, "column_profile": column_profile, "recognizer_registry": registry, "normalize_nfkc": normalize_nfkc}
SQL = {n: f"WITH corpus AS ({corpus_sql()}) {m(DUCK)}" for n, m in ON_CORPUS.items()} | {n: m(DUCK) for n, m in ON_TABLES.items()}
SQL |= {n: _merged_with(m(DUCK), det=detections_sql(None, DOCUMENTS)) for n, m in ON_DETECTIONS.items()}
SQL["person_vote"] = _merged_with(R.person_vote(DUCK), det=detections_sql(("person",)))
SQL["column_profile"] = f"WITH sample AS (SELECT concat(tab, '.', col) AS doc_id, sample AS text, sample_size FROM ({R.column_sample(DUCK)})), det AS ({detections_sql(COLUMN_FAMILIES, 'SELECT doc_id, text FROM sample')}) {_PROFILE}"
SQL["recognizer_registry"] = _registry_sql()
