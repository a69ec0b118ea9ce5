"""Queries of the passes over detections, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK
from ..operators.detect import detect, redact
from ..operators.passes import analyze, apply, carried, dedup_spans
from . import stages
from .catalog import FAMILIES
from .fixtures import corpus, corpus_sql
from .queries_spans import detections_sql

#: Families that each pass is shown on.
SHOWN = {
    "context_boost": ("phone", "card", "credential", "date", "email", "id"),
    "denylist": ("location", "person", "email", "company"),
    "threshold": ("ip", "phone", "card", "credential", "email", "ssn", "id"),
    "locale_boost": ("phone", "location", "iban", "national_id", "nhs"),
    "nhs_phone_conflict": ("nhs", "phone"),
    "person_inside": ("person", "company", "location"),
    "validated": ("iban", "card", "phone", "national_id", "ssn", "financial"),
    "heuristic_verify": ("company", "location", "id"),
    "islands": ("ip", "phone", "card", "email", "credential"),
    "redact_text": tuple(f.name for f in FAMILIES),
}
#: What a pass wants to know of the whole text.
CARRIED = {"locale_boost": "locale", "nhs_phone_conflict": "geo", "validated": "locale"}
NAMES = {"threshold": "threshold_filter", "validated": "validate_delta", "islands": "overlap_islands"}


def _pass(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = corpus(spark, sf_dir)
        carry = {k: v for k, v in carried().items() if k == CARRIED.get(name)}  # where the text is read, so no text is joined
        out = _plain(apply(name, detect(docs, SHOWN[name], carry=carry), docs))
        return out if name == "locale_boost" else out.drop(*carry)

    return query


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("before", "after", "family")


def _sql(name: str) -> str:
    body = getattr(stages, name)(DUCK)
    drop = "SELECT * EXCLUDE (before, after, family)" if name not in ("islands", "redact_text") else "SELECT *"
    return f"WITH corpus AS ({corpus_sql()}), det AS ({detections_sql(SHOWN[name])}) {drop} FROM ({body})"


def _filter(entity: str):
    families = tuple(f.name for f in FAMILIES if f.entity_type == entity)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..functions.dialect import SPARK
        from ..operators.passes import run_sql

        return run_sql(stages.filter_type(SPARK, entity), det=detect(corpus(spark, sf_dir), families))

    return query, f"WITH det AS ({detections_sql(families)}) SELECT * FROM ({stages.filter_type(DUCK, entity)})"


def locale_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return apply("locale_detect", docs, docs)


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(detect(corpus(spark, sf_dir), ("phone", "card", "ip", "email", "location")))


def analyze_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(corpus(spark, sf_dir))


def analyze_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(corpus(spark, sf_dir), families=("phone", "card", "email", "ip", "nhs"), debug=True)



_filters = {f"filter_{k.lower()}": _filter(k) for k in stages.filters(DUCK)}
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(corpus(spark, sf_dir)).select("doc_id", "redactions", "redacted")


QUERIES = {NAMES.get(n, n): _pass(n) for n in SHOWN} | {k: v[0] for k, v in _filters.items()} | {"locale_detect": locale_detect, "dedup_spans": dedup, "analyze_text": analyze_text, "analyze_debug": analyze_debug, "redact_text": redact_text}
SQL = {NAMES.get(n, n): _sql(n) for n in SHOWN} | {k: v[1] for k, v in _filters.items()} | {"locale_detect": f"WITH corpus AS ({corpus_sql()}) {stages.locale_detect(DUCK)}"}
