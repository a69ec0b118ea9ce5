"""One query per pattern family, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK
from ..operators.detect import AFTER, BEFORE, detect
from .catalog import FAMILIES, Family
from .fixtures import corpus, corpus_sql

COLUMNS = ("doc_id", "entity_type", "pattern", "score", "s", "e", "value")


def detections_sql(families: tuple[str, ...] | None = None, source: str | None = None) -> str:
    """Rows (doc_id, family, entity_type, pattern, score, s, e, value, before, after) in DuckDB."""
    d, parts = DUCK, []
    for f in FAMILIES:
        if families is None or f.name in families:
            for p in f.patterns:
                parts.append(_one(d, f, p.name, p.score, p.regex))
    around = f"substring(text, greatest(s - {BEFORE}, 0) + 1, least(s, {BEFORE})) AS before, substring(text, e + 1, {AFTER}) AS after"
    return f"WITH corpus AS MATERIALIZED ({source or corpus_sql()}) SELECT doc_id, family, entity_type, pattern, score, s, e, value, {around} FROM ({' UNION ALL '.join(parts)})"


def _one(d, f: Family, name: str, score: float, rx: str) -> str:
    length = lambda xs: d.itotal(d.map(xs, "y", "length(y)"))
    return f"""SELECT doc_id, text, '{f.name}' AS family, '{f.entity_type}' AS entity_type, '{name}' AS pattern, cast({score} as double) AS score, s, s + length(m[i]) AS e, m[i] AS value FROM (
SELECT *, {length('p[1:i]')} + {length('m[1:i-1]')} AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
SELECT doc_id, text, {d.extract_all('text', rx)} AS m, {d.split('text', rx)} AS p FROM corpus WHERE {d.matches('text', f.gate)} AND {d.matches('text', rx)})))"""


def _spans(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect(corpus(spark, sf_dir), (name,)).select(*COLUMNS)

    return query


QUERIES = {f"spans_{f.name}": _spans(f.name) for f in FAMILIES}
SQL = {f"spans_{f.name}": f"SELECT {', '.join(COLUMNS)} FROM ({detections_sql((f.name,))})" for f in FAMILIES}
