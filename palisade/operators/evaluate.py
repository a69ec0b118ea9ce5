"""Scoring of detections against labelled spans, and calibration on samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..plans import reports
from .passes import run_sql


def score_types(found: DataFrame, gold: DataFrame, lenient: bool = False) -> DataFrame:
    """Precision, recall and F1 by type. ``found`` and ``gold`` have doc_id, entity_type, s, e.

    Strict: type and both ends must agree. Lenient: spans that overlap count, and for recall a match of any type does.
    """
    a, b = found.select("doc_id", "entity_type", "s", "e").distinct(), gold.select("doc_id", "entity_type", "s", "e").distinct()
    if lenient:
        other = lambda x, t: x.select(F.col("doc_id").alias("d"), F.col("entity_type").alias("t"), F.col("s").alias("s2"), F.col("e").alias("e2"))
        over = (F.col("doc_id") == F.col("d")) & (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e"))
        hit = a.join(other(b, "b"), over & (F.col("entity_type") == F.col("t")), "left_semi")
        recalled = b.join(other(a, "a"), over, "left_semi")
    else:
        keys = ["doc_id", "entity_type", "s", "e"]
        hit, recalled = a.join(b, keys, "left_semi"), b.join(a, keys, "left_semi")
    count = lambda df, name: df.groupBy("entity_type").agg(F.count(F.lit(1)).alias(name))
    out = count(a, "found").join(count(b, "gold"), "entity_type", "full").join(count(hit, "tp"), "entity_type", "left").join(count(recalled, "recalled"), "entity_type", "left").na.fill(0)
    p, r = F.col("tp") / F.greatest("found", F.lit(1)), F.col("recalled") / F.greatest("gold", F.lit(1))
    return out.select("entity_type", "found", "gold", "tp", p.alias("prec"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"))


def calibrate(name: str, samples: DataFrame) -> DataFrame:
    """One of threshold_sweep, optimal_threshold, ivw_weights, auto_adjust over samples (entity_type, model, confidence, is_correct)."""
    return run_sql(getattr(reports, name)(SPARK).replace(reports.SAMPLES, "samples"), samples=samples)
