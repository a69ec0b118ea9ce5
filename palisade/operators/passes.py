"""The passes over detections, on DataFrames, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..functions.text import normalize
from ..plans import stages
from ..plans.catalog import Catalog
from .detect import detect
from .recognizers import DATES, proven, rescored, web_family
from .sources import dictionary_families, encoded_spans

PASSES = ("context_boost", "denylist", "locale_boost", "nhs_phone_conflict", "filter_all", "rescored", "person_inside", "validated", "heuristic_verify", "threshold")


def apply(name: str, det: DataFrame, corpus: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """One pass over detections. ``corpus`` (doc_id, text) is joined by passes that look at whole texts, unless ``det`` carries what they need.
    Other columns are handed on if ``more`` names them; with ``kept`` there, rows are marked instead of dropped."""
    if name == "rescored":
        return rescored(det)
    known = tuple(c for c in ("locale", "geo") if c in det.columns)
    make, carried = getattr(stages, name), (*known, *more)
    return run_sql(make(SPARK, carried) if carried else make(SPARK), det=det, **({} if corpus is None or known else {"corpus": corpus}))


def run_sql(sql: str, **frames: DataFrame) -> DataFrame:
    from ..plans.views import with_views

    return with_views(next(iter(frames.values())).sparkSession, "", sql, **frames)


def dedup_spans(det: DataFrame) -> DataFrame:
    """Greedy, per text: by start and falling score, a match goes if one kept before, of its type, contains it, lies in it, or ends
    and begins within three characters of it. A text's matches are folded in one row; other types may overlap."""
    fields = ["s", "score", "e", "entity_type", "pattern", "value"]
    one = F.struct(F.col("s"), (-F.col("score")).alias("order"), *[F.col(c) for c in fields[1:]])
    rows = det.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("xs"))
    near = "(k.s <= x.s AND k.e >= x.e) OR (x.s <= k.s AND x.e >= k.e) OR (abs(k.s - x.s) < 3 AND abs(k.e - x.e) < 3)"
    fold = f"aggregate(xs, slice(xs, 1, 0), (a, x) -> if(exists(a, k -> k.entity_type = x.entity_type AND ({near})), a, concat(a, array(x))))"
    return rows.select("doc_id", F.explode(F.expr(fold)).alias("x")).select("doc_id", *[F.col(f"x.{c}").alias(c) for c in ("entity_type", "pattern", "s", "e", "value", "score")])


def analyze(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: Catalog | None = None, families: tuple[str, ...] | None = None, debug: bool = False) -> DataFrame:
    """Texts to final detections: normalise, recognise, boost, drop, resolve, check, read encoded payloads, cut off, de-duplicate.

    One scan finds what patterns, dictionaries and labelled fields say; later passes work on the matches, their surroundings and what the scan
    carries of the text, and no text is joined back. Rows that share an id, or have none, are texts of their own. What is found in encoded
    payloads meets the cut-offs only. Offsets count in the normalised text. ``families`` keeps to those families, without
    dictionaries, fields and payloads. With ``debug`` the rows are the raw matches
    with the score after each pass (null once dropped).
    """
    corpus = numbered(df, id_col, text_col)
    catalog = catalog or Catalog()
    det = detect(corpus, families, catalog if families else Catalog((*catalog.families, web_family(), DATES, *dictionary_families())), carry=carried(), fields=not families)
    if debug:
        return _trace(det)
    if not families:
        det = proven(det)
    for name in PASSES:
        if name == "threshold" and not families:
            det = det.unionByName(encoded_spans(corpus, catalog), allowMissingColumns=True)
        det = apply(name, fence(det, name))
    return dedup_spans(fence(det, "dedup")).withColumn("doc_id", F.col("doc_id.id"))


def numbered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with the text normalised. ``doc_id`` is the id with the row's number, so rows that share an id, or have none, stay apart."""
    row = F.struct(F.monotonically_increasing_id().alias("row"), df[id_col].alias("id")).alias("doc_id")
    return normalize(df.select(row, df[text_col].alias("text")).where("text is not null"))


def carried() -> dict[str, str]:
    """What the passes want to know of a whole text."""
    return {"locale": stages.locale_of(SPARK), "geo": stages.geo_of(SPARK)}


def fence(det: DataFrame, name: str) -> DataFrame:
    """Count the rows that a pass gets, as the metric ``name``. The optimiser does not move expressions across such a count, which keeps it
    from writing each pass's score into the next one's conditions over and over."""
    return det.observe(f"before {name}", F.count(F.lit(1)).alias("rows"))


def _trace(det: DataFrame) -> DataFrame:
    """The raw matches with their scores after each pass. Rows go through the passes once: dropped ones go on, marked, and every pass writes the
    scores of those it keeps to a column of its own.

    Matches of a row and pattern that begin and end alike are one. A pass that changes the type of a match keeps it."""
    det = det.withColumn("kept", F.lit(True)).withColumn("found", F.col("score")).withColumn("raw_type", F.col("entity_type"))
    more = ["kept", "found", "raw_type"]
    for name in PASSES:
        det = apply(name, fence(det, name), more=tuple(more)).withColumn(f"after_{name}", F.when(F.col("kept"), F.col("score")))
        more.append(f"after_{name}")
    steps = [F.max("found").alias("found"), *[F.max(f"after_{x}").alias(x) for x in PASSES]]
    wide = det.groupBy("doc_id", "pattern", "s", "e").agg(F.max("raw_type").alias("entity_type"), F.max("value").alias("value"), *steps)
    return wide.select(F.col("doc_id.id").alias("doc_id"), "pattern", "s", "e", "entity_type", "value", "found", *PASSES)
