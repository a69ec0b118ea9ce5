"""The same operators on streams, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import detect


def detect_stream(rows: DataFrame, families: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of a stream of texts. Recognition is row by row, so it keeps no state."""
    return detect(rows, families, id_col=id_col, text_col=text_col)


def window_counts(events: DataFrame, key: str = "event_type", time: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts by key in tumbling (or sliding) windows; on a stream, state is dropped once the watermark passes a window."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(span.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_counts(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events by key and session, a session ending after ``gap`` without one."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def over_limit(requests: DataFrame, client: str = "user_id", time: str = "ts", limit: int = 100, size: str = "60 seconds") -> DataFrame:
    """Clients that make more than ``limit`` requests in a window."""
    return window_counts(requests, client, time, size).where(F.col("n") > limit)
