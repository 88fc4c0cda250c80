"""Event-time windows with watermarks; the same functions serve batch tables, where the watermark has no effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, time: str, late: str) -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(df: DataFrame, time: str, width: str, aggregates: Sequence[Column], by: Sequence[str] = (), late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, end, by..., aggregates); with `slide` the windows overlap."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    made = _timed(df, time, late).groupBy(w, *by).agg(*aggregates)
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in made.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, aggregates: Sequence[Column], by: Sequence[str], late: str = "1 hour") -> DataFrame:
    made = _timed(df, time, late).groupBy(F.session_window(time, gap), *by).agg(*aggregates)
    return made.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in made.columns if c != "session_window"])


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of equal key where the right row follows the left one within an interval; both sides keep only what can still match."""
    a, b = _timed(left, left_time, late).alias("l"), _timed(right, right_time, late).alias("r")
    after, most = F.col(f"r.{right_time}") >= F.col(f"l.{left_time}"), F.col(f"r.{right_time}") <= F.col(f"l.{left_time}") + F.expr(f"interval {within}")
    names = {c: f"{c}_right" if c in left.columns else c for c in right.columns if c != key}
    return a.join(b, (F.col(f"l.{key}") == F.col(f"r.{key}")) & after & most).select("l.*", *[F.col(f"r.{c}").alias(n) for c, n in names.items()])
