"""Windows of event time, on streams (with a watermark) and on tables alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygrid.schema import col


def _late(df: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    return df.withWatermark(ts, lateness) if lateness and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, size: str, by: Sequence[str], aggregates: Sequence[Column], lateness: str | None = None) -> DataFrame:
    """window_start, the keys and the aggregates of windows that follow each other."""
    return sliding(df, ts, size, size, by, aggregates, lateness)


def sliding(df: DataFrame, ts: str, size: str, step: str, by: Sequence[str], aggregates: Sequence[Column], lateness: str | None = None) -> DataFrame:
    grouped = _late(df, ts, lateness).groupBy(F.window(col(ts), size, step).alias("w"), *map(col, by))
    return grouped.agg(*aggregates).select(F.col("w.start").alias("window_start"), *[c for c in grouped.agg(*aggregates).columns if c != "w"])


def sessions(df: DataFrame, ts: str, gap: str, by: Sequence[str], aggregates: Sequence[Column], lateness: str | None = None) -> DataFrame:
    """window_start, window_end, the keys and the aggregates of stretches without a pause of `gap`."""
    out = _late(df, ts, lateness).groupBy(F.session_window(col(ts), gap).alias("w"), *map(col, by)).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])
