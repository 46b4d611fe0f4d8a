"""Tumbling windows, the window spine, range scans and late spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.columns import int_div, ns_to_timestamp, window_start
from spanlake.schemas import NS, WATERMARK_SECONDS, WINDOW_SECONDS
from spanlake.sources.layout import in_days

START = "start_time_unix_nano"


def with_window(spans: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Add ``window_start``: the epoch-aligned window of the span's own start."""
    return spans.withColumn("window_start", window_start(F.col(START), window_seconds))


def window_bounds(spans: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    start = F.col("window_start")
    return (
        with_window(spans, window_seconds)
        .withColumn("window_index", int_div(start, window_seconds))
        .withColumn("window_end", start + window_seconds)
    )


def derive_span_cols(spans: DataFrame) -> DataFrame:
    """Duration, a microsecond timestamp and the partition date."""
    start = ns_to_timestamp(F.col(START))
    return spans.withColumns(
        {
            "duration_ns": F.col("end_time_unix_nano") - F.col(START),
            "start_time": start,
            "start_date": start.cast("date"),
        }
    )


def fetch_window(spans: DataFrame, start: float, end: float) -> DataFrame:
    """Spans with start <= start_time < end (unix seconds).

    The date condition is redundant, but it is the one that prunes the date
    partitions; it is a range, so a window across midnight is complete.
    """
    low, high = int(start * NS), int(end * NS)
    out = spans.filter((F.col(START) >= low) & (F.col(START) < high))
    return in_days(out, "start_date", start, end)


def window_spine(
    spans: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    watermark_seconds: int = WATERMARK_SECONDS,
    now: float | None = None,
) -> DataFrame:
    """Every due window from the first span's on, silent windows included.

    A window is due when ``now`` has reached its end plus the watermark;
    without ``now`` all windows up to the last span's are taken as due. The
    number of rows depends on the time covered, not on the number of spans.
    """
    w = window_seconds
    ends = spans.agg(F.min(START).alias("a"), F.max(START).alias("z"))
    first, last = window_start(F.col("a"), w), window_start(F.col("z"), w)
    if now is not None:
        last_due = int((now - watermark_seconds) // w) * w - w
        last = F.lit(last_due).cast("bigint")
    out = ends.select(first.alias("a"), last.alias("z")).filter("a <= z")
    return out.select(F.explode(F.sequence("a", "z", F.lit(w).cast("bigint"))).alias("window_start")).select(
        "window_start", (F.col("window_start") + w).alias("window_end")
    )


def late_check_boundary(now: float, window_seconds: int = WINDOW_SECONDS, watermark_seconds: int = WATERMARK_SECONDS) -> int:
    """Start of the oldest window still open at ``now``."""
    return int((now - watermark_seconds) // window_seconds) * window_seconds


def late_spans(spans: DataFrame, boundary: float, since: float) -> DataFrame:
    """Spans ingested after ``since`` that belong to an already closed window.

    Days of arrival before ``since`` and days of start behind the boundary are not read.
    """
    spans = in_days(in_days(spans, "arrival_date", low=since), "start_date", high=boundary)
    return spans.filter(
        (F.col("ingested_at_unix_nano") > int(since * NS)) & (F.col(START) < int(boundary * NS))
    ).select("trace_id", "span_id", "service_name", START, "ingested_at_unix_nano")


def as_seen(
    spans: DataFrame, window_seconds: int = WINDOW_SECONDS, watermark_seconds: int = WATERMARK_SECONDS
) -> DataFrame:
    """Only the spans that had arrived when their window was closed."""
    closed = (F.col("window_start") + window_seconds + watermark_seconds) * NS
    return spans.filter(F.col("ingested_at_unix_nano") <= closed)


def arrived_late(
    spans: DataFrame, window_seconds: int = WINDOW_SECONDS, watermark_seconds: int = WATERMARK_SECONDS
) -> DataFrame:
    """The complement of :func:`as_seen`: kept and counted, never reopening a window."""
    closed = (F.col("window_start") + window_seconds + watermark_seconds) * NS
    return spans.filter(F.col("ingested_at_unix_nano") > closed)
