"""The read queries over the derived tables, with their argument checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.columns import safe_ratio
from spanlake.schemas import MAX_RANGE_SECONDS, NS


def check_range(start: float, end: float, limit_seconds: int = MAX_RANGE_SECONDS) -> None:
    if end <= start:
        raise ValueError("end must be after start")
    if end - start > limit_seconds:
        raise ValueError(f"at most {limit_seconds} seconds can be queried at once")


def check_trace_id(trace_id: str) -> str:
    if len(trace_id) != 32 or any(c not in "0123456789abcdefABCDEF" for c in trace_id):
        raise ValueError("a trace id has 32 hexadecimal digits")
    return trace_id.lower()


def paged(df: DataFrame, order: list, limit: int | None, offset: int) -> DataFrame:
    """Rows offset+1 to offset+limit in that order, with ``position`` and ``has_more``.

    Without a limit all rows from the offset on, unnumbered. With one, a top-k of
    offset + limit + 1 rows, of which limit + 1 are numbered.
    """
    if (limit is not None and limit < 1) or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    if limit is None:
        rows = df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)
        return rows.withColumn("has_more", F.lit(False))
    page = df.orderBy(*order).limit(offset + limit + 1).offset(offset)
    all_rows = Window.partitionBy(F.lit(1))  # limit + 1 rows at most
    return (
        page.withColumns(
            {"position": F.row_number().over(all_rows.orderBy(*order)) + offset, "has_more": F.count("*").over(all_rows) > limit}
        )
        .filter(F.col("position") <= offset + limit)
    )


def q_trace_durations(spans: DataFrame) -> DataFrame:
    """Milliseconds from a trace's first start to its last end, over all windows."""
    return spans.groupBy("trace_id").agg(
        ((F.max("end_time_unix_nano") - F.min("start_time_unix_nano")) / 1e6).alias("duration_ms")
    )


def q_traces(
    summaries: DataFrame,
    spans: DataFrame,
    start: float,
    end: float,
    service: str | None = None,
    complete: bool | None = None,
    min_duration_ms: float | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of traces, newest first, with paging flags on every row.

    The duration filter comes before the page, so nothing is hidden from it; the flag
    ``duration_filter_truncated`` of the answer's schema is therefore never set.
    """
    check_range(start, end)
    matches = summaries.filter(F.col("window_start").between(start, end))
    if service:
        matches = matches.filter(F.col("root_service") == service)
    if complete is not None:
        matches = matches.filter(F.col("complete") == complete)
    newest = [F.desc("window_start"), F.asc("trace_id")]

    def durations(of: DataFrame) -> DataFrame:
        return q_trace_durations(spans.join(of.select("trace_id").distinct(), "trace_id", "left_semi"))

    if min_duration_ms is None:
        page = paged(matches, newest, limit, offset)
        page = page.join(durations(page), "trace_id", "left")
    else:
        long = matches.join(durations(matches), "trace_id", "left")
        page = paged(long.filter(F.coalesce("duration_ms", F.lit(0.0)) >= min_duration_ms), newest, limit, offset)
    return page.withColumn("duration_filter_truncated", F.lit(False)).select(
        "position",
        "trace_id",
        "window_start",
        "depth",
        "span_count",
        "root_service",
        "complete",
        "incompleteness_reason",
        "orphan_count",
        "duration_ms",
        "has_more",
        "duration_filter_truncated",
    )


def q_trace_detail(spans: DataFrame, classifications: DataFrame, trace_id: str, offsets: DataFrame | None = None) -> DataFrame:
    """The spans of one trace by start, with class (none before processing) and, given
    ``offsets``, their services' clock offsets as of the trace's start."""
    trace_id = check_trace_id(trace_id)
    own = classifications.filter(F.col("trace_id") == trace_id).select("span_id", "classification")
    out = (
        spans.filter(F.col("trace_id") == trace_id)
        .select(
            "span_id",
            "parent_span_id",
            "service_name",
            "span_name",
            "start_time_unix_nano",
            "end_time_unix_nano",
            "status_code",
            "attributes",
        )
        .join(own, "span_id", "left")
    )
    if offsets is not None:
        out = out.join(q_offsets_as_of(spans, offsets, trace_id), "service_name", "left")
    return out.orderBy("start_time_unix_nano", "span_id")


def q_offsets_as_of(spans: DataFrame, offsets: DataFrame, trace_id: str) -> DataFrame:
    """Latest offset of each of the trace's services at or before its start."""
    own = spans.filter(F.col("trace_id") == check_trace_id(trace_id))
    begin = own.agg(F.min("start_time_unix_nano")).scalar()
    services = own.select("service_name").distinct()
    return (
        offsets.join(services, "service_name", "left_semi")
        .filter(F.col("window_start") * NS <= begin)
        .groupBy("service_name")
        .agg(F.max_by(F.struct("offset_ns", "confidence"), "window_start").alias("_o"))
        .select("service_name", "_o.*")
    )


def q_topology(
    edges: DataFrame, start: float, end: float, service: str | None = None, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Summed counts per edge, all or a page; percentiles are those of the edge's latest window."""
    check_range(start, end)
    df = edges.filter(F.col("window_start").between(start, end))
    if service:
        df = df.filter((F.col("caller_service") == service) | (F.col("callee_service") == service))
    p = ["latency_p50_ms", "latency_p95_ms", "latency_p99_ms"]
    out = df.groupBy("caller_service", "callee_service").agg(
        F.sum("call_count").alias("call_count"),
        F.sum("error_count").alias("error_count"),
        *[F.max_by(c, "window_start").alias(c) for c in p],
        F.max("window_start").alias("latest_window_start"),
    )
    rate = safe_ratio(F.col("error_count"), F.col("call_count"), 0.0)
    return paged(out.withColumn("error_rate", rate), ["caller_service", "callee_service"], limit, offset).drop("position")


def q_detections(
    incidents: DataFrame, start: float, end: float, target: str | None = None, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Incidents overlapping the range, newest first, all or a page.

    The root cause's target is looked up among all incidents of the range.
    """
    check_range(start, end)
    df = incidents.filter((F.col("end_window") >= start) & (F.col("start_window") <= end))
    root = df.select(F.col("incident_id").alias("root_cause_incident_id"), F.col("target").alias("root_cause_target"))
    if target:
        df = df.filter(F.col("target") == target)
    newest = [F.desc("start_window"), F.asc("incident_id")]
    page = paged(df, newest, limit, offset)
    return page.join(root, "root_cause_incident_id", "left").select(
        "incident_id",
        "target_type",
        "target",
        "detector",
        F.col("peak_severity").alias("severity"),
        "start_window",
        "end_window",
        "window_count",
        "peak_deviation",
        "derived",
        F.nullif(F.col("root_cause_incident_id"), F.lit("")).alias("root_cause_incident_id"),
        "root_cause_target",
        "has_more",
    ).orderBy(*newest)


def q_clock_offsets(offsets: DataFrame, start: float, end: float) -> DataFrame:
    """The most confident estimate per service in the range (ties: latest)."""
    check_range(start, end)
    return (
        offsets.filter(F.col("window_start").between(start, end))
        .groupBy("service_name")
        .agg(
            F.max_by(
                F.struct("offset_ns", "confidence", "window_start"), F.struct("confidence", "window_start")
            ).alias("_o")
        )
        .select("service_name", "_o.*")
    )


