"""Literal rows for the scenario tests."""

from __future__ import annotations

MS = 1_000_000
S = 1_000_000_000

SPAN_DDL = (
    "trace_id string, span_id string, parent_span_id string, service_name string, span_name string, "
    "start_time_unix_nano bigint, end_time_unix_nano bigint, status_code int, attributes map<string,string>, "
    "ingested_at_unix_nano bigint"
)


def span(span_id, parent="", service="svc", start=0, end=None, trace="t", status=1, ingested=None):
    end = start + 10 * MS if end is None else end
    return (trace, span_id, parent, service, "op", start, end, status, {}, end if ingested is None else ingested)


def spans(spark, *rows, window=60):
    from spanlake.operators.windows import with_window

    return with_window(spark.createDataFrame(list(rows), SPAN_DDL), window)


STATS_DDL = (
    "window_start bigint, target_type string, caller string, callee string, target string, call_count bigint, "
    "error_count bigint, latency_p50_ms double, latency_p95_ms double, latency_p99_ms double"
)
BASELINE_DDL = (
    "as_of bigint, target_type string, caller string, callee string, target string, call_count_observed bigint, "
    "latency_median_ms double, latency_mad_ms double, error_rate double, call_rate_median double, "
    "call_rate_mad double, window_count_observed bigint, ready boolean"
)
DETECTION_DDL = (
    "window_start bigint, target_type string, caller string, callee string, target string, detector string, "
    "severity string, observed_value double, baseline_value double, deviation double"
)
INCIDENT_DDL = (
    "incident_id string, target_type string, caller string, callee string, target string, detector string, "
    "start_window bigint, end_window bigint, window_count bigint, peak_severity string, peak_deviation double"
)


def detection(window, service="checkout", detector="percentile_deviation", severity="warning", deviation=4.0, caller=None):
    kind = "service" if caller is None else "edge"
    target = service if caller is None else f"{caller}->{service}"
    return (window, kind, caller or "", service, target, detector, severity, 1.0, 1.0, deviation)


def incident(service, start=0, end=0, detector="percentile_deviation", caller=None):
    kind = "service" if caller is None else "edge"
    target = service if caller is None else f"{caller}->{service}"
    return (f"{kind}:{target}:{detector}:{start}", kind, caller or "", service, target, detector, start, end, 1, "warning", 4.0)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
