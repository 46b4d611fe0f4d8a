"""Table schemas, replace-latest keys and fixed settings.

Unix nanoseconds stay BIGINT because Spark timestamps hold microseconds only.
``window_start`` and ``as_of`` are BIGINT unix seconds inside the operators.
"""

from __future__ import annotations

from pyspark.sql import types as T

NS = 1_000_000_000


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields.items()])


_STATS = {
    "call_count": "bigint",
    "error_count": "bigint",
    "latency_p50_ms": "double",
    "latency_p95_ms": "double",
    "latency_p99_ms": "double",
}
_BASELINE = {
    "call_count_observed": "bigint",
    "latency_median_ms": "double",
    "latency_mad_ms": "double",
    "error_rate": "double",
    "call_rate_median": "double",
    "call_rate_mad": "double",
    "ready": "boolean",
}
_EDGE = {"caller_service": "string", "callee_service": "string"}

SCHEMAS: dict[str, T.StructType] = {
    "spans": _schema(
        trace_id="string",
        span_id="string",
        parent_span_id="string",
        service_name="string",
        span_name="string",
        start_time_unix_nano="bigint",
        end_time_unix_nano="bigint",
        status_code="int",
        attributes="map<string,string>",
        ingested_at_unix_nano="bigint",
    ),
    "ground_truth_spans": _schema(
        run_id="string",
        trace_id="string",
        span_id="string",
        parent_span_id="string",
        service_name="string",
        generated_at="bigint",
    ),
    "ground_truth_edges": _schema(run_id="string", trace_id="string", **_EDGE, generated_at="bigint"),
    "ground_truth_clock_offsets": _schema(
        run_id="string", service_name="string", offset_ns="bigint", generated_at="bigint"
    ),
    "ground_truth_incidents": _schema(
        run_id="string",
        incident_id="string",
        type="string",
        target_service="string",
        target_edge="string",
        start_time="double",
        end_time="double",
        magnitude="double",
        generated_at="bigint",
    ),
    "trace_summaries": _schema(
        trace_id="string",
        window_start="bigint",
        depth="int",
        span_count="bigint",
        root_service="string",
        complete="boolean",
        incompleteness_reason="string",
        orphan_count="bigint",
    ),
    "span_classifications": _schema(
        trace_id="string", span_id="string", window_start="bigint", classification="string"
    ),
    "service_edges": _schema(window_start="bigint", **_EDGE, **_STATS),
    "service_stats": _schema(window_start="bigint", service_name="string", **_STATS),
    "service_clock_offsets": _schema(
        window_start="bigint", service_name="string", offset_ns="bigint", confidence="bigint"
    ),
    "service_baselines": _schema(as_of="bigint", service_name="string", **_BASELINE),
    "edge_baselines": _schema(as_of="bigint", **_EDGE, **_BASELINE),
    "detections": _schema(
        window_start="bigint",
        target_type="string",
        target="string",
        detector="string",
        severity="string",
        observed_value="double",
        baseline_value="double",
        deviation="double",
    ),
    "detected_incidents": _schema(
        incident_id="string",
        target_type="string",
        target="string",
        detector="string",
        start_window="bigint",
        end_window="bigint",
        window_count="bigint",
        peak_severity="string",
        peak_deviation="double",
        derived="boolean",
        root_cause_incident_id="string",
    ),
    "window_counters": _schema(window_start="bigint", metric="string", label="string", value="bigint"),
    "topology": _schema(caller_service="string", callee_service="string"),
}

# The newest row per key wins; tables without a key only ever grow.
KEYS: dict[str, list[str]] = {
    "spans": ["trace_id", "span_id"],
    "trace_summaries": ["trace_id", "window_start"],
    "span_classifications": ["trace_id", "span_id"],
    "service_edges": ["caller_service", "callee_service", "window_start"],
    "service_stats": ["service_name", "window_start"],
    "service_clock_offsets": ["service_name", "window_start"],
    "service_baselines": ["service_name", "as_of"],
    "edge_baselines": ["caller_service", "callee_service", "as_of"],
    "detections": ["target_type", "target", "detector", "window_start"],
    "detected_incidents": ["incident_id"],
    "window_counters": ["window_start", "metric", "label"],
    "topology": ["caller_service", "callee_service"],
}

# The column (unix seconds, or nanoseconds for spans) whose day partitions a table.
TIME_COLUMN: dict[str, str] = {
    "spans": "start_time_unix_nano",
    "trace_summaries": "window_start",
    "span_classifications": "window_start",
    "service_edges": "window_start",
    "service_stats": "window_start",
    "service_clock_offsets": "window_start",
    "service_baselines": "as_of",
    "edge_baselines": "as_of",
    "detections": "window_start",
    "detected_incidents": "start_window",
    "window_counters": "window_start",
}

# Defaults the results depend on.
WINDOW_SECONDS = 60
WATERMARK_SECONDS = 30
BASELINE_LOOKBACK_SECONDS = 900
BASELINE_MIN_SAMPLES = 30
GROUPING_LOOKBACK_SECONDS = 300
PERCENTILE_THRESHOLD = 3.5
ERROR_RATE_THRESHOLD = 3.0
ERROR_RATE_MIN_CALLS = 10
CALL_RATE_THRESHOLD = 3.0
ROOT_SERVICE = "frontend"
MAX_RANGE_SECONDS = 86_400
STATUS_ERROR = 2
