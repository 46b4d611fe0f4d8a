"""Per-window statistics of services and call edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.columns import duration_ns, is_error, safe_ratio, target_label
from spanlake.operators.quantiles import percentiles

TARGET = ["target_type", "caller", "callee"]
_STATS = ["call_count", "error_count", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms"]


def service_calls(spans: DataFrame) -> DataFrame:
    """One row per span, addressed to its service."""
    return spans.select(
        *[c for c in ("window_start",) if c in spans.columns],
        F.lit("service").alias("target_type"),
        F.lit("").alias("caller"),
        F.col("service_name").alias("callee"),
        duration_ns().alias("duration_ns"),
        is_error().cast("bigint").alias("error_count"),
    )


def edge_calls(pairs: DataFrame) -> DataFrame:
    """One row per resolved call, with the child's duration and status."""
    return pairs.select(
        *[c for c in ("window_start",) if c in pairs.columns],
        F.lit("edge").alias("target_type"),
        F.col("parent_service_name").alias("caller"),
        F.col("child_service_name").alias("callee"),
        (F.col("child_end_time_unix_nano") - F.col("child_start_time_unix_nano")).alias("duration_ns"),
        is_error("child_status_code").cast("bigint").alias("error_count"),
    )


def call_stats(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, errors and exact p50/p95/p99 in milliseconds."""
    out = percentiles(calls, keys, "duration_ns", [0.5, 0.95, 0.99], ["error_count"])
    ms = [(F.col(f"p{i}") / 1e6).alias(f"latency_p{p}_ms") for i, p in enumerate((50, 95, 99))]
    return out.select(*keys, F.col("n").alias("call_count"), "error_count", *ms)


def window_stats(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Statistics of every (window, target): services and edges in one pass."""
    calls = service_calls(spans).unionByName(edge_calls(pairs))
    stats = call_stats(calls, ["window_start", *TARGET])
    return stats.select("window_start", *TARGET, target_label().alias("target"), *_STATS)


def service_stats(spans: DataFrame) -> DataFrame:
    return as_service_stats(call_stats(service_calls(spans), ["window_start", *TARGET]))


def service_edges(pairs: DataFrame) -> DataFrame:
    return as_service_edges(call_stats(edge_calls(pairs), ["window_start", *TARGET]))


def as_service_stats(stats: DataFrame) -> DataFrame:
    return stats.filter("target_type = 'service'").select(
        "window_start", F.col("callee").alias("service_name"), *_STATS
    )


def as_service_edges(stats: DataFrame) -> DataFrame:
    return stats.filter("target_type = 'edge'").select(
        "window_start", F.col("caller").alias("caller_service"), F.col("callee").alias("callee_service"), *_STATS
    )


def error_rates(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls, errors and a rate that is 0 where there are no calls."""
    return stats.groupBy(*keys).agg(
        F.sum("call_count").alias("call_count"), F.sum("error_count").alias("error_count")
    ).withColumn("error_rate", safe_ratio(F.col("error_count"), F.col("call_count"), 0.0))
