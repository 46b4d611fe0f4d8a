"""Rolling robust baselines of services and call edges.

A baseline as of a window is built from everything in the lookback strictly
before it. Instead of re-reading the lookback for every window, each call knows
the range of windows it counts for, and calls are dealt by stretches of windows
that have their baselines in one task (see quantiles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.columns import duration_ns, int_div, floor_to, is_error, safe_ratio, target_label
from spanlake.operators.aggregates import TARGET
from spanlake.operators.quantiles import rolling_median_mad, small_mad, small_median
from spanlake.operators.windows import fetch_window
from spanlake.schemas import BASELINE_LOOKBACK_SECONDS, BASELINE_MIN_SAMPLES, NS, WINDOW_SECONDS
from spanlake.session import checkpoint

START = "start_time_unix_nano"
#: Services and edges whose numbers are broadcast (some 20 MB); more are joined by shuffles.
BROADCAST_TARGETS = 200_000


def as_of_range(first_ns: Column, last_ns: Column, window_seconds: int, lookback_seconds: int) -> list[Column]:
    """[k_lo, k_hi]: the windows k for which both instants lie in [kW-L, kW)."""
    w, l = window_seconds * NS, lookback_seconds * NS
    index = lambda ns: int_div(floor_to(ns, w), w)
    return [(index(last_ns) + 1).alias("k_lo"), index(first_ns + l).alias("k_hi")]


def lookback_spans(spans: DataFrame, as_of: float, lookback_seconds: int = BASELINE_LOOKBACK_SECONDS) -> DataFrame:
    """The spans one baseline is built from: [as_of - L, as_of)."""
    return fetch_window(spans, as_of - lookback_seconds, as_of)


def lookback_calls(spans: DataFrame, any_pairs: DataFrame, window_seconds: int, lookback_seconds: int) -> DataFrame:
    """Calls of all targets with the range of windows they count for.

    ``any_pairs`` are pairs resolved per trace, not per window: a pair split
    over two windows counts wherever both its spans are in the lookback.
    """
    services = spans.select(
        F.lit("service").alias("target_type"),
        F.lit("").alias("caller"),
        F.col("service_name").alias("callee"),
        *as_of_range(F.col(START), F.col(START), window_seconds, lookback_seconds),
        duration_ns().alias("duration_ns"),
        is_error().cast("bigint").alias("errors"),
    )
    p, c = F.col("parent_start_time_unix_nano"), F.col("child_start_time_unix_nano")
    edges = any_pairs.select(
        F.lit("edge").alias("target_type"),
        F.col("parent_service_name").alias("caller"),
        F.col("child_service_name").alias("callee"),
        *as_of_range(F.least(p, c), F.greatest(p, c), window_seconds, lookback_seconds),
        (F.col("child_end_time_unix_nano") - c).alias("duration_ns"),
        is_error("child_status_code").cast("bigint").alias("errors"),
    )
    return services.unionByName(edges).filter("k_lo <= k_hi")


def call_rate_history(
    stats: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    lookback_seconds: int = BASELINE_LOOKBACK_SECONDS,
) -> DataFrame:
    """Median and MAD of the stored per-window call counts of each lookback.

    A silent window has no row and is not a zero. A lookback holds at most
    L / W rows per target, so collecting them is bounded.
    """
    w = window_seconds
    history = stats.select(
        *TARGET,
        F.col("call_count").cast("double").alias("calls"),
        F.explode(
            F.sequence(
                int_div(F.col("window_start"), w) + 1,
                int_div(F.col("window_start") + lookback_seconds, w),
            )
        ).alias("as_of_index"),
    )
    return (
        history.groupBy(*TARGET, "as_of_index")
        .agg(F.collect_list("calls").alias("calls"))
        .select(
            *TARGET,
            (F.col("as_of_index") * w).alias("as_of"),
            F.size("calls").cast("bigint").alias("window_count_observed"),
            small_median(F.col("calls")).alias("call_rate_median"),
            small_mad(F.col("calls")).alias("call_rate_mad"),
        )
    )


def baselines(
    spans: DataFrame,
    any_pairs: DataFrame,
    stats: DataFrame,
    spine: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    lookback_seconds: int = BASELINE_LOOKBACK_SECONDS,
    min_samples: int = BASELINE_MIN_SAMPLES,
) -> DataFrame:
    """One row per (as_of, target) with any call in the lookback."""
    calls = lookback_calls(spans, any_pairs, window_seconds, lookback_seconds)
    # Number the targets once; every later key, sort and shuffle is on integers.
    # The list has one row per service and edge: while it is short it goes to the calls,
    # which by so few keys would meet in a few tasks.
    targets = checkpoint(
        calls.select(*TARGET).distinct().withColumn("target_id", F.monotonically_increasing_id())
    )
    few = targets.count() <= BROADCAST_TARGETS
    coded = calls.join(F.broadcast(targets) if few else targets, TARGET).select("target_id", "k_lo", "k_hi", "duration_ns", "errors")
    stretch = 4 * (lookback_seconds // window_seconds + 1)
    medians = rolling_median_mad(coded, ["target_id"], "duration_ns", stretch, ["errors"])
    latency = medians.join(targets, "target_id").select(
        *TARGET,
        (F.col("as_of_index") * window_seconds).alias("as_of"),
        F.col("n").alias("call_count_observed"),
        (F.col("median2") / 2e6).alias("latency_median_ms"),
        (F.col("mad4") / 4e6).alias("latency_mad_ms"),
        safe_ratio(F.col("errors"), F.col("n"), 0.0).alias("error_rate"),
    )
    rates = call_rate_history(stats, window_seconds, lookback_seconds)
    windows = spine.select(F.col("window_start").alias("as_of"))
    zero = F.lit(0.0)
    return (
        latency.join(windows, "as_of", "left_semi")
        .join(rates, [*TARGET, "as_of"], "left")
        .select(
            "as_of",
            *TARGET,
            target_label().alias("target"),
            "call_count_observed",
            "latency_median_ms",
            "latency_mad_ms",
            "error_rate",
            F.coalesce("call_rate_median", zero).alias("call_rate_median"),
            F.coalesce("call_rate_mad", zero).alias("call_rate_mad"),
            F.coalesce("window_count_observed", F.lit(0)).cast("bigint").alias("window_count_observed"),
            (F.col("call_count_observed") >= min_samples).alias("ready"),
        )
    )


def cold_counts(table: DataFrame) -> DataFrame:
    """Baselines not ready, per window and kind of target."""
    return table.filter("NOT ready").groupBy("as_of", "target_type").agg(F.count(F.lit(1)).alias("cold"))


_STORED = [
    "call_count_observed",
    "latency_median_ms",
    "latency_mad_ms",
    "error_rate",
    "call_rate_median",
    "call_rate_mad",
    "ready",
]


def as_service_baselines(table: DataFrame) -> DataFrame:
    return table.filter("target_type = 'service'").select(
        "as_of", F.col("callee").alias("service_name"), *_STORED
    )


def as_edge_baselines(table: DataFrame) -> DataFrame:
    return table.filter("target_type = 'edge'").select(
        "as_of", F.col("caller").alias("caller_service"), F.col("callee").alias("callee_service"), *_STORED
    )
