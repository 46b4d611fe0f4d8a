"""Anomaly detectors: a window's statistics against the target's baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.operators.aggregates import TARGET
from spanlake.schemas import (
    CALL_RATE_THRESHOLD,
    ERROR_RATE_MIN_CALLS,
    ERROR_RATE_THRESHOLD,
    PERCENTILE_THRESHOLD,
)

MAD_SCALE = 1.4826  # fixed value: scales a MAD to a normal standard deviation
KEYS = ["window_start", *TARGET, "target"]


def robust_z(value: Column, center: Column, mad: Column) -> Column:
    """Modified z-score; NULL where the spread is degenerate."""
    return F.when(mad > 0, (value - center) / (MAD_SCALE * mad))


def severity(magnitude: Column, threshold: float) -> Column:
    return F.when(magnitude > 2 * threshold, "critical").otherwise("warning")


def _ready(baselines: DataFrame) -> DataFrame:
    return baselines.filter("ready").withColumnRenamed("as_of", "window_start")


def _found(detector: str, fires: Column, level: Column, observed: Column, base: Column, deviation: Column) -> Column:
    """The detection as a struct, NULL where the detector does not fire."""
    return F.when(
        fires,
        F.struct(
            F.lit(detector).alias("detector"),
            level.alias("severity"),
            observed.cast("double").alias("observed_value"),
            base.alias("baseline_value"),
            deviation.alias("deviation"),
        ),
    )


def _percentile_deviation(threshold: float) -> Column:
    center, mad = F.col("latency_median_ms"), F.col("latency_mad_ms")
    p95, p99 = F.col("latency_p95_ms"), F.col("latency_p99_ms")
    z95, z99 = robust_z(p95, center, mad), robust_z(p99, center, mad)
    z = F.greatest(z99, z95)
    observed = F.when(z95 > z99, p95).otherwise(p99)
    return _found("percentile_deviation", z > threshold, severity(z, threshold), observed, center, z)


def _error_rate(min_calls: int, threshold: float) -> Column:
    n1, n2 = F.col("call_count").cast("double"), F.col("call_count_observed").cast("double")
    p1, p2 = F.try_divide(F.col("error_count"), n1), F.col("error_rate")
    pooled = F.try_divide(F.col("error_count") + p2 * n2, n1 + n2)
    variance = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    z = F.try_divide(p1 - p2, F.sqrt(F.when(variance > 0, variance)))
    fires = (n1 >= min_calls) & (pooled > 0) & (pooled < 1) & (z > threshold)
    return _found("error_rate", fires, severity(z, threshold), p1, p2, z)


def _call_rate_drop(threshold: float) -> Column:
    observed = F.coalesce(F.col("call_count"), F.lit(0)).cast("double")
    median = F.col("call_rate_median")
    z = robust_z(observed, median, F.col("call_rate_mad"))
    steady = z.isNull()  # every window of the lookback had the same count
    fires = F.when(steady, (median > 0) & (observed < median * 0.5)).otherwise(z < -threshold)
    relative = F.when(median > 0, (observed - median) / median).otherwise(0.0)
    level = F.when(steady, "critical").otherwise(severity(-z, threshold))
    return _found("call_rate", fires, level, observed, median, F.when(steady, relative).otherwise(z))


def _detections(joined: DataFrame, *detectors: Column) -> DataFrame:
    """All detectors in one pass over the joined rows."""
    fired = F.filter(F.array(*detectors), lambda d: d.isNotNull())
    return joined.select(*KEYS, F.inline(fired))


def detect_percentile_deviation(
    stats: DataFrame, baselines: DataFrame, threshold: float = PERCENTILE_THRESHOLD
) -> DataFrame:
    """p99 or p95, whichever is further above the latency median."""
    return _detections(stats.join(_ready(baselines), KEYS), _percentile_deviation(threshold))


def detect_error_rate(
    stats: DataFrame,
    baselines: DataFrame,
    min_calls: int = ERROR_RATE_MIN_CALLS,
    threshold: float = ERROR_RATE_THRESHOLD,
) -> DataFrame:
    """Pooled two-proportion z-test, increases only."""
    return _detections(stats.join(_ready(baselines), KEYS), _error_rate(min_calls, threshold))


def detect_call_rate_drop(
    stats: DataFrame, baselines: DataFrame, threshold: float = CALL_RATE_THRESHOLD
) -> DataFrame:
    """Driven by the baselines: a known target without a row in the window is at 0."""
    return _detections(_ready(baselines).join(stats, KEYS, "left"), _call_rate_drop(threshold))


def run_detection(
    stats: DataFrame,
    baselines: DataFrame,
    percentile_threshold: float = PERCENTILE_THRESHOLD,
    error_min_calls: int = ERROR_RATE_MIN_CALLS,
    error_threshold: float = ERROR_RATE_THRESHOLD,
    call_rate_threshold: float = CALL_RATE_THRESHOLD,
) -> DataFrame:
    """All detectors over one join of baselines and statistics."""
    return _detections(
        _ready(baselines).join(stats, KEYS, "left"),
        _percentile_deviation(percentile_threshold),
        _error_rate(error_min_calls, error_threshold),
        _call_rate_drop(call_rate_threshold),
    )
