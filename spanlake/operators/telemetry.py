"""Histograms, quantiles from buckets, counter rates and load-step verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the two histograms.
SPAN_AGE_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300]
BATCH_SIZE_BOUNDS = [1, 10, 50, 100, 500, 1000, 2500, 5000, 10000]
MIN_CONSUMED_SHARE = 0.98
RATE_RANGE_SECONDS = (15, 120)
INFINITE = float("inf")


def histogram(df: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts per upper bound ``le``; one pass, combined map-side."""
    counts = [F.count_if(F.col(value) <= float(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(*counts, F.count(value).alias("b_inf"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(INFINITE).alias("le"), F.col("b_inf").alias("cumulative")))
    return wide.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.*")


def span_age(spans: DataFrame) -> DataFrame:
    """Seconds from a span's end to its ingestion; negative ages are not observed."""
    age = (F.col("ingested_at_unix_nano") - F.col("end_time_unix_nano")) / 1e9
    return spans.withColumn("age_s", age).filter("age_s >= 0")


def histogram_quantile(buckets: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds it.

    Above the last finite bound the answer is that bound. The windows hold one
    row per bucket.
    """
    keys = list(keys)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ordered = part.orderBy("le")
    rank = F.max("cumulative").over(part) * q
    df = buckets.select(*keys, "le", "cumulative").withColumns(
        {
            "_rank": rank,
            "_low": F.coalesce(F.lag("le").over(ordered), F.lit(0.0)),
            "_before": F.coalesce(F.lag("cumulative").over(ordered), F.lit(0)),
        }
    )
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * (F.col("_rank") - F.col("_before")) / (
        F.col("cumulative") - F.col("_before")
    )
    value = F.when(F.col("le") == INFINITE, F.col("_low")).otherwise(inside)
    hit = df.filter((F.col("cumulative") >= F.col("_rank")) & (F.col("cumulative") > F.col("_before")))
    return hit.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))


def counter_increases(samples: DataFrame) -> DataFrame:
    """Reset-aware increase since the previous sample of a (metric, instance)."""
    series = Window.partitionBy("metric", "instance").orderBy("ts")
    before = F.lag("value").over(series)
    step = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return samples.withColumns({"_since": F.lag("ts").over(series), "increase": F.when(before.isNotNull(), step)})


def counter_rate(samples: DataFrame, step_seconds: float) -> DataFrame:
    """Per-second rate of every counter over each step.

    Time is cut into steps of ``step_seconds``; a step's rate uses its last
    ``step_seconds`` clamped to [15, 120] seconds of samples.
    """
    low, high = RATE_RANGE_SECONDS
    span = max(low, min(high, step_seconds))
    step = F.floor(F.col("ts") / step_seconds)
    rows = samples.withColumn("step", step).filter(F.col("ts") >= (F.col("step") + 1) * step_seconds - span)
    series = Window.partitionBy("metric", "instance", "step").orderBy("ts")
    before = F.lag("value").over(series)
    rise = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.when(before.isNotNull(), F.col("value")))
    return (
        rows.withColumn("_rise", rise)
        .groupBy("metric", "instance", "step")
        .agg(F.sum("_rise").alias("_sum"), (F.max("ts") - F.min("ts")).alias("_dt"))
        .filter("_dt > 0")
        .select("metric", "instance", "step", (F.col("_sum") / F.col("_dt")).alias("rate"))
    )


def throughput_verdict(steps: DataFrame) -> DataFrame:
    """``steps`` (run, sequence, target_rate, published, consumed) with pass/fail.

    A failing step counts only when the next attempt, a re-run of the same
    rate, fails too; the first such pair is the breaking point.
    """
    order = Window.partitionBy("run").orderBy("sequence")
    fails = F.col("consumed") < MIN_CONSUMED_SHARE * F.col("published")
    df = steps.withColumn("falling_behind", fails)
    again = F.lead("falling_behind").over(order) & (F.lead("target_rate").over(order) == F.col("target_rate"))
    df = df.withColumn("confirmed", F.col("falling_behind") & F.coalesce(again, F.lit(False)))
    first = F.min(F.when(F.col("confirmed"), F.col("sequence"))).over(Window.partitionBy("run"))
    return df.withColumn("breaking_point", F.coalesce(F.col("sequence") == first, F.lit(False)))


def histogram_delta(cumulative: DataFrame, low: float, high: float) -> DataFrame:
    """Per step: new observations and the share of them in (low, high].

    ``cumulative`` (metric, step, le, cumulative) is a running total over steps.
    """
    series = Window.partitionBy("metric", "le").orderBy("step")
    delta = F.col("cumulative") - F.coalesce(F.lag("cumulative").over(series), F.lit(0))
    steps = cumulative.withColumn("_d", delta)
    at = lambda bound: F.coalesce(F.sum(F.when(F.col("le") == bound, F.col("_d"))), F.lit(0))
    out = steps.groupBy("metric", "step").agg(
        F.max("_d").alias("observations"), (at(high) - at(low)).alias("in_range")
    )
    return out.withColumn(
        "share", F.when(F.col("observations") > 0, F.col("in_range") / F.col("observations"))
    )
