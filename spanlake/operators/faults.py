"""Deterministic perturbations of a span table, for robustness tests at scale.

Draws come from a hash of (seed, ids), so a rerun or another engine gets the
same result. Compose in the order out-of-order, drop, late arrival, skew, then
:func:`apply_arrival`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAY = "arrival_delay_ns"


def uniform(*parts: Column | str) -> Column:
    """A draw from [0, 1): the first 8 hex digits of an md5."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def _span_draw(seed: str) -> Column:
    return uniform(seed, F.col("trace_id"), F.col("span_id"))


def _with_delay(spans: DataFrame) -> DataFrame:
    return spans if DELAY in spans.columns else spans.withColumn(DELAY, F.lit(0).cast("bigint"))


def fault_drop(spans: DataFrame, rate: float, seed: str = "drop") -> DataFrame:
    return spans if rate <= 0 else spans.filter(_span_draw(seed) >= rate)


def fault_out_of_order(spans: DataFrame, rate: float, delay_ns: int, seed: str = "ooo") -> DataFrame:
    """Delay spans that are some span's parent, so that children arrive first."""
    spans = _with_delay(spans)
    if rate <= 0:
        return spans
    parents = (
        spans.filter("parent_span_id <> ''")
        .select("trace_id", F.col("parent_span_id").alias("span_id"), F.lit(True).alias("_parent"))
        .distinct()
    )
    hit = F.col("_parent") & (_span_draw(seed) < rate)
    delayed = F.when(hit, F.greatest(F.col(DELAY), F.lit(delay_ns))).otherwise(F.col(DELAY))
    return spans.join(parents, ["trace_id", "span_id"], "left").withColumn(DELAY, delayed).select(*spans.columns)


def fault_late_arrival(spans: DataFrame, rate: float, min_ns: int, max_ns: int, seed: str = "late") -> DataFrame:
    spans = _with_delay(spans)
    if rate <= 0:
        return spans
    amount = min_ns + F.floor(_span_draw(seed + "-by") * max(max_ns - min_ns, 0)).cast("bigint")
    return spans.withColumn(
        DELAY, F.when(_span_draw(seed) < rate, F.greatest(F.col(DELAY), amount)).otherwise(F.col(DELAY))
    )


def clock_offset_of(service: Column, rate: float, max_ns: int, root_service: str, seed: str) -> Column:
    """The constant offset of a service; a projection, so no table of services is needed."""
    size = F.floor(uniform(seed + "-by", service) * max_ns).cast("bigint") + 1
    signed = F.when(uniform(seed + "-sign", service) < 0.5, -size).otherwise(size)
    return F.when((service != root_service) & (uniform(seed, service) < rate), signed).otherwise(0)


def fault_clock_skew(spans: DataFrame, rate: float, max_ns: int, root_service: str, seed: str = "skew") -> DataFrame:
    """Shift start and end by the service's offset; durations stay."""
    if rate <= 0:
        return spans
    offset = clock_offset_of(F.col("service_name"), rate, max_ns, root_service, seed)
    return spans.withColumns(
        {c: F.col(c) + offset for c in ("start_time_unix_nano", "end_time_unix_nano")}
    )


def skew_ground_truth(spans: DataFrame, rate: float, max_ns: int, root_service: str, seed: str = "skew") -> DataFrame:
    services = spans.select("service_name").distinct()
    return services.withColumn("offset_ns", clock_offset_of(F.col("service_name"), rate, max_ns, root_service, seed))


def apply_arrival(spans: DataFrame) -> DataFrame:
    """Fold the accumulated delay into the ingestion time."""
    if DELAY not in spans.columns:
        return spans
    return spans.withColumn("ingested_at_unix_nano", F.col("ingested_at_unix_nano") + F.col(DELAY)).drop(DELAY)
