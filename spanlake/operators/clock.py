"""Clock skew: causality violations and relative per-service offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators.quantiles import percentiles
from spanlake.schemas import ROOT_SERVICE
from spanlake.session import checkpoint, configure


def clock_violations(pairs: DataFrame) -> DataFrame:
    """Calls whose child starts before, or else ends after, its parent."""
    kind = F.when(
        F.col("child_start_time_unix_nano") < F.col("parent_start_time_unix_nano"), "starts_before_parent"
    ).when(F.col("child_end_time_unix_nano") > F.col("parent_end_time_unix_nano"), "ends_after_parent")
    return (
        pairs.withColumn("kind", kind)
        .filter("kind IS NOT NULL")
        .select(
            "trace_id",
            "window_start",
            F.col("parent_span_id"),
            F.col("child_span_id"),
            F.col("parent_service_name").alias("caller_service"),
            F.col("child_service_name").alias("callee_service"),
            "kind",
        )
    )


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy(F.col("callee_service").alias("service_name")).agg(
        F.count(F.lit(1)).alias("violations")
    )


def edge_gap_medians(pairs: DataFrame) -> DataFrame:
    """Per (window, caller, callee): calls and median child-minus-parent start."""
    gaps = pairs.select(
        "window_start",
        F.col("parent_service_name").alias("caller_service"),
        F.col("child_service_name").alias("callee_service"),
        (F.col("child_start_time_unix_nano") - F.col("parent_start_time_unix_nano")).alias("gap_ns"),
    )
    out = percentiles(gaps, ["window_start", "caller_service", "callee_service"], "gap_ns", [0.5])
    return out.withColumnRenamed("p0", "median_gap_ns")


def typical_gaps(gaps: DataFrame) -> DataFrame:
    """Per window the edge median nearest to zero (ties: value, then edge)."""
    order = F.struct(F.abs("median_gap_ns"), "median_gap_ns", "caller_service", "callee_service")
    return gaps.groupBy("window_start").agg(F.min_by("median_gap_ns", order).alias("typical_gap_ns"))


def primary_callers(gaps: DataFrame) -> DataFrame:
    """Per (window, callee) the caller with most calls (ties: smallest name)."""
    order = F.struct(-F.col("n"), F.col("caller_service"))
    return gaps.groupBy("window_start", "callee_service").agg(
        F.min_by(F.struct("caller_service", "n", "median_gap_ns"), order).alias("_p")
    ).select("window_start", "callee_service", "_p.*")


def clock_offsets(pairs: DataFrame, root_service: str = ROOT_SERVICE) -> DataFrame:
    """Offsets relative to the root service, all windows at once.

    Every service has one primary caller, so a window is a forest of service
    links; offsets flow down it from the root, rounded half-even at each hop.
    The tables here have one row per (window, service).
    """
    gaps = checkpoint(edge_gap_medians(pairs))
    return offsets_from_gaps(gaps, root_service)


def offsets_from_gaps(gaps: DataFrame, root_service: str = ROOT_SERVICE) -> DataFrame:
    """One recursive query walks down from the root of every window at once.

    A service has one primary caller, so each is met once and a ring of services that
    the root does not reach is never entered.
    """
    links = primary_callers(gaps).join(typical_gaps(gaps), "window_start")
    links = links.filter((F.col("callee_service") != root_service) & (F.col("caller_service") != F.col("callee_service"))).select(
        "window_start",
        F.col("callee_service").alias("service_name"),
        "caller_service",
        (F.col("median_gap_ns") - F.col("typical_gap_ns")).alias("delta_ns"),
        F.col("n").alias("confidence"),
    )
    spark = configure(gaps.sparkSession)
    return spark.sql(
        """
        WITH RECURSIVE known (window_start, service_name, offset_ns, confidence) AS (
          SELECT DISTINCT window_start, :root AS service_name, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {gaps}
          UNION ALL
          SELECT l.window_start, l.service_name, CAST(bround(CAST(k.offset_ns AS DOUBLE) + l.delta_ns, 0) AS BIGINT), l.confidence
          FROM known k JOIN {links} l ON l.window_start = k.window_start AND l.caller_service = k.service_name
        )
        SELECT * FROM known
        """,
        args={"root": root_service},
        gaps=gaps,
        links=checkpoint(links),
    )
