"""Ground truth of a run: what was sent, who called whom, which incidents held."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.columns import floor_to, int_div
from spanlake.schemas import NS


def ground_truth_spans(sent: DataFrame) -> DataFrame:
    """``sent`` holds run_id, trace_id, span_id, parent_span_id, service_name, generated_at."""
    return sent.select("run_id", "trace_id", "span_id", "parent_span_id", "service_name", "generated_at")


def ground_truth_edges(gt_spans: DataFrame) -> DataFrame:
    """One row per call: a non-root span whose parent was sent in the same trace."""
    parent = gt_spans.select(
        "run_id",
        "trace_id",
        F.col("span_id").alias("parent_span_id"),
        F.col("service_name").alias("caller_service"),
    )
    child = gt_spans.filter("parent_span_id <> ''").withColumnRenamed("service_name", "callee_service")
    return child.join(parent, ["run_id", "trace_id", "parent_span_id"]).select(
        "run_id", "trace_id", "caller_service", "callee_service", "generated_at"
    )


CELL_SECONDS = 60
TARGET = ["target_service", "target_caller", "target_callee"]


def _cells(start, end):
    """The cells of time that [start, end) touches."""
    first, last = (F.floor(c / CELL_SECONDS).cast("bigint") for c in (start, end))
    last = F.when(end > last * CELL_SECONDS, last).otherwise(last - 1)
    return F.explode(F.sequence(first, F.greatest(first, last)))


def incident_segments(specs: DataFrame, run_start: int) -> DataFrame:
    """Composed effect of the configured incidents on each target over time.

    The boundaries of a target's incidents cut its time into segments without
    overlap, so a span falls into at most one of them. Errors take the largest
    magnitude, latency factors multiply, traffic keeps the product of the
    remaining shares, and a disappearance leaves none.

    Segments meet the incidents that hold at their start by target and cell of time:
    an equi-join that grows with the incidents' duration, not with their number squared.
    """
    incidents = specs.select(
        *TARGET,
        "type",
        "magnitude",
        (F.col("start_offset_s") + run_start).cast("double").alias("start"),
        (F.col("start_offset_s") + F.col("duration_s") + run_start).cast("double").alias("end"),
    ).filter("start < end")
    cuts = incidents.select(*TARGET, F.col("start").alias("segment_start")).union(incidents.select(*TARGET, "end")).distinct()
    # One small row per boundary of a target.
    following = F.lead("segment_start").over(Window.partitionBy(*TARGET).orderBy("segment_start"))
    segments = cuts.withColumn("segment_end", following).filter("segment_end IS NOT NULL")
    segments = segments.withColumn("cell", F.floor(F.col("segment_start") / CELL_SECONDS).cast("bigint"))
    held = incidents.withColumn("cell", _cells(F.col("start"), F.col("end")))
    hit = segments.join(held, [*TARGET, "cell"]).filter("start <= segment_start AND segment_start < end")

    def product(kind: str, term):
        return F.coalesce(F.product(F.when(F.col("type") == kind, term)), F.lit(1.0))

    magnitude = F.col("magnitude")
    return hit.groupBy(*TARGET, "segment_start", "segment_end").agg(
        F.coalesce(F.max(F.when(F.col("type") == "error_burst", magnitude)), F.lit(0.0)).alias("error_probability"),
        product("latency_spike", magnitude).alias("spike_factor"),
        product("latency_tail", magnitude).alias("tail_factor"),
        F.when(F.count_if(F.col("type") == "edge_disappearance") > 0, 0.0)
        .otherwise(product("throughput_drop", 1 - magnitude))
        .alias("traffic_share"),
    )


def _in_effect(rows: DataFrame, at: str, segments: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows joined with the segment of their target (``keys``: its column to theirs) that holds at ``at``."""
    cells = segments.select(
        *[F.col(own).alias(theirs) for own, theirs in keys.items()],
        (F.col("segment_start") * 1e9).cast("bigint").alias("_a"),
        (F.col("segment_end") * 1e9).cast("bigint").alias("_b"),
        *[c for c in segments.columns if c not in (*TARGET, "segment_start", "segment_end")],
        _cells(F.col("segment_start"), F.col("segment_end")).alias("_cell"),
    )
    placed = rows.withColumn("_cell", int_div(floor_to(F.col(at), CELL_SECONDS * NS), CELL_SECONDS * NS))
    near = placed.join(cells, [*keys.values(), "_cell"])
    return near.filter((F.col(at) >= F.col("_a")) & (F.col(at) < F.col("_b"))).drop("_a", "_b", "_cell")


def active_incidents(spans: DataFrame, specs: DataFrame, run_start: int) -> DataFrame:
    """Spans of a targeted service with the incidents in effect at their start."""
    segments = incident_segments(specs, run_start).filter("target_service <> ''").drop("traffic_share")
    rows = spans.select("trace_id", "span_id", "service_name", "start_time_unix_nano")
    out = _in_effect(rows, "start_time_unix_nano", segments, {"target_service": "service_name"})
    return out.select(*rows.columns, "error_probability", "spike_factor", "tail_factor")


def active_edge_incidents(pairs: DataFrame, specs: DataFrame, run_start: int) -> DataFrame:
    """Calls on a targeted edge with the share of traffic that remains."""
    segments = incident_segments(specs, run_start).filter("target_service = ''")
    keys = {"target_caller": "parent_service_name", "target_callee": "child_service_name"}
    out = _in_effect(pairs, "child_start_time_unix_nano", segments, keys)
    return out.select("trace_id", "child_span_id", "parent_service_name", "child_service_name", "traffic_share")
