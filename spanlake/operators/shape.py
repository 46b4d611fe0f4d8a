"""Shape of traces and of the call graph, for display and drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.incidents import severity_rank, topology_edges
from spanlake.operators.reassembly import SCOPE, internal_spans, span_seeds
from spanlake.schemas import WINDOW_SECONDS
from spanlake.session import checkpoint

MAX_DEPTH = 8  # fixed value: deeper spans are folded into a placeholder
MIN_WIDTH = 0.001
MIN_CONFIDENCE = 30
MIN_SKEW_NS = 1_000_000
EXAMPLE_TRACES = 5


def whole_traces(spans: DataFrame) -> DataFrame:
    """Link spans over the whole trace rather than within a window."""
    return spans.withColumn("window_start", F.lit(0).cast("bigint"))


def span_tree(spans: DataFrame) -> DataFrame:
    """Depth of every span below its root or orphan; spans of cycles are left out."""
    seeds = span_seeds(whole_traces(spans)).filter("seed IS NOT NULL")
    return seeds.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        F.col("dist").alias("depth"),
        (F.col("kind") == "orphan").alias("is_orphan"),
        (F.col("seed_kind") == "orphan").alias("in_orphan_subtree"),
    )


def trace_bounds(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(
        F.min("start_time_unix_nano").alias("start_ns"), F.max("end_time_unix_nano").alias("end_ns")
    )


def span_fraction(spans: DataFrame) -> DataFrame:
    """Where a span's bar starts and how wide it is, as fractions of the trace."""
    total = F.col("end_ns") - F.col("start_ns")
    own = F.col("end_time_unix_nano") - F.col("start_time_unix_nano")
    flat = total <= 0
    return spans.join(trace_bounds(spans), "trace_id").select(
        "trace_id",
        "span_id",
        F.when(flat, 0.0).otherwise((F.col("start_time_unix_nano") - F.col("start_ns")) / total).alias("left"),
        F.when(flat, 1.0).otherwise(F.greatest(own / total, F.lit(MIN_WIDTH))).alias("width"),
    )


def subtree_sizes(spans: DataFrame) -> DataFrame:
    """Descendants of every span that is not part of, or below, a cycle.

    Pointer doubling upwards: after round i a span knows how many spans lie
    less than 2**i links below it, and asks the ones exactly 2**i below for
    theirs. Only internal spans take part (leaves are counted by their parent),
    and no ancestor-descendant pairs are produced.
    """
    links = checkpoint(span_seeds(whole_traces(spans)).filter("seed IS NOT NULL"))
    state = checkpoint(
        internal_spans(links).select(
            *SCOPE,
            "span_id",
            F.when(F.col("kind") == "linked", F.col("parent_span_id")).alias("ptr"),
            F.col("child_count").alias("size"),
        )
    )
    while not state.filter("ptr IS NOT NULL").isEmpty():
        below = (
            state.filter("ptr IS NOT NULL")
            .groupBy(*SCOPE, F.col("ptr").alias("span_id"))
            .agg(F.sum("size").alias("_more"))
        )
        jump = state.select(*SCOPE, F.col("span_id").alias("ptr"), F.col("ptr").alias("_next"))
        state = checkpoint(
            state.join(below, [*SCOPE, "span_id"], "left")
            .join(jump, [*SCOPE, "ptr"], "left")
            .select(
                *SCOPE,
                "span_id",
                F.col("_next").alias("ptr"),
                (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"),
            )
        )
    sizes = state.select(*SCOPE, "span_id", "size")
    size = F.coalesce("size", F.lit(0)).cast("bigint")
    return links.join(sizes, [*SCOPE, "span_id"], "left").select(
        "trace_id",
        "span_id",
        F.col("dist").alias("depth"),
        size.alias("descendants"),
        F.when(F.col("dist") == MAX_DEPTH, size).otherwise(0).cast("bigint").alias("hidden_descendants"),
    )


def service_depths(edges: DataFrame) -> DataFrame:
    """Hops from the services nobody calls; unreachable services have no row."""
    graph = checkpoint(topology_edges(edges))
    callees = graph.select(F.col("callee_service").alias("service")).distinct()
    frontier = (
        graph.select(F.col("caller_service").alias("service"))
        .distinct()
        .join(callees, "service", "left_anti")
        .withColumn("depth", F.lit(0).cast("bigint"))
    )
    depths = frontier = checkpoint(frontier)
    while not frontier.isEmpty():
        frontier = checkpoint(
            graph.join(frontier.withColumnRenamed("service", "caller_service"), "caller_service")
            .groupBy(F.col("callee_service").alias("service"))
            .agg((F.min("depth") + 1).alias("depth"))
            .join(depths, "service", "left_anti")
        )
        depths = depths.unionByName(frontier)
    return depths


def worst_incident_per_service(incidents: DataFrame) -> DataFrame:
    """Highest severity per service; among equals the newest incident."""
    order = F.struct(severity_rank("peak_severity"), F.col("start_window"), F.col("incident_id"))
    return (
        incidents.filter("target_type = 'service'")
        .groupBy("target")
        .agg(F.max_by(F.struct(F.col("peak_severity").alias("severity"), "derived", "incident_id"), order).alias("_w"))
        .select("target", "_w.*")
    )


def offsets_by_window(offsets: DataFrame, spine: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Each service's latest offset as of every window (one row per window and service).

    Turns the as-of lookup of any number of spans into an equi-join.
    """
    series = Window.partitionBy("service_name").orderBy("window_start")
    last = spine.agg(F.max("window_start")).scalar()
    spread = offsets.withColumn("_next", F.lead("window_start").over(series) - window_seconds).withColumn(
        "_until", F.greatest(F.coalesce("_next", last), F.col("window_start"))
    )
    step = F.lit(window_seconds).cast("bigint")
    return spread.select(
        F.explode(F.sequence("window_start", "_until", step)).alias("as_of"),
        "service_name",
        "offset_ns",
        "confidence",
    )


def skewed_spans(spans: DataFrame, offsets: DataFrame, spine: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Spans whose service had a trusted offset above 1 ms when the trace began."""
    begin = spans.groupBy("trace_id").agg(F.min("start_time_unix_nano").alias("start_ns"))
    second = F.call_function("div", F.col("start_ns"), F.lit(1_000_000_000).cast("bigint"))
    begin = begin.select("trace_id", (second - F.pmod(second, F.lit(window_seconds))).alias("as_of"))
    trusted = offsets_by_window(offsets, spine, window_seconds).filter(
        (F.col("confidence") >= MIN_CONFIDENCE) & (F.abs("offset_ns") > MIN_SKEW_NS)
    )
    return (
        spans.select("trace_id", "span_id", "service_name")
        .join(begin, "trace_id")
        .join(trusted, ["as_of", "service_name"])
        .select("trace_id", "span_id", "service_name", "offset_ns", "confidence")
    )


def incident_example_traces(
    incidents: DataFrame, summaries: DataFrame, window_seconds: int = WINDOW_SECONDS, count: int = EXAMPLE_TRACES
) -> DataFrame:
    """The newest traces in each incident's range of windows.

    A window's own top traces are cut first (Spark prunes them before the
    shuffle), so incidents never meet whole windows of traces.
    """
    per_window = Window.partitionBy("window_start").orderBy("trace_id")
    top = (
        summaries.select("window_start", "trace_id")
        .withColumn("_n", F.row_number().over(per_window))
        .filter(F.col("_n") <= count)
        .drop("_n")
    )
    covered = incidents.select(
        "incident_id",
        F.explode(F.sequence("start_window", "end_window", F.lit(window_seconds).cast("bigint"))).alias("window_start"),
    )
    per_incident = Window.partitionBy("incident_id").orderBy(F.desc("window_start"), "trace_id")
    return (
        covered.join(top, "window_start")
        .withColumn("position", F.row_number().over(per_incident).cast("int"))
        .filter(F.col("position") <= count)
        .select("incident_id", "position", "window_start", "trace_id")
    )
