"""Trace reassembly: parent links, reachability, classification, summaries.

All traces and windows at once; nothing collects a trace. Reachability and
depth come from pointer doubling over the *internal* spans (those with
children): log2(depth) joins on (trace_id, window_start, span_id). A hot
parent or a giant trace only makes one side of such a join skewed, and AQE
splits it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.session import checkpoint

SCOPE = ["trace_id", "window_start"]
_PAIR_COLUMNS = ["span_id", "service_name", "start_time_unix_nano", "end_time_unix_nano", "status_code"]


def resolved_pairs(spans: DataFrame, within_window: bool = True) -> DataFrame:
    """(parent, child) rows for every parent link that resolves in scope.

    Pairs inside cycles and self-parents are included. Roots are dropped before
    the join, so the empty parent id is never a hot key.
    """
    scope = SCOPE if within_window else ["trace_id"]
    carry = [c for c in ("window_start",) if not within_window and c in spans.columns]
    child = spans.filter("parent_span_id <> ''").select(
        *scope,
        F.col("parent_span_id").alias("parent_id"),
        *[F.col(c).alias(f"child_{c}") for c in [*_PAIR_COLUMNS, *carry]],
    )
    parent = spans.select(
        *scope,
        F.col("span_id").alias("parent_id"),
        *[F.col(c).alias(f"parent_{c}") for c in [*_PAIR_COLUMNS[1:], *carry]],
    )
    return child.join(parent, [*scope, "parent_id"]).withColumnRenamed("parent_id", "parent_span_id")


def parent_links(spans: DataFrame) -> DataFrame:
    """Every non-root span with its parent in the trace, NULLs where there is none.

    One outer join that both the pairs of either scope and the kinds of links
    can be read from.
    """
    child = spans.filter("parent_span_id <> ''").select(
        "trace_id",
        "window_start",
        F.col("parent_span_id").alias("parent_id"),
        *[F.col(c).alias(f"child_{c}") for c in _PAIR_COLUMNS],
    )
    parent = spans.select(
        "trace_id",
        F.col("span_id").alias("parent_id"),
        F.col("window_start").alias("parent_window_start"),
        *[F.col(c).alias(f"parent_{c}") for c in _PAIR_COLUMNS[1:]],
    )
    return child.join(parent, ["trace_id", "parent_id"], "left").withColumnRenamed("parent_id", "parent_span_id")


def pairs_of_links(links: DataFrame) -> DataFrame:
    """The resolved pairs of a trace, of any window."""
    return links.filter("parent_window_start IS NOT NULL")


def link_kinds(spans: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Each span with ``kind``: root, orphan or linked (within its window)."""
    slim = spans.select(*SCOPE, "span_id", "parent_span_id", "service_name", "start_time_unix_nano")
    roots = slim.filter("parent_span_id = ''").withColumn("kind", F.lit("root"))
    if links is not None:
        here = F.col("parent_window_start") == F.col("window_start")
        rest = links.select(
            *SCOPE,
            F.col("child_span_id").alias("span_id"),
            "parent_span_id",
            F.col("child_service_name").alias("service_name"),
            F.col("child_start_time_unix_nano").alias("start_time_unix_nano"),
            F.when(here, "linked").otherwise("orphan").alias("kind"),
        )
        return roots.unionByName(rest)
    parents = slim.select(*SCOPE, F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_found"))
    rest = (
        slim.filter("parent_span_id <> ''")
        .join(parents, [*SCOPE, "parent_span_id"], "left")
        .withColumn("kind", F.when(F.col("_found"), "linked").otherwise("orphan"))
    )
    return roots.unionByName(rest.select(*roots.columns))


def root_detect(spans: DataFrame) -> DataFrame:
    return spans.filter("parent_span_id = ''")


def orphan_detect(spans: DataFrame) -> DataFrame:
    """Spans whose parent is set but absent from the trace's window."""
    parents = spans.select(*SCOPE, F.col("span_id").alias("parent_span_id"))
    return spans.filter("parent_span_id <> ''").join(parents, [*SCOPE, "parent_span_id"], "left_anti")


def internal_spans(links: DataFrame) -> DataFrame:
    """The spans that are some span's parent, with their number of direct children."""
    children = (
        links.filter("kind = 'linked'")
        .groupBy(*SCOPE, F.col("parent_span_id").alias("span_id"))
        .agg(F.count(F.lit(1)).alias("child_count"))
    )
    return links.join(children, [*SCOPE, "span_id"])


def _double(nodes: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distance to, and id of, the seed of every internal span that has one.

    ``ptr`` jumps 2**i links up; a span is done when its pointer has met a
    seed. A round that finishes no span proves the rest hang off cycles. Only
    spans still open are joined and written again, by ``keep``; what is done stays as it is.
    """
    linked = F.col("kind") == "linked"
    state = keep(
        nodes.select(
            *SCOPE,
            "span_id",
            F.when(linked, F.col("parent_span_id")).alias("ptr"),
            F.when(linked, 1).otherwise(0).cast("bigint").alias("dist"),
            F.when(~linked, F.col("span_id")).alias("seed"),
            F.when(~linked, F.col("kind")).alias("seed_kind"),
        )
    )
    done, pending = state.filter("seed IS NOT NULL"), state.filter("seed IS NULL")
    open_before = pending.count()
    while open_before:
        target = done.unionByName(pending).select(
            *SCOPE,
            F.col("span_id").alias("ptr"),
            F.col("ptr").alias("_ptr"),
            F.col("dist").alias("_dist"),
            F.col("seed").alias("_seed"),
            F.col("seed_kind").alias("_kind"),
        )
        moved = keep(
            pending.join(target, [*SCOPE, "ptr"], "left").select(
                *SCOPE,
                "span_id",
                F.col("_ptr").alias("ptr"),
                (F.col("dist") + F.col("_dist")).alias("dist"),
                F.col("_seed").alias("seed"),
                F.col("_kind").alias("seed_kind"),
            )
        )
        done, pending = done.unionByName(moved.filter("seed IS NOT NULL")), moved.filter("seed IS NULL")
        open_now = pending.count()
        if open_now == open_before:
            break
        open_before = open_now
    return done.select(*SCOPE, "span_id", "seed", "seed_kind", "dist")


def span_seeds(spans: DataFrame, links: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """Each span with its kind, ``seed`` (root or orphan it hangs off) and distance.

    ``seed`` is NULL exactly for spans that reach neither: cycles and whatever
    hangs off them. ``keep`` stores what a round found; one that keeps tables bucketed
    by trace saves the rounds their shuffles.
    """
    # Given links are a written table already; the join is not worth redoing per use.
    links = link_kinds(spans, links) if links is not None else checkpoint(link_kinds(spans))
    reached = _double(internal_spans(links), keep).select(
        *SCOPE, F.col("span_id").alias("parent_span_id"), "seed", "seed_kind", (F.col("dist") + 1).alias("dist")
    )
    seeds = links.filter("kind <> 'linked'").withColumns(
        {"seed": F.col("span_id"), "seed_kind": F.col("kind"), "dist": F.lit(0).cast("bigint")}
    )
    rest = links.filter("kind = 'linked'").join(reached, [*SCOPE, "parent_span_id"], "left")
    return seeds.unionByName(rest.select(*seeds.columns))


def _classification() -> Column:
    return (
        F.when(F.col("kind") == "orphan", "orphan_missing_parent")
        .when(F.col("seed").isNull(), "cycle_rejected")
        .otherwise("ok")
    )


def classify(seeds: DataFrame) -> DataFrame:
    return seeds.select("trace_id", "span_id", "window_start", _classification().alias("classification"))


def canonical_roots(spans: DataFrame) -> DataFrame:
    """The earliest root per trace and window (ties by span id)."""
    order = F.struct("start_time_unix_nano", "span_id")
    return root_detect(spans).groupBy(*SCOPE).agg(
        F.min_by("span_id", order).alias("root_span_id"),
        F.min_by("service_name", order).alias("root_service"),
    )


def summarize(seeds: DataFrame) -> DataFrame:
    """One summary per trace and window."""
    own = F.col("seed") == F.col("span_id")
    by_seed = seeds.groupBy(*SCOPE, "seed").agg(
        F.count(F.lit(1)).alias("spans"),
        F.max("dist").alias("far"),
        F.max(F.when(own, F.col("kind"))).alias("kind"),
        F.max(F.when(own, F.col("service_name"))).alias("service"),
        F.max(F.when(own, F.col("start_time_unix_nano"))).alias("start"),
    )
    root = F.col("kind") == "root"
    order = F.when(root, F.struct("start", "seed"))
    out = by_seed.groupBy(*SCOPE).agg(
        F.coalesce(F.min_by(F.col("far") + 1, order), F.lit(0)).cast("int").alias("depth"),
        F.sum("spans").alias("span_count"),
        F.coalesce(F.min_by("service", order), F.lit("")).alias("root_service"),
        F.count_if(root).alias("_roots"),
        F.count_if(F.col("kind") == "orphan").alias("orphan_count"),
        F.coalesce(F.sum(F.when(F.col("seed").isNull(), F.col("spans"))), F.lit(0)).alias("_cyclic"),
    )
    reason = (
        F.when(F.col("_roots") == 0, "missing_root")
        .when(F.col("_roots") > 1, "multiple_roots")
        .when(F.col("orphan_count") > 0, "orphan_missing_parent")
        .when(F.col("_cyclic") > 0, "cycle_rejected")
        .otherwise("")
    )
    return out.withColumn("incompleteness_reason", reason).select(
        *SCOPE,
        "depth",
        "span_count",
        "root_service",
        (F.col("incompleteness_reason") == "").alias("complete"),
        "incompleteness_reason",
        "orphan_count",
    )


def reassemble(spans: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summaries, classifications) of all traces in all windows."""
    seeds = checkpoint(span_seeds(spans, links))
    return summarize(seeds), classify(seeds)


def reassembly_counters(summaries: DataFrame, classifications: DataFrame) -> DataFrame:
    """Traces processed, incomplete traces by reason, non-ok spans by class."""
    total = summaries.agg(
        F.lit("traces_processed").alias("metric"), F.lit("").alias("label"), F.count(F.lit(1)).alias("value")
    )
    incomplete = summaries.filter("NOT complete").groupBy(F.col("incompleteness_reason").alias("label"))
    classes = classifications.filter("classification <> 'ok'").groupBy(F.col("classification").alias("label"))
    parts = [
        g.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "label", "value")
        for name, g in (("incomplete_traces", incomplete), ("orphan_spans", classes))
    ]
    return total.unionByName(parts[0]).unionByName(parts[1])
