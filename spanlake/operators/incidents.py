"""Grouping detections into incidents and attributing echoes to a root cause."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.aggregates import TARGET
from spanlake.operators.dedup import latest_version
from spanlake.schemas import GROUPING_LOOKBACK_SECONDS, WINDOW_SECONDS
from spanlake.session import checkpoint

KEY = [*TARGET, "target", "detector"]


def severity_rank(col: str = "severity") -> Column:
    return F.when(F.col(col) == "critical", 2).when(F.col(col) == "warning", 1).otherwise(0)


def recent_detections(detections: DataFrame, low: float, high: float) -> DataFrame:
    """Detections with low <= window_start <= high, both ends included."""
    return detections.filter(F.col("window_start").between(low, high))


def peak_order() -> Column:
    """Highest severity, then largest deviation either way, then earliest window."""
    return F.struct(severity_rank(), F.abs("deviation"), -F.col("window_start"))


def group_detections(
    detections: DataFrame, window_seconds: int = WINDOW_SECONDS, by: Sequence[str] = ()
) -> DataFrame:
    """Back-to-back detections of one target and detector become one incident.

    A partition of the window function holds one row per window of a single
    target, so its size follows the time covered, not the traffic.
    """
    key = [*by, *KEY]
    ordered = Window.partitionBy(*key).orderBy("window_start")
    gap = F.col("window_start") - F.lag("window_start").over(ordered)
    runs = detections.withColumn("_new", F.when(gap <= window_seconds, 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(ordered)
    )
    out = runs.groupBy(*key, "_run").agg(
        F.min("window_start").alias("start_window"),
        F.max("window_start").alias("end_window"),
        F.count(F.lit(1)).alias("window_count"),
        F.max_by(F.struct("severity", "deviation"), peak_order()).alias("_peak"),
    )
    incident_id = F.format_string(
        "%s:%s:%s:%d", F.col("target_type"), F.col("target"), F.col("detector"), F.col("start_window")
    )
    return out.select(
        *by,
        incident_id.alias("incident_id"),
        *KEY,
        "start_window",
        "end_window",
        "window_count",
        F.col("_peak.severity").alias("peak_severity"),
        F.col("_peak.deviation").alias("peak_deviation"),
    )


def topology_edges(edges: DataFrame) -> DataFrame:
    """All-time distinct (caller, callee)."""
    return edges.select("caller_service", "callee_service").distinct()


def _latest_per_key(incidents: DataFrame, by: Sequence[str]) -> DataFrame:
    """Only the latest incident of a target and detector can be linked."""
    key = [*by, *KEY]
    rest = [c for c in incidents.columns if c not in key]
    return incidents.groupBy(*key).agg(F.max_by(F.struct(*rest), "start_window").alias("_i")).select(*key, "_i.*")


def incident_overlap(
    left: DataFrame, right: DataFrame, on: Sequence[str], window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Pairs of incidents equal on ``on`` whose closed window ranges overlap.

    Overlapping ranges share the later of their two starts, so joining on that
    one window yields each overlapping pair once and no other pair.
    """
    step = F.lit(window_seconds).cast("bigint")
    covered = lambda: F.explode(F.sequence("start_window", "end_window", step)).alias("_w")
    mine = left.select("*", covered())
    other = right.select(
        *on,
        F.col("incident_id").alias("other_id"),
        F.col("target").alias("other_target"),
        F.col("start_window").alias("_os"),
        covered(),
    )
    first_shared = F.col("_w") == F.greatest("start_window", "_os")
    return mine.join(other, [*on, "_w"]).filter(first_shared).drop("_os", "_w")


def service_roots(incidents: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, incident_id, root_id) for the latest service incidents.

    An incident follows its service's callees to overlapping incidents of the
    same detector, down to the ones with no affected callee; of several ends
    the smallest label wins. Incidents are settled from the ends upwards, one
    round per level. What is left then reaches a call cycle and is settled by
    following the paths inside those cycles.
    """
    by = list(by)
    nodes = _latest_per_key(incidents.filter("target_type = 'service'"), by).select(
        *by, "detector", F.col("callee").alias("service"), "incident_id", "start_window", "end_window"
    )
    below = nodes.select(
        *by,
        "detector",
        F.col("service").alias("callee_service"),
        F.col("incident_id").alias("down_id"),
        F.col("start_window").alias("_ds"),
        F.col("end_window").alias("_de"),
    )
    links = checkpoint(
        nodes.join(topology_edges(edges).withColumnRenamed("caller_service", "service"), "service")
        .join(below, [*by, "detector", "callee_service"])
        .filter((F.col("start_window") <= F.col("_de")) & (F.col("_ds") <= F.col("end_window")))
        .select(*by, "incident_id", "down_id")
    )
    loops = links.filter("incident_id = down_id").select(*by, "incident_id", F.lit(True).alias("_loop"))
    links = links.filter("incident_id <> down_id")
    # root: NULL until settled, then (label, incident id), ordered by label.
    state = checkpoint(
        nodes.join(loops, [*by, "incident_id"], "left")
        .join(links.select(*by, "incident_id", F.lit(True).alias("_calls")).distinct(), [*by, "incident_id"], "left")
        .select(
            *by,
            "incident_id",
            F.struct(F.col("service").alias("label"), F.col("incident_id").alias("id")).alias("self"),
            F.coalesce("_loop", F.lit(False)).alias("loop"),
            F.when(F.col("_calls").isNull(), F.struct(F.col("service").alias("label"), F.col("incident_id").alias("id"))).alias("root"),
        )
    )
    open_before = state.filter("root IS NULL").count()
    while open_before:
        known = state.select(*by, F.col("incident_id").alias("down_id"), F.col("root").alias("_root"))
        settled = (
            links.join(known, [*by, "down_id"])
            .groupBy(*by, "incident_id")
            .agg(F.min("_root").alias("_root"), F.count_if(F.col("_root").isNull()).alias("_open"))
            .filter("_open = 0")
        )
        # least() skips NULLs, so an unsettled incident must be kept out of it.
        end = F.when(F.col("loop"), F.least("_root", "self")).otherwise(F.col("_root"))
        found = F.when(F.col("_root").isNotNull(), end)
        state = checkpoint(
            state.join(settled, [*by, "incident_id"], "left").select(
                *by, "incident_id", "self", "loop", F.coalesce("root", found).alias("root")
            )
        )
        open_now = state.filter("root IS NULL").count()
        if open_now == open_before:
            break
        open_before = open_now
    if open_before:
        state = _settle_cycles(state, links, by)
    return state.select(*by, "incident_id", F.col("root.id").alias("root_id"), F.col("root.label").alias("root_target"))


def _settle_cycles(state: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Roots of incidents that reach a call cycle.

    A path ends where it meets one of its own incidents (which then is the
    end) or a settled incident (whose root is the end). Two paths of one
    origin that stand at the same incident with the same set behind them
    continue alike, so only one is kept.
    """
    looped = state.filter("loop").select(*by, "incident_id", F.col("incident_id").alias("down_id"))
    target = state.select(
        *by, F.col("incident_id").alias("down_id"), F.col("self").alias("_self"), F.col("root").alias("_root")
    )
    steps = checkpoint(
        state.filter("root IS NULL")
        .select(*by, "incident_id")
        .join(links.unionByName(looped), [*by, "incident_id"])
        .join(target, [*by, "down_id"])
        .select(*by, F.col("incident_id").alias("at"), "down_id", "_self", "_root")
    )
    paths = checkpoint(
        state.filter("root IS NULL").select(
            *by, F.col("incident_id").alias("origin"), F.col("incident_id").alias("at"), F.array("incident_id").alias("seen")
        )
    )
    ends = None
    while not paths.isEmpty():
        moved = checkpoint(paths.join(steps, [*by, "at"]))
        back = F.array_contains("seen", F.col("down_id"))
        stop = moved.filter(back | F.col("_root").isNotNull()).groupBy(*by, "origin").agg(
            F.min(F.when(back, F.col("_self")).otherwise(F.col("_root"))).alias("_end")
        )
        ends = stop if ends is None else ends.unionByName(stop)
        paths = checkpoint(
            moved.filter(~back & F.col("_root").isNull())
            .select(
                *by,
                "origin",
                F.col("down_id").alias("at"),
                F.array_sort(F.array_append("seen", F.col("down_id"))).alias("seen"),
            )
            .distinct()
        )
    best = ends.groupBy(*by, F.col("origin").alias("incident_id")).agg(F.min("_end").alias("_end"))
    return state.join(best, [*by, "incident_id"], "left").select(
        *by, "incident_id", "self", "loop", F.coalesce("root", "_end").alias("root")
    )


def suppress_propagated(incidents: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mark incidents that echo a deeper one as derived, naming its id."""
    by = list(by)
    roots = checkpoint(service_roots(incidents, edges, by))
    latest = _latest_per_key(incidents, by)
    service = latest.filter("target_type = 'service'")
    own = service.join(roots, [*by, "incident_id"]).filter("root_id <> incident_id").select(
        *by, "incident_id", "root_id"
    )
    callee = service.select(
        *by,
        "detector",
        "callee",
        F.col("incident_id").alias("_callee_id"),
        F.col("start_window").alias("_cs"),
        F.col("end_window").alias("_ce"),
    )
    via_callee = (
        latest.filter("target_type = 'edge'")
        .join(callee, [*by, "detector", "callee"])
        .filter((F.col("start_window") <= F.col("_ce")) & (F.col("_cs") <= F.col("end_window")))
        .select(*by, "incident_id", "_callee_id")
        .join(roots.withColumnRenamed("incident_id", "_callee_id"), [*by, "_callee_id"])
        .select(*by, "incident_id", "root_id")
    )
    marks = own.unionByName(via_callee)
    return incidents.join(marks, [*by, "incident_id"], "left").select(
        *incidents.columns,
        F.col("root_id").isNotNull().alias("derived"),
        F.coalesce("root_id", F.lit("")).alias("root_cause_incident_id"),
    )


def rolling_incidents(
    detections: DataFrame,
    edges: DataFrame,
    spine: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    lookback_seconds: int = GROUPING_LOOKBACK_SECONDS,
) -> DataFrame:
    """What each window's regrouping of its trailing detections yields (by ``as_of``)."""
    steps = lookback_seconds // window_seconds
    offsets = F.array(*[F.lit(i * window_seconds).cast("bigint") for i in range(steps + 1)])
    fanned = (
        detections.withColumn("_o", F.explode(offsets))
        .withColumn("as_of", F.col("window_start") + F.col("_o"))
        .drop("_o")
        .join(spine.select(F.col("window_start").alias("as_of")), "as_of", "left_semi")
    )
    grouped = checkpoint(group_detections(fanned, window_seconds, ["as_of"]))
    return suppress_propagated(grouped, edges, ["as_of"])


def rolling_regroup(
    detections: DataFrame,
    edges: DataFrame,
    spine: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    lookback_seconds: int = GROUPING_LOOKBACK_SECONDS,
) -> DataFrame:
    """Incidents upserted by id, window after window; the last write stays.

    An incident longer than the lookback gets new ids as its start slides out.
    """
    rolled = rolling_incidents(detections, edges, spine, window_seconds, lookback_seconds)
    return latest_version(rolled, ["incident_id"], "as_of").drop("as_of")


def incident_counters(rolled: DataFrame, detections: DataFrame) -> DataFrame:
    """Per window: incidents still open, and own detections of derived targets."""
    still_open = rolled.filter("end_window = as_of").groupBy("as_of").agg(F.count(F.lit(1)).alias("incidents_open"))
    keys = ["target_type", "target", "detector"]
    derived = rolled.filter("derived").select("as_of", *keys).distinct()
    own = detections.withColumnRenamed("window_start", "as_of").select("as_of", *keys)
    suppressed = own.join(derived, ["as_of", *keys], "left_semi").groupBy("as_of").agg(
        F.count(F.lit(1)).alias("suppressed_count")
    )
    zero = F.lit(0).cast("bigint")
    return still_open.join(suppressed, "as_of", "full").select(
        F.col("as_of").alias("window_start"),
        F.coalesce("incidents_open", zero).alias("incidents_open"),
        F.coalesce("suppressed_count", zero).alias("suppressed_count"),
    )
