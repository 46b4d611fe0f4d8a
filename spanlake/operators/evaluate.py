"""Accuracy of the derived tables against ground truth, for all runs at once.

Every metric is keyed by run_id. NULL means undefined, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.columns import int_div, safe_ratio
from spanlake.operators.quantiles import percentiles
from spanlake.schemas import NS, WINDOW_SECONDS

MARGIN_SECONDS = 30
# Which detector is expected to catch which kind of incident.
DETECTOR_OF = {
    "latency_spike": "percentile_deviation",
    "latency_tail": "percentile_deviation",
    "error_burst": "error_rate",
    "throughput_drop": "call_rate",
    "edge_disappearance": "call_rate",
}


def _meets(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Closed intervals overlap."""
    return (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1))


def eval_run_range(gt_spans: DataFrame) -> DataFrame:
    """Time covered by a run: first and last generation, and both with a margin."""
    lo, hi = F.min("generated_at"), F.max("generated_at")
    margin = MARGIN_SECONDS * NS
    return gt_spans.groupBy("run_id").agg(
        lo.alias("lo_ns"), hi.alias("hi_ns"), (lo - margin).alias("from_ns"), (hi + margin).alias("to_ns")
    )


def run_windows(ranges: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(run_id, window_start): makes "in the run's time" an equi-join."""
    w = window_seconds * NS
    first = int_div(F.col("from_ns") + (w - 1) - F.pmod(F.col("from_ns") + (w - 1), F.lit(w)), NS)
    last = int_div(F.col("to_ns") - F.pmod("to_ns", F.lit(w)), NS)
    return (
        ranges.select("run_id", first.alias("a"), last.alias("z"))
        .filter("a <= z")
        .select("run_id", F.explode(F.sequence("a", "z", F.lit(window_seconds).cast("bigint"))).alias("window_start"))
    )


def run_traces(gt_spans: DataFrame) -> DataFrame:
    return gt_spans.select("run_id", "trace_id").distinct()


def eval_landed(gt_spans: DataFrame, spans: DataFrame) -> DataFrame:
    """Stored spans of the traces that belong to a run."""
    return spans.select("trace_id", "span_id").join(run_traces(gt_spans), "trace_id").select(
        "run_id", "trace_id", "span_id"
    )


def eval_classifications(gt_spans: DataFrame, classifications: DataFrame) -> DataFrame:
    return classifications.select("trace_id", "span_id", "classification").join(
        run_traces(gt_spans), "trace_id"
    ).select("run_id", "trace_id", "span_id", "classification")


def eval_edges_prf(gt_edges: DataFrame, edges: DataFrame, windows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the set of call edges."""
    pair = ["run_id", "caller_service", "callee_service"]
    true = gt_edges.select(*pair).distinct().withColumn("_true", F.lit(True))
    found = edges.join(windows, "window_start").select(*pair).distinct().withColumn("_found", F.lit(True))
    counts = true.join(found, pair, "full").groupBy("run_id").agg(
        F.count("_true").alias("true_edge_count"),
        F.count("_found").alias("found_edge_count"),
        F.count_if(F.col("_true") & F.col("_found")).alias("edge_true_positive_count"),
    )
    tp = F.col("edge_true_positive_count")
    p, r = F.col("edge_precision"), F.col("edge_recall")
    return counts.withColumns(
        {
            "edge_precision": safe_ratio(tp, F.col("found_edge_count"), 0.0),
            "edge_recall": safe_ratio(tp, F.col("true_edge_count"), 0.0),
        }
    ).withColumn("edge_f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def eval_attachment(gt_spans: DataFrame, landed: DataFrame, classes: DataFrame) -> DataFrame:
    """Landed non-root spans: attached where the parent landed, orphaned where not."""
    key = ["run_id", "trace_id", "span_id"]
    parent = landed.select("run_id", "trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_p"))
    rows = (
        gt_spans.filter("parent_span_id <> ''")
        .select(*key, "parent_span_id")
        .join(landed, key, "left_semi")
        .join(classes, key, "left")
        .join(parent, ["run_id", "trace_id", "parent_span_id"], "left")
    )
    here = F.col("_p").isNotNull()
    out = rows.groupBy("run_id").agg(
        F.count_if(here).alias("attachment_denominator"),
        F.count_if(here & (F.col("classification") == "ok")).alias("attachment_correct"),
        F.count_if(~here).alias("orphan_denominator"),
        F.count_if(~here & (F.col("classification") == "orphan_missing_parent")).alias("orphan_correct"),
    )
    return out.withColumns(
        {
            "attachment_accuracy": safe_ratio(F.col("attachment_correct"), F.col("attachment_denominator")),
            "orphan_accuracy": safe_ratio(F.col("orphan_correct"), F.col("orphan_denominator")),
        }
    )


def eval_clock_error(gt_offsets: DataFrame, offsets: DataFrame, windows: DataFrame) -> DataFrame:
    """Detected minus true offset; detected is the most confident one of the run."""
    best = (
        offsets.join(windows, "window_start")
        .groupBy("run_id", "service_name")
        .agg(F.max_by("offset_ns", F.struct("confidence", "window_start")).alias("detected_ns"))
    )
    return gt_offsets.select("run_id", "service_name", F.col("offset_ns").alias("true_ns")).join(
        best, ["run_id", "service_name"]
    ).withColumn("error_ns", F.col("detected_ns") - F.col("true_ns"))


def true_incidents(gt_incidents: DataFrame) -> DataFrame:
    """Ground-truth incidents with target type, label and expected detector."""
    on_edge = F.col("target_edge") != ""
    detector = F.create_map(*[F.lit(x) for pair in DETECTOR_OF.items() for x in pair])[F.col("type")]
    return gt_incidents.select(
        "run_id",
        "incident_id",
        "type",
        F.when(on_edge, "edge").otherwise("service").alias("target_type"),
        F.when(on_edge, F.col("target_edge")).otherwise(F.col("target_service")).alias("target"),
        detector.alias("detector"),
        "start_time",
        "end_time",
        "magnitude",
    )


def run_incidents(incidents: DataFrame, windows: DataFrame) -> DataFrame:
    """Analyzer incidents that start in the time of a run."""
    return incidents.join(windows.withColumnRenamed("window_start", "start_window"), "start_window")


def eval_incident_match(true: DataFrame, found: DataFrame) -> DataFrame:
    """Per true incident: detected or not, and the first matching window."""
    matches = (
        true.select("run_id", "incident_id", "target_type", "target", "detector", "start_time", "end_time")
        .join(
            found.select("run_id", "target_type", "target", "detector", "start_window", "end_window"),
            ["run_id", "target_type", "target", "detector"],
        )
        .filter(_meets("start_window", "end_window", "start_time", "end_time"))
        .groupBy("run_id", "incident_id")
        .agg(F.count(F.lit(1)).alias("matches"), F.min("start_window").alias("first_window"))
    )
    return true.join(matches, ["run_id", "incident_id"], "left").withColumns(
        {"matches": F.coalesce("matches", F.lit(0)).cast("bigint"), "detected": F.col("matches").isNotNull()}
    )


def eval_detection_latency(matched: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """From the onset to the close of the first matching window, at least 0."""
    delay = F.col("first_window") + window_seconds - F.col("start_time")
    return matched.withColumn(
        "detection_latency_seconds", F.when(F.col("detected"), F.greatest(F.lit(0.0), delay))
    )


def _cells(start: str, end: str, window_seconds: int) -> Column:
    cell = lambda c: F.floor(F.col(c) / window_seconds)
    return F.explode(F.sequence(cell(start), cell(end)))


def overlapping_any(found: DataFrame, true: DataFrame, window_seconds: int, on: dict[str, str] | None = None) -> DataFrame:
    """The found incidents that overlap some true incident of the run.

    Overlapping intervals share a window-sized cell, so the test is a semi-join
    on the cell with the exact condition on top; no pairs are produced.
    """
    on = on or {}
    t = true.select(
        F.col("run_id").alias("_run"),
        *[F.col(b).alias(f"_t_{b}") for b in on.values()],
        "start_time",
        "end_time",
        _cells("start_time", "end_time", window_seconds).alias("_tc"),
    )
    f = found.withColumn("_fc", _cells("start_window", "end_window", window_seconds))
    condition = (
        (F.col("run_id") == F.col("_run"))
        & (F.col("_fc") == F.col("_tc"))
        & _meets("start_window", "end_window", "start_time", "end_time")
    )
    for a, b in on.items():
        condition = condition & (F.col(a) == F.col(f"_t_{b}"))
    return f.join(t, condition, "left_semi").select(*found.columns).distinct()


def eval_root_cause(true: DataFrame, found: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Derived incidents during a true one, and how many name its target."""
    names = found.select("run_id", F.col("incident_id").alias("root_cause_incident_id"), F.col("target").alias("root_target"))
    derived = (
        found.filter("derived")
        .select("run_id", "incident_id", "root_cause_incident_id", "start_window", "end_window")
        .join(names, ["run_id", "root_cause_incident_id"], "left")
    )
    total = overlapping_any(derived, true, window_seconds)
    right = overlapping_any(
        derived.filter("root_target IS NOT NULL"), true, window_seconds, {"root_target": "target"}
    )
    count = F.count(F.lit(1))
    out = (
        total.groupBy("run_id")
        .agg(count.alias("root_cause_total"))
        .join(right.groupBy("run_id").agg(count.alias("root_cause_correct")), "run_id", "left")
    )
    return out.withColumn("root_cause_correct", F.coalesce("root_cause_correct", F.lit(0)).cast("bigint")).withColumn(
        "root_cause_accuracy", safe_ratio(F.col("root_cause_correct"), F.col("root_cause_total"))
    )


def eval_incident_prf(
    ranges: DataFrame, matched: DataFrame, true: DataFrame, found: DataFrame, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Precision, recall, F1; each is NULL on its own where it is undefined.

    Found are the distinct targets and detectors of incidents not derived; in
    runs with true incidents only those overlapping one of them count.
    """
    key = ["run_id", "target_type", "target", "detector"]
    independent = found.filter("NOT derived").select(*key, "start_window", "end_window")
    with_truth = true.select("run_id").distinct()
    counted = (
        overlapping_any(independent, true, window_seconds)
        .unionByName(independent.join(with_truth, "run_id", "left_anti"))
        .select(*key)
        .distinct()
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("found_incident_count"))
    )
    truth = matched.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("true_incident_count"), F.count_if("detected").alias("true_positive_count")
    )
    zero = F.lit(0).cast("bigint")
    counts = ranges.select("run_id").join(truth, "run_id", "left").join(counted, "run_id", "left")
    counts = counts.select(
        "run_id",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("true_incident_count", "found_incident_count", "true_positive_count")
        ],
    )
    tp = F.col("true_positive_count")
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return counts.withColumns(
        {
            "precision": safe_ratio(tp, F.col("found_incident_count")),
            "recall": safe_ratio(tp, F.col("true_incident_count")),
        }
    ).withColumn("f1", f1)


def eval_healthy_rate(ranges: DataFrame, true: DataFrame, detections: DataFrame, windows: DataFrame) -> DataFrame:
    """Detections per run, and per hour in runs without true incidents."""
    total = detections.join(windows, "window_start").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    truth = true.select("run_id", F.lit(True).alias("_t")).distinct()
    seconds = (F.col("hi_ns") - F.col("lo_ns")) / 1e9
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return (
        ranges.join(total, "run_id", "left")
        .join(truth, "run_id", "left")
        .select(
            "run_id",
            n.alias("total_detection_count"),
            F.when(F.col("_t").isNull() & (seconds > 0), n / (seconds / 3600)).alias(
                "healthy_control_detections_per_hour"
            ),
        )
    )


def asof_bounded(points: DataFrame, stats: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Stats of the window in (at - W, at]; a silent window reads as zeros.

    Windows start at multiples of W, so exactly one can qualify and the as-of
    search is an equi-join. ``points`` hold target_type, target and ``at``.
    """
    window = (F.floor(F.col("at") / window_seconds) * window_seconds).cast("bigint")
    s = stats.select("window_start", "target_type", "target", "call_count", "error_count", "latency_p99_ms")
    zero = F.lit(0).cast("bigint")
    return (
        points.withColumn("window_start", window)
        .join(s, ["window_start", "target_type", "target"], "left")
        .drop("window_start")
        .withColumns(
            {
                "call_count": F.coalesce("call_count", zero),
                "error_count": F.coalesce("error_count", zero),
                "latency_p99_ms": F.coalesce("latency_p99_ms", F.lit(0.0)),
            }
        )
    )


def asof_ready_baseline(points: DataFrame, baselines: DataFrame) -> DataFrame:
    """The latest ready baseline at or before ``at``, however old.

    Points and baselines of a target are merged in time order and the last
    baseline seen is carried forward; a target has one baseline per window.
    """
    kept = ["latency_median_ms", "call_rate_median"]
    ready = baselines.filter("ready").select(
        "target_type", "target", F.col("as_of").cast("double").alias("at"), F.struct(*kept).alias("_b")
    )
    asked = points.withColumn("_point", F.struct(*points.columns))
    series = (
        Window.partitionBy("target_type", "target")
        .orderBy("at", F.col("_point").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = ready.unionByName(asked.select("target_type", "target", F.col("at").cast("double").alias("at"), "_point"), True)
    return (
        merged.withColumn("_last", F.last("_b", ignorenulls=True).over(series))
        .filter("_point IS NOT NULL")
        .select("_point.*", *[F.col(f"_last.{c}").alias(c) for c in kept])
    )


def eval_observed_magnitude(
    true: DataFrame, stats: DataFrame, baselines: DataFrame, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Measured strength of each true incident, comparable to the injected one."""
    key = ["run_id", "incident_id"]
    points = true.select(*key, "type", "target_type", "target", "start_time", "end_time")
    middle = asof_bounded(
        points.withColumn("at", (F.col("start_time") + F.col("end_time")) / 2), stats, window_seconds
    ).drop("at")
    before = asof_ready_baseline(
        points.select(*key, "target_type", "target", F.col("start_time").alias("at")), baselines
    ).select(*key, "latency_median_ms", "call_rate_median")
    calls, median, rate = F.col("call_count"), F.col("latency_median_ms"), F.col("call_rate_median")
    observed = (
        F.when(
            F.col("type").isin("latency_spike", "latency_tail"),
            F.when((calls > 0) & (median > 0), F.col("latency_p99_ms") / median),
        )
        .when(F.col("type") == "error_burst", F.when(calls > 0, F.col("error_count") / calls))
        .when(
            F.col("type").isin("throughput_drop", "edge_disappearance"),
            F.when(rate > 0, 1 - calls / rate),
        )
    )
    return middle.join(before, key).select(*key, observed.alias("observed_magnitude"))


def eval_depths(true: DataFrame, depths: DataFrame) -> DataFrame:
    """Depth of each incident's target in the call graph; NULL where unknown."""
    return true.select("run_id", "incident_id", "target").join(
        depths.select(F.col("service").alias("target"), F.col("depth").alias("target_depth")), "target", "left"
    )


def incident_details(
    true: DataFrame,
    found: DataFrame,
    stats: DataFrame,
    baselines: DataFrame,
    depths: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    key = ["run_id", "incident_id"]
    latency = eval_detection_latency(eval_incident_match(true, found), window_seconds)
    return (
        latency.join(eval_observed_magnitude(true, stats, baselines, window_seconds), key, "left")
        .join(eval_depths(true, depths).drop("target"), key, "left")
        .select(
            *key,
            "type",
            "target_type",
            "target",
            "target_depth",
            "magnitude",
            "detected",
            "detection_latency_seconds",
            "observed_magnitude",
        )
    )


def evaluate(
    gt: dict[str, DataFrame], tables: dict[str, DataFrame], window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """One wide row per run.

    ``gt`` holds spans, edges, incidents and offsets; ``tables`` holds spans,
    classifications, edges, incidents, detections and offsets. The incidents one by
    one are :func:`incident_details`.
    """
    ranges = eval_run_range(gt["spans"])
    windows = run_windows(ranges, window_seconds)
    landed = eval_landed(gt["spans"], tables["spans"])
    classes = eval_classifications(gt["spans"], tables["classifications"])
    true = true_incidents(gt["incidents"])
    found = run_incidents(tables["incidents"], windows)
    matched = eval_incident_match(true, found)
    sizes = gt["spans"].groupBy("run_id").agg(F.count(F.lit(1)).alias("ground_truth_span_count")).join(
        landed.groupBy("run_id").agg(F.count(F.lit(1)).alias("landed_span_count")), "run_id", "left"
    )
    parts = [
        eval_edges_prf(gt["edges"], tables["edges"], windows),
        eval_attachment(gt["spans"], landed, classes),
        eval_incident_prf(ranges, matched, true, found, window_seconds),
        eval_root_cause(true, found, window_seconds),
        eval_healthy_rate(ranges, true, tables["detections"], windows),
        clock_error_summary(eval_clock_error(gt["offsets"], tables["offsets"], windows)),
    ]
    out = sizes
    for part in parts:
        out = out.join(part, "run_id", "left")
    zeros = [
        "landed_span_count",
        "true_edge_count",
        "found_edge_count",
        "edge_true_positive_count",
        "attachment_denominator",
        "attachment_correct",
        "orphan_denominator",
        "orphan_correct",
        "root_cause_total",
        "root_cause_correct",
        "clock_offset_count",
    ]
    return out.fillna(0, zeros)


def clock_error_summary(errors: DataFrame) -> DataFrame:
    """Per run: services with a true and a detected offset, mean and largest error either way."""
    size = F.abs("error_ns")
    return errors.groupBy("run_id").agg(
        F.count("*").alias("clock_offset_count"),
        F.avg(size).alias("clock_offset_mean_error_ns"),
        F.max(size).alias("clock_offset_max_error_ns"),
    )


def sweep_summary(points: DataFrame) -> DataFrame:
    """Sums over evaluation points per incident type, then the ratios of the sums."""
    sums = points.groupBy("type").agg(
        *[F.sum(c).alias(c) for c in ("found_incident_count", "true_positive_count", "true_incident_count")]
    )
    tp = F.col("true_positive_count")
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return sums.withColumns(
        {
            "precision": safe_ratio(tp, F.col("found_incident_count")),
            "recall": safe_ratio(tp, F.col("true_incident_count")),
        }
    ).withColumn("f1", f1)


def latency_distribution(details: DataFrame) -> DataFrame:
    """Quartiles of the detection latency over detected incidents, per type."""
    micros = details.filter("detected").withColumn(
        "_us", F.round(F.col("detection_latency_seconds") * 1e6).cast("bigint")
    )
    q = percentiles(micros, ["type"], "_us", [0.0, 0.25, 0.5, 0.75, 1.0], ["_us"])
    names = ["latency_min", "latency_p25", "latency_median", "latency_p75", "latency_max"]
    return q.select(
        "type",
        F.col("n").alias("detected"),
        *[(F.col(f"p{i}") / 1e6).alias(name) for i, name in enumerate(names)],
        (F.col("_us") / F.col("n") / 1e6).alias("latency_mean"),
    )
