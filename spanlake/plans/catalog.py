"""Every registered query: name -> (Spark function, oracle SQL or None)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.columns import int_div
from spanlake.operators import (
    aggregates,
    baseline,
    clock,
    detect,
    evaluate,
    faults,
    groundtruth,
    incidents,
    quantiles,
    reassembly,
    shape,
    telemetry,
    windows,
)
from spanlake.operators.dedup import latest_version
from spanlake.plans import oracle, queries
from spanlake.plans.oracle import BASE, sql, u01
from spanlake.plans.pipeline import Analysis
from spanlake.schemas import KEYS, NS
from spanlake.session import configure, scratch_path, write_scratch
from spanlake.sources import otlp, tabular
from spanlake.sources.tables import TableStore, retention, span_sink
from spanlake.streaming import ingest
from spanlake.streaming.incidents import stream_open_incidents
from spanlake.streaming.processor import WindowProcessor

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

_ANALYSES: dict[tuple[str, str], Analysis] = {}


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """The derived tables of a data folder, shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _ANALYSES:
        _ANALYSES[key] = Analysis(tabular.raw_spans(spark, sf_dir))
    return _ANALYSES[key]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, as the oracle does: interpolation differs in the last bit."""
    return df.select(
        *[
            F.round(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, final: str | None = None, **instead: str):
    """Register a function of (analysis, spark, sf_dir); ``instead``: other building blocks for its SQL."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return rounded(fn(analysis(spark, sf_dir), spark, sf_dir))

        REGISTRY[name] = (run, sql(final, **instead) if final else None)
        return fn

    return wrap


SLIM = ["trace_id", "span_id", "parent_span_id", "service_name", "start_time_unix_nano", "end_time_unix_nano", "status_code"]
SLIM_SQL = (
    "trace_id, span_id, parent_span_id, service_name, start_ns AS start_time_unix_nano, "
    "end_ns AS end_time_unix_nano, status_code"
)
STATS_SQL = "round(p50, 6) AS latency_p50_ms, round(p95, 6) AS latency_p95_ms, round(p99, 6) AS latency_p99_ms"
PAIRS = ["trace_id", "window_start", "parent_span_id", "child_span_id", "parent_service_name", "child_service_name"]
PAIRS_SQL = (
    "trace_id, window_start, parent_id AS parent_span_id, child_id AS child_span_id, "
    "caller AS parent_service_name, callee AS child_service_name"
)
DETECTION = ["window_start", "target_type", "target", "detector", "severity", "observed_value", "baseline_value", "deviation"]
DETECTION_SQL = (
    "window_start, target_type, target, detector, severity, round(observed_value, 6) AS observed_value, "
    "round(baseline_value, 6) AS baseline_value, round(deviation, 6) AS deviation"
)
INCIDENT = ["incident_id", "target_type", "target", "detector", "start_window", "end_window", "window_count", "peak_severity", "peak_deviation"]
INCIDENT_SQL = (
    "incident_id, target_type, target, detector, start_window, end_window, window_count, peak_severity, "
    "round(peak_deviation, 6) AS peak_deviation"
)
BASELINE_SQL = (
    "call_count_observed, round(latency_median_ms, 6) AS latency_median_ms, round(latency_mad_ms, 6) AS latency_mad_ms, "
    "round(error_rate, 6) AS error_rate, round(call_rate_median, 6) AS call_rate_median, "
    "round(call_rate_mad, 6) AS call_rate_mad, ready"
)
RANGE = (BASE + 600, BASE + 3600)
RANGE_SQL = f"BETWEEN {RANGE[0]} AND {RANGE[1]}"

# --- ingest ---------------------------------------------------------------


def otlp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export requests as JSON text, one per line item; every 31st order's are cut off.

    A request has two resources: the line's service with its span and one span
    without an id, and a resource without a service name. Every 37th order's times are
    no numbers and every 41st order's do not fit 64 bits.
    """
    (lineitem,) = tabular.tables(spark, sf_dir, "lineitem")
    rows = lineitem.select(
        F.col("l_orderkey").alias("key"),
        F.col("l_linenumber").cast("bigint").alias("ln"),
        "l_partkey",
        "l_extendedprice",
        "l_quantity",
        "l_returnflag",
    )
    a, v = otlp.attribute, otlp.any_value
    begin = tabular.trace_start_us(F.col("key")) * 1000
    no_value = F.array().cast(otlp.ATTRIBUTES)

    def span(identity, name, attributes):
        return F.struct(
            tabular.trace_id(F.col("key")).alias("traceId"),
            identity.alias("spanId"),
            F.upper(tabular.span_id(F.col("key"), F.col("ln") - 1)).alias("parentSpanId"),
            name.alias("name"),
            F.when(F.col("key") % 37 == 0, "12x").when(F.col("key") % 41 == 0, "18446744073709551616").otherwise(begin.cast("string")).alias("startTimeUnixNano"),
            (begin + F.col("ln") * 1_000_000).cast("string").alias("endTimeUnixNano"),
            F.struct((F.col("ln").cast("int") % 3).alias("code")).alias("status"),
            attributes.cast(otlp.ATTRIBUTES).alias("attributes"),
        )

    own = F.array(
        a("part", v(intValue=F.col("l_partkey").cast("string"))),
        a("price", v(doubleValue=F.col("l_extendedprice"))),
        a("huge", v(doubleValue=F.col("l_quantity") * 10_000_000)),
        a("cheap", v(boolValue=F.col("l_extendedprice") < 20_000)),
        a("flag", v(stringValue=F.lit("replaced below"))),
        a("list", v(arrayValue=F.lit("[1]"))),
        a("service.name", v(stringValue=F.lit("loses to the resource"))),
        a("flag", v(stringValue=F.col("l_returnflag"))),
    )
    ident = tabular.span_id(F.col("key"), F.col("ln"))
    first = F.struct(
        F.struct(
            F.array(
                a("host", v(stringValue=F.lit("h"))),
                a("service.name", v(stringValue=F.concat(F.lit("svc-"), F.col("ln").cast("string")))),
                a("service.name", v(stringValue=F.lit("second is ignored"))),
            ).cast(otlp.ATTRIBUTES).alias("attributes")
        ).alias("resource"),
        F.array(F.struct(F.array(span(ident, F.lit("op"), own), span(F.lit(""), F.lit("lost"), no_value)).alias("spans"))).alias("scopeSpans"),
    )
    second = F.struct(
        F.struct(no_value.alias("attributes")).alias("resource"),
        F.array(F.struct(F.array(span(F.concat(F.lit("f"), F.substring(ident, 2, 15)), F.lit("bare"), no_value)).alias("spans"))).alias("scopeSpans"),
    )
    text = F.to_json(F.struct(F.array(first, second).alias("resourceSpans")))
    cut = F.when(F.col("key") % 31 == 0, F.substring(text, 1, 40)).otherwise(text)
    return rows.select(cut.alias("value"))


def otlp_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export requests, parsed as they come: their text is many times the tables and is nowhere stored."""
    return otlp.parse_otlp(otlp_lines(spark, sf_dir))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.otlp_flatten(otlp.skip_corrupt(otlp_requests(spark, sf_dir)))


_L = "(SELECT l_orderkey AS key, l_linenumber::BIGINT AS ln, * FROM lineitem)"
_GOOD = f"(SELECT * FROM {_L} WHERE key % 31 <> 0)"
_OTLP_SPANS = f"""(SELECT key, ln, {oracle.tid('key')} AS trace_id, {oracle.sid('key', 'ln')} AS span_id, 'svc-' || ln AS service_name, 'op' AS span_name FROM {_GOOD}
 UNION ALL SELECT key, ln, {oracle.tid('key')}, '', 'svc-' || ln, 'lost' FROM {_GOOD}
 UNION ALL SELECT key, ln, {oracle.tid('key')}, 'f' || substr({oracle.sid('key', 'ln')}, 2, 15), 'unknown_service', 'bare' FROM {_GOOD})"""


@query("otlp_flatten", f"SELECT trace_id, span_id, service_name, span_name FROM {_OTLP_SPANS}")
def _(a, spark, sf):
    return _flat(spark, sf).select(
        F.col("traceId").alias("trace_id"),
        F.col("spanId").alias("span_id"),
        F.col("resource_service").alias("service_name"),
        F.col("name").alias("span_name"),
    )


@query("validate_spans", f"SELECT count(*) AS received, count(*) FILTER (span_id = '') AS invalid FROM {_OTLP_SPANS}")
def _(a, spark, sf):
    return otlp.validation_counts(_flat(spark, sf))


@query("resolve_service_name", f"SELECT service_name, count(*) AS spans FROM {_OTLP_SPANS} WHERE span_id <> '' GROUP BY 1")
def _(a, spark, sf):
    valid = otlp.validate_spans(_flat(spark, sf))
    return valid.groupBy(F.col("resource_service").alias("service_name")).agg(F.count(F.lit(1)).alias("spans"))


@query(
    "normalize_span_row",
    f"""SELECT s.trace_id, s.span_id, {oracle.sid('s.key', '(s.ln - 1)')} AS parent_span_id, s.service_name, s.span_name,
 {oracle.start_us('s.key')} * 1000 AS start_time_unix_nano, {oracle.start_us('s.key')} * 1000 + s.ln * 1000000 AS end_time_unix_nano,
 (s.ln % 3)::INTEGER AS status_code,
 CASE WHEN s.span_name = 'op' THEN 'cheap=' || (l.l_extendedprice < 20000) || ';flag=' || l.l_returnflag
   || ';huge=' || (l.l_quantity * 10000000)::BIGINT || ';list=;part=' || l.l_partkey
   || ';price=' || rtrim(rtrim(printf('%.2f', l.l_extendedprice), '0'), '.') ELSE '' END AS attributes
FROM (SELECT *, row_number() OVER () AS rid FROM {_GOOD} WHERE key % 37 <> 0 AND key % 41 <> 0) l
JOIN LATERAL (SELECT l.key AS key, l.ln AS ln, {oracle.tid('l.key')} AS trace_id, {oracle.sid('l.key', 'l.ln')} AS span_id, 'svc-' || l.ln AS service_name, 'op' AS span_name
  UNION ALL SELECT l.key, l.ln, {oracle.tid('l.key')}, 'f' || substr({oracle.sid('l.key', 'l.ln')}, 2, 15), 'unknown_service', 'bare') s ON true""",
)
def _(a, spark, sf):
    rows = otlp.normalize_span_row(otlp.validate_spans(_flat(spark, sf)))
    text = F.array_join(
        F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    )
    return rows.withColumn("attributes", text).drop("ingested_at_unix_nano")


@query(
    "skip_corrupt",
    f"""SELECT count(*) FILTER (key % 31 <> 0) AS decoded, count(*) FILTER (key % 31 = 0) AS quarantined,
 3 * count(*) FILTER (key % 31 <> 0 AND (key % 37 = 0 OR key % 41 = 0)) AS unreadable FROM {_L}""",
)
def _(a, spark, sf):
    bad = F.col(otlp.CORRUPT).isNotNull()
    # One pass: parsing is the work.
    return otlp_requests(spark, sf).agg(
        F.count_if(~bad & F.col("resourceSpans").isNotNull()).alias("decoded"),
        F.count_if(bad).alias("quarantined"),
        F.coalesce(F.sum(F.when(~bad, otlp.unreadable_spans())), F.lit(0)).alias("unreadable"),
    )


@query("latest_version", f"SELECT {SLIM_SQL}, ingested_ns AS ingested_at_unix_nano FROM spans")
def _(a, spark, sf):
    newest = latest_version(a.raw, KEYS["spans"], "ingested_at_unix_nano")
    return newest.select(*SLIM, "ingested_at_unix_nano")


@query(
    "derive_span_cols",
    """SELECT trace_id, span_id, end_ns - start_ns AS duration_ns, start_ns // 1000 AS start_us,
 strftime(make_timestamp(start_ns // 1000), '%Y-%m-%d') AS start_date FROM spans""",
)
def _(a, spark, sf):
    df = windows.derive_span_cols(a.spans)
    return df.select(
        "trace_id",
        "span_id",
        "duration_ns",
        F.unix_micros("start_time").alias("start_us"),
        F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
    )


@query("span_sink", "SELECT strftime(make_timestamp(start_ns // 1000), '%Y-%m-%d') AS start_date, count(*) AS spans FROM spans GROUP BY 1")
def _(a, spark, sf):
    path = scratch_path(spark, "span_sink")
    span_sink(a.spans.drop("window_start"), path)
    return spark.read.parquet(path).groupBy(F.date_format("start_date", "yyyy-MM-dd").alias("start_date")).agg(
        F.count(F.lit(1)).alias("spans")
    )


@query("retention", f"SELECT {SLIM_SQL} FROM spans WHERE make_timestamp(start_ns // 1000)::DATE >= DATE '2024-02-01' - 30")
def _(a, spark, sf):
    return retention(a.spans, F.lit("2024-02-01").cast("date"), 30).select(*SLIM)


@query(
    "upsert_outputs",
    f"SELECT window_start, callee AS service_name, call_count + CASE WHEN window_start % 120 = 0 THEN 1000 ELSE 0 END AS call_count, error_count, {STATS_SQL} FROM stats WHERE target_type = 'service'",
)
def _(a, spark, sf):
    """Write, then write half of the windows again with other values: the later row stays."""
    store = TableStore(spark, scratch_path(spark, "store"))
    store.write("service_stats", a.service_stats, 1)
    again = a.service_stats.filter("window_start % 120 = 0").withColumn("call_count", F.col("call_count") + 1000)
    store.write("service_stats", again, 2)
    store.write("service_stats", again, 2)
    return store.read("service_stats")


class _Tables(dict):
    """Tables by name, each written when first asked for."""

    def __init__(self, **made: Callable[[], DataFrame]):
        super().__init__()
        self.made = made

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.made[name]()
        return self[name]


def _ground_truth(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    key = ("gt", spark.sparkContext.applicationId, os.path.abspath(sf))
    if key not in _GROUND_TRUTH:
        out = _GROUND_TRUTH[key] = _Tables(
            rows=lambda: _sent_rows(spark, sf),
            spans=lambda: groundtruth.ground_truth_spans(out["rows"]),
            edges=lambda: write_scratch(groundtruth.ground_truth_edges(out["spans"]), "gt_edges"),
            offsets=lambda: write_scratch(_true_offsets(out["rows"]), "gt_offsets"),
            incidents=lambda: write_scratch(_true_incidents(out["rows"]), "gt_incidents"),
        )
    return _GROUND_TRUTH[key]


def _sent_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Newest version of every span sent, by trace in as many buckets as the span table: joins of the two move no span.

    The columns left out come behind these among copies of one age, so the same copy stays.
    """
    layout = analysis(spark, sf).layout
    slim = ["trace_id", "span_id", "parent_span_id", "service_name", "start_time_unix_nano", "ingested_at_unix_nano", "key"]
    newest = latest_version(layout.dealt(tabular.sent_spans(spark, sf).select(*slim)), KEYS["spans"], "ingested_at_unix_nano")
    begin = tabular.trace_start_us(F.col("key"))
    relative = int_div(begin - tabular.BASE_SECONDS * 1_000_000, tabular.RUN_SECONDS * 1_000_000)
    rows = newest.select(
        F.concat(F.lit("run-"), relative.cast("string")).alias("run_id"),
        "trace_id",
        "span_id",
        "parent_span_id",
        "service_name",
        (begin * 1000).alias("generated_at"),
        tabular.minute_index(int_div(F.col("start_time_unix_nano"), 1000)).alias("minute"),
    )
    return layout.write(rows, "gt_spans")


def _true_offsets(rows: DataFrame) -> DataFrame:
    return rows.filter("service_name <> 'frontend'").select("run_id", "service_name").distinct().withColumn(
        "offset_ns", F.when(F.col("service_name") == "inventory", -40_000_000).otherwise(0).cast("bigint")
    )


def _true_incidents(rows: DataFrame) -> DataFrame:
    minutes = rows.filter("service_name = 'frontend' AND run_id <> 'run-1'").select("run_id", "minute").distinct()
    kinds = [
        ("edge_disappearance", 17, 12, "", "checkout->payments", 0.0, 59.0, 1.0),
        ("error_burst", 19, 15, "search", "", 0.5, 59.0, 0.5),
        ("latency_spike", 23, 14, "shipping", "", 10.0, 100.0, 8.0),
    ]
    parts = []
    for kind, every, at, service, edge, shift, seconds, magnitude in kinds:
        begin_s = F.col("minute") * 60.0 + BASE + shift
        parts.append(
            minutes.filter(F.col("minute") % every == at).select(
                "run_id",
                F.concat(F.lit(f"{kind}-"), F.col("minute").cast("string")).alias("incident_id"),
                F.lit(kind).alias("type"),
                F.lit(service).alias("target_service"),
                F.lit(edge).alias("target_edge"),
                begin_s.alias("start_time"),
                (begin_s + seconds).alias("end_time"),
                F.lit(magnitude).alias("magnitude"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_GROUND_TRUTH: dict[tuple, dict[str, DataFrame]] = {}


@query("ground_truth_rows", "SELECT run_id, trace_id, caller_service, callee_service, generated_at FROM gt_edges ORDER BY ALL")
def _(a, spark, sf):
    return _ground_truth(spark, sf)["edges"]


_SPECS_SQL = f"""(SELECT n_name AS id, list_extract(['latency_spike', 'latency_tail', 'error_burst', 'throughput_drop', 'edge_disappearance'], n_nationkey % 5 + 1) AS type,
 CASE WHEN n_nationkey % 5 < 3 THEN list_extract(['search', 'shipping'], n_regionkey % 2 + 1) ELSE '' END AS target_service,
 CASE WHEN n_nationkey % 5 >= 3 THEN 'checkout' ELSE '' END AS target_caller, CASE WHEN n_nationkey % 5 >= 3 THEN 'payments' ELSE '' END AS target_callee,
 {BASE}::BIGINT + n_nationkey * 100 AS a, {BASE}::BIGINT + n_nationkey * 100 + 500 AS b, CASE WHEN n_nationkey % 5 < 2 THEN 1.5 ELSE 0.25 END::DOUBLE + n_regionkey * 0.0625 AS m FROM nation)"""


def incident_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping incident settings, one per nation."""
    (nation,) = tabular.tables(spark, sf, "nation")
    kind = F.col("n_nationkey") % 5
    names = F.array(*[F.lit(x) for x in ("latency_spike", "latency_tail", "error_burst", "throughput_drop", "edge_disappearance")])
    edge = kind >= 3
    return nation.select(
        F.col("n_name").alias("id"),
        F.get(names, kind).alias("type"),
        F.when(~edge, F.when(F.col("n_regionkey") % 2 == 0, "search").otherwise("shipping")).otherwise("").alias("target_service"),
        F.when(edge, "checkout").otherwise("").alias("target_caller"),
        F.when(edge, "payments").otherwise("").alias("target_callee"),
        (F.col("n_nationkey") * 100).alias("start_offset_s"),
        F.lit(500).alias("duration_s"),
        (F.when(kind < 2, 1.5).otherwise(0.25) + F.col("n_regionkey") * 0.0625).alias("magnitude"),
    )


@query(
    "active_incidents",
    f"""SELECT trace_id, span_id, s.service_name, start_ns AS start_time_unix_nano,
 coalesce(max(m) FILTER (type = 'error_burst'), 0.0) AS error_probability,
 round(coalesce(product(m) FILTER (type = 'latency_spike'), 1.0), 6) AS spike_factor,
 round(coalesce(product(m) FILTER (type = 'latency_tail'), 1.0), 6) AS tail_factor
FROM spans s JOIN {_SPECS_SQL} i ON i.target_service = s.service_name AND s.start_ns >= a * 1000000000 AND s.start_ns < b * 1000000000
GROUP BY ALL""",
)
def _(a, spark, sf):
    return groundtruth.active_incidents(a.spans, incident_specs(spark, sf), BASE)


@query(
    "active_edge_incidents",
    f"""SELECT trace_id, child_id AS child_span_id, caller AS parent_service_name, callee AS child_service_name,
 CASE WHEN count(*) FILTER (type = 'edge_disappearance') > 0 THEN 0.0
   ELSE round(coalesce(product(1 - m) FILTER (type = 'throughput_drop'), 1.0), 6) END AS traffic_share
FROM pairs p JOIN {_SPECS_SQL} i ON i.target_caller = p.caller AND i.target_callee = p.callee
 AND p.c_start >= a * 1000000000 AND p.c_start < b * 1000000000 GROUP BY ALL""",
)
def _(a, spark, sf):
    return groundtruth.active_edge_incidents(a.pairs, incident_specs(spark, sf), BASE)


@query("fault_drop", f"SELECT {SLIM_SQL} FROM spans WHERE {u01(repr('drop'), 'trace_id', 'span_id')} >= 0.1")
def _(a, spark, sf):
    return faults.fault_drop(a.spans, 0.1).select(*SLIM)


@query(
    "fault_out_of_order",
    f"""SELECT s.trace_id, s.span_id, ingested_ns + CASE WHEN p.span_id IS NOT NULL AND {u01(repr('ooo'), 's.trace_id', 's.span_id')} < 0.5
  THEN 5000000000 ELSE 0 END AS ingested_at_unix_nano
FROM spans s LEFT JOIN (SELECT DISTINCT trace_id, parent_span_id AS span_id FROM spans WHERE parent_span_id <> '') p USING (trace_id, span_id)""",
)
def _(a, spark, sf):
    late = faults.apply_arrival(faults.fault_out_of_order(a.spans, 0.5, 5 * NS))
    return late.select("trace_id", "span_id", "ingested_at_unix_nano")


@query(
    "fault_late_arrival",
    f"""SELECT trace_id, span_id, ingested_ns + CASE WHEN {u01(repr('late'), 'trace_id', 'span_id')} < 0.05
  THEN 60000000000 + floor({u01(repr('late-by'), 'trace_id', 'span_id')} * 240000000000)::BIGINT ELSE 0 END AS ingested_at_unix_nano FROM spans""",
)
def _(a, spark, sf):
    late = faults.apply_arrival(faults.fault_late_arrival(a.spans, 0.05, 60 * NS, 300 * NS))
    return late.select("trace_id", "span_id", "ingested_at_unix_nano")


_SKEW = f"""CASE WHEN service_name <> 'frontend' AND {u01(repr('skew'), 'service_name')} < 0.5 THEN
 (CASE WHEN {u01(repr('skew-sign'), 'service_name')} < 0.5 THEN -1 ELSE 1 END) * (floor({u01(repr('skew-by'), 'service_name')} * 2000000000)::BIGINT + 1) ELSE 0 END"""


@query(
    "fault_clock_skew",
    f"SELECT trace_id, span_id, service_name, start_ns + {_SKEW} AS start_time_unix_nano, end_ns + {_SKEW} AS end_time_unix_nano FROM spans",
)
def _(a, spark, sf):
    skewed = faults.fault_clock_skew(a.spans, 0.5, 2 * NS, "frontend")
    return skewed.select("trace_id", "span_id", "service_name", "start_time_unix_nano", "end_time_unix_nano")


@query("fault_skew_ground_truth", f"SELECT DISTINCT service_name, ({_SKEW})::BIGINT AS offset_ns FROM spans")
def _(a, spark, sf):
    return faults.skew_ground_truth(a.spans, 0.5, 2 * NS, "frontend")


@query(
    "fault_composition",
    f"""SELECT trace_id, span_id, start_ns + {_SKEW} AS start_time_unix_nano, ingested_ns + greatest(
  CASE WHEN is_parent AND {u01(repr('ooo'), 'trace_id', 'span_id')} < 0.5 THEN 5000000000 ELSE 0 END,
  CASE WHEN {u01(repr('late'), 'trace_id', 'span_id')} < 0.2 THEN 1000000000 + floor({u01(repr('late-by'), 'trace_id', 'span_id')} * 9000000000)::BIGINT ELSE 0 END) AS ingested_at_unix_nano
FROM (SELECT s.*, p.span_id IS NOT NULL AS is_parent FROM spans s
  LEFT JOIN (SELECT DISTINCT trace_id, parent_span_id AS span_id FROM spans WHERE parent_span_id <> '') p USING (trace_id, span_id))
WHERE {u01(repr('drop'), 'trace_id', 'span_id')} >= 0.1""",
)
def _(a, spark, sf):
    """All faults at once, in their fixed order."""
    out = (
        a.spans.transform(faults.fault_out_of_order, 0.5, 5 * NS)
        .transform(faults.fault_drop, 0.1)
        .transform(faults.fault_late_arrival, 0.2, NS, 10 * NS)
        .transform(faults.fault_clock_skew, 0.5, 2 * NS, "frontend")
        .transform(faults.apply_arrival)
    )
    return out.select("trace_id", "span_id", "start_time_unix_nano", "ingested_at_unix_nano")


# --- windows --------------------------------------------------------------


@query(
    "window_bounds",
    "SELECT trace_id, span_id, window_start // 60 AS window_index, window_start, window_start + 60 AS window_end FROM spans",
)
def _(a, spark, sf):
    return windows.window_bounds(a.spans.drop("window_start")).select(
        "trace_id", "span_id", "window_index", "window_start", "window_end"
    )


@query("window_spine", f"SELECT window_start, window_start + 60 AS window_end FROM spine WHERE window_start + 60 + 30 <= {BASE + 400}")
def _(a, spark, sf):
    return windows.window_spine(a.spans, now=BASE + 400)


@query(
    "late_spans",
    f"""SELECT trace_id, span_id, service_name, start_ns AS start_time_unix_nano, ingested_ns AS ingested_at_unix_nano
FROM spans WHERE ingested_ns > {(BASE + 300) * NS} AND start_ns < {(BASE + 360) * NS}""",
)
def _(a, spark, sf):
    boundary = windows.late_check_boundary(BASE + 390)
    return windows.late_spans(a.spans, boundary, BASE + 300)


@query("fetch_window", f"SELECT {SLIM_SQL} FROM spans WHERE start_ns >= {(BASE + 120) * NS} AND start_ns < {(BASE + 180) * NS}")
def _(a, spark, sf):
    return windows.fetch_window(a.spans, BASE + 120, BASE + 180).select(*SLIM)


@query("as_seen", f"SELECT {SLIM_SQL} FROM spans WHERE ingested_ns <= (window_start + 90) * 1000000000")
def _(a, spark, sf):
    return windows.as_seen(a.spans).select(*SLIM)


# --- reassembly -----------------------------------------------------------


@query("resolved_pairs", f"SELECT {PAIRS_SQL} FROM pairs ORDER BY ALL")
def _(a, spark, sf):
    return reassembly.resolved_pairs(a.spans).select(*PAIRS)


@query("resolved_pairs_any_window", f"SELECT {PAIRS_SQL} FROM any_pairs ORDER BY ALL")
def _(a, spark, sf):
    return a.any_pairs.select(*PAIRS)


@query("root_detect", f"SELECT {SLIM_SQL} FROM spans WHERE parent_span_id = ''")
def _(a, spark, sf):
    return reassembly.root_detect(a.spans).select(*SLIM)


@query("orphan_detect", f"SELECT {SLIM_SQL} FROM kinds WHERE kind = 'orphan' ORDER BY ALL")
def _(a, spark, sf):
    return reassembly.orphan_detect(a.spans).select(*SLIM)


@query("cycle_detect", "SELECT trace_id, window_start, span_id FROM classes WHERE classification = 'cycle_rejected'")
def _(a, spark, sf):
    return a.seeds.filter("seed IS NULL").select("trace_id", "window_start", "span_id")


@query("span_classification", "SELECT trace_id, span_id, window_start, classification FROM classes")
def _(a, spark, sf):
    return reassembly.classify(reassembly.span_seeds(a.spans))


@query("canonical_root", "SELECT trace_id, window_start, root_span_id, root_service FROM canonical")
def _(a, spark, sf):
    return reassembly.canonical_roots(a.spans)


@query("trace_depth", "SELECT trace_id, window_start, depth FROM summaries")
def _(a, spark, sf):
    return a.summaries.select("trace_id", "window_start", "depth")


@query(
    "trace_summaries",
    "SELECT trace_id, window_start, depth, span_count, root_service, complete, incompleteness_reason, orphan_count FROM summaries",
)
def _(a, spark, sf):
    return reassembly.summarize(a.seeds)


@query(
    "reassemble",
    """SELECT c.trace_id, c.window_start, c.span_id, c.classification, s.depth, s.complete, s.incompleteness_reason
FROM classes c JOIN summaries s USING (trace_id, window_start)""",
)
def _(a, spark, sf):
    summaries, classes = reassembly.reassemble(a.spans)
    return classes.join(
        summaries.select("trace_id", "window_start", "depth", "complete", "incompleteness_reason"),
        ["trace_id", "window_start"],
    )


@query(
    "reassembly_counters",
    """SELECT 'traces_processed' AS metric, '' AS label, count(*) AS value FROM summaries
UNION ALL SELECT 'incomplete_traces', incompleteness_reason, count(*) FROM summaries WHERE NOT complete GROUP BY ALL
UNION ALL SELECT 'orphan_spans', classification, count(*) FROM classes WHERE classification <> 'ok' GROUP BY ALL""",
)
def _(a, spark, sf):
    return reassembly.reassembly_counters(a.summaries, a.classifications)


# --- aggregations ---------------------------------------------------------


@query("service_stats", f"SELECT window_start, callee AS service_name, call_count, error_count, {STATS_SQL} FROM stats WHERE target_type = 'service'")
def _(a, spark, sf):
    return aggregates.service_stats(a.spans)


@query(
    "service_edges",
    f"SELECT window_start, caller AS caller_service, callee AS callee_service, call_count, error_count, {STATS_SQL} FROM stats WHERE target_type = 'edge'",
)
def _(a, spark, sf):
    return aggregates.service_edges(a.pairs)


_SERVICE_MS = "(SELECT service_name, (end_ns - start_ns) / 1e6 AS ms FROM spans)"


@query(
    "percentile",
    f"""SELECT service_name, count(*) AS n, round(quantile_cont(ms, 0.0), 6) AS p0, round(quantile_cont(ms, 0.25), 6) AS p25,
 round(quantile_cont(ms, 0.999), 6) AS p999 FROM {_SERVICE_MS} GROUP BY 1""",
)
def _(a, spark, sf):
    calls = aggregates.service_calls(a.spans).select(F.col("callee").alias("service_name"), "duration_ns")
    out = quantiles.percentiles(calls, ["service_name"], "duration_ns", [0.0, 0.25, 0.999])
    return out.select("service_name", "n", *[(F.col(f"p{i}") / 1e6).alias(p) for i, p in enumerate(("p0", "p25", "p999"))])


@query("median_mad", f"SELECT service_name, count(*) AS n, round(median(ms), 6) AS median_ms, round(mad(ms), 6) AS mad_ms FROM {_SERVICE_MS} GROUP BY 1")
def _(a, spark, sf):
    calls = aggregates.service_calls(a.spans).select(F.col("callee").alias("service_name"), "duration_ns")
    out = quantiles.median_mad(calls, ["service_name"], "duration_ns")
    return out.select("service_name", "n", (F.col("median") / 1e6).alias("median_ms"), (F.col("mad") / 1e6).alias("mad_ms"))


@query(
    "error_rates",
    """SELECT target_type, target, sum(call_count)::BIGINT AS call_count, sum(error_count)::BIGINT AS error_count,
 round(sum(error_count) / sum(call_count)::DOUBLE, 6) AS error_rate FROM stats GROUP BY ALL""",
)
def _(a, spark, sf):
    return aggregates.error_rates(a.stats, ["target_type", "target"])


# --- telemetry ------------------------------------------------------------

_AGE = "(SELECT service_name, (ingested_ns - end_ns) / 1e9 AS age FROM spans)"
_AGE_BUCKETS = f"""(SELECT service_name, le, count(*) FILTER (age <= le) AS cumulative FROM {_AGE},
 (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300, 'Infinity'::DOUBLE]) AS le) GROUP BY ALL)"""


def _ages(a: Analysis) -> DataFrame:
    return telemetry.histogram(telemetry.span_age(a.spans), "age_s", telemetry.SPAN_AGE_BOUNDS, ["service_name"])


def _finite(df: DataFrame) -> DataFrame:
    return df.withColumn("le", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")))


@query(
    "histogram",
    f"SELECT service_name, CASE WHEN le = 'Infinity'::DOUBLE THEN '+Inf' ELSE le::VARCHAR END AS le, cumulative FROM {_AGE_BUCKETS}",
)
def _(a, spark, sf):
    return _finite(_ages(a))


@query(
    "histogram_quantile",
    f"""SELECT service_name, round(arg_min(CASE WHEN le = 'Infinity'::DOUBLE THEN low ELSE low + (le - low) * (rank - before) / (cumulative - before) END, le), 6) AS quantile
FROM (SELECT *, 0.99 * max(cumulative) OVER (PARTITION BY service_name) AS rank,
  coalesce(lag(le) OVER (PARTITION BY service_name ORDER BY le), 0) AS low,
  coalesce(lag(cumulative) OVER (PARTITION BY service_name ORDER BY le), 0) AS before FROM {_AGE_BUCKETS})
WHERE cumulative >= rank AND cumulative > before GROUP BY 1""",
)
def _(a, spark, sf):
    return telemetry.histogram_quantile(_ages(a), 0.99, ["service_name"])


# Counter samples every 5 s per service: spans sent so far in the hour (the counter restarts hourly).
_SAMPLES = f"""(SELECT metric, instance, ts, sum(n) OVER (PARTITION BY metric, instance, ts // 3600 ORDER BY ts)::DOUBLE AS value
FROM (SELECT 'spans_total' AS metric, service_name AS instance, ((start_ns // 5000000000) + 1) * 5 AS ts, count(*) AS n FROM spans GROUP BY ALL))"""


def _samples(a: Analysis) -> DataFrame:
    ts = (int_div(F.col("start_time_unix_nano"), 5 * NS) + 1) * 5
    per = a.spans.groupBy(
        F.lit("spans_total").alias("metric"), F.col("service_name").alias("instance"), ts.alias("ts")
    ).agg(F.count(F.lit(1)).alias("n"))
    hour = Window.partitionBy("metric", "instance", int_div(F.col("ts"), 3600)).orderBy("ts")
    return per.select("metric", "instance", "ts", F.sum("n").over(hour).cast("double").alias("value"))


@query(
    "counter_increases",
    f"""SELECT metric, instance, ts, value, CASE WHEN prev IS NULL THEN NULL WHEN value >= prev THEN value - prev ELSE value END AS increase
FROM (SELECT *, lag(value) OVER (PARTITION BY metric, instance ORDER BY ts) AS prev FROM {_SAMPLES})""",
)
def _(a, spark, sf):
    return telemetry.counter_increases(_samples(a)).select("metric", "instance", "ts", "value", "increase")


_RATES = f"""(SELECT metric, instance, step, sum(rise) / (max(ts) - min(ts)) AS rate
FROM (SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN value >= prev THEN value - prev ELSE value END AS rise
  FROM (SELECT *, lag(value) OVER (PARTITION BY metric, instance, step ORDER BY ts) AS prev
    FROM (SELECT *, ts // 300 AS step FROM {_SAMPLES}) WHERE ts >= (step + 1) * 300 - 120))
GROUP BY ALL HAVING max(ts) > min(ts))"""


@query("counter_rate", f"SELECT metric, instance, step, round(rate, 6) AS rate FROM {_RATES}")
def _(a, spark, sf):
    return telemetry.counter_rate(_samples(a), 300)


# A "run" per service pair: shipping consumes what search publishes, in steps repeated once.
_STEPS = f"""(SELECT 'r' || (p.step % 3) AS run, p.step AS sequence, p.step // 6 AS target_rate, p.rate AS published, c.rate AS consumed
FROM {_RATES} p JOIN {_RATES} c ON c.step = p.step AND p.instance = 'search' AND c.instance = 'shipping')"""


@query(
    "throughput_verdict",
    f"""SELECT run, sequence, falling_behind, confirmed, coalesce(sequence = min(sequence) FILTER (confirmed) OVER (PARTITION BY run), false) AS breaking_point
FROM (SELECT *, falling_behind AND coalesce(lead(falling_behind) OVER (PARTITION BY run ORDER BY sequence)
    AND lead(target_rate) OVER (PARTITION BY run ORDER BY sequence) = target_rate, false) AS confirmed
  FROM (SELECT *, consumed < 0.98 * published AS falling_behind FROM {_STEPS}))""",
)
def _(a, spark, sf):
    rates = write_scratch(telemetry.counter_rate(_samples(a), 300), "rates")
    published = rates.filter("instance = 'search'").select("step", F.col("rate").alias("published"))
    consumed = rates.filter("instance = 'shipping'").select("step", F.col("rate").alias("consumed"))
    steps = published.join(consumed, "step").select(
        F.concat(F.lit("r"), (F.col("step") % 3).cast("string")).alias("run"),
        F.col("step").alias("sequence"),
        F.floor(F.col("step") / 6).alias("target_rate"),
        "published",
        "consumed",
    )
    return telemetry.throughput_verdict(steps).select("run", "sequence", "falling_behind", "confirmed", "breaking_point")


# Batches: spans of 2 s of ingestion per service; steps of 10 minutes; totals run on over the steps.
_BATCHES = "(SELECT service_name AS metric, ingested_ns // 2000000000 // 300 AS step, ingested_ns // 2000000000 AS slot, count(*) AS size FROM spans GROUP BY ALL)"
_BATCH_BUCKETS = f"""(SELECT metric, step, le, sum(n) OVER (PARTITION BY metric, le ORDER BY step)::BIGINT AS cumulative
FROM (SELECT metric, step, le, count(*) FILTER (size <= le) AS n FROM {_BATCHES},
 (SELECT unnest([1, 10, 50, 100, 500, 1000, 2500, 5000, 10000, 'Infinity'::DOUBLE]) AS le) GROUP BY ALL))"""


@query(
    "histogram_delta",
    f"""SELECT metric, step, max(d)::BIGINT AS observations, (sum(d) FILTER (le = 10) - sum(d) FILTER (le = 1))::BIGINT AS in_range,
 round((sum(d) FILTER (le = 10) - sum(d) FILTER (le = 1)) / max(d)::DOUBLE, 6) AS share
FROM (SELECT *, cumulative - coalesce(lag(cumulative) OVER (PARTITION BY metric, le ORDER BY step), 0) AS d FROM {_BATCH_BUCKETS}) GROUP BY ALL""",
)
def _(a, spark, sf):
    slot = int_div(F.col("ingested_at_unix_nano"), 2 * NS)
    batches = a.spans.groupBy(
        F.col("service_name").alias("metric"), int_div(slot, 300).alias("step"), slot.alias("slot")
    ).agg(F.count(F.lit(1)).alias("size"))
    own = telemetry.histogram(batches, "size", telemetry.BATCH_SIZE_BOUNDS, ["metric", "step"])
    series = Window.partitionBy("metric", "le").orderBy("step")
    running = own.withColumn("cumulative", F.sum("cumulative").over(series))
    return telemetry.histogram_delta(running, 1.0, 10.0)


# --- clock ----------------------------------------------------------------


@query(
    "clock_violations",
    """SELECT trace_id, window_start, parent_id AS parent_span_id, child_id AS child_span_id, caller AS caller_service, callee AS callee_service,
 CASE WHEN c_start < p_start THEN 'starts_before_parent' ELSE 'ends_after_parent' END AS kind FROM pairs WHERE c_start < p_start OR c_end > p_end ORDER BY ALL""",
)
def _(a, spark, sf):
    return clock.clock_violations(a.pairs)


@query("violation_counts", "SELECT callee AS service_name, count(*) AS violations FROM pairs WHERE c_start < p_start OR c_end > p_end GROUP BY 1")
def _(a, spark, sf):
    return clock.violation_counts(clock.clock_violations(a.pairs))


@query("edge_gap_median", "SELECT window_start, caller AS caller_service, callee AS callee_service, n, median_gap AS median_gap_ns FROM gaps")
def _(a, spark, sf):
    return clock.edge_gap_medians(a.pairs)


@query("typical_gap", "SELECT window_start, typical_gap AS typical_gap_ns FROM typical")
def _(a, spark, sf):
    return clock.typical_gaps(a.gaps)


@query("primary_caller", "SELECT window_start, callee AS callee_service, caller AS caller_service, n, median_gap AS median_gap_ns FROM primary_edges")
def _(a, spark, sf):
    return clock.primary_callers(a.gaps)


@query("clock_offsets", "SELECT window_start, service_name, offset_ns, confidence FROM offsets")
def _(a, spark, sf):
    return clock.clock_offsets(a.pairs)


# --- baselines and detectors ----------------------------------------------


@query("lookback_spans", f"SELECT {SLIM_SQL} FROM spans WHERE start_ns >= {(BASE + 300) * NS} AND start_ns < {(BASE + 1200) * NS}")
def _(a, spark, sf):
    return baseline.lookback_spans(a.spans, BASE + 1200).select(*SLIM)


@query("service_baseline", f"SELECT as_of, callee AS service_name, {BASELINE_SQL} FROM baselines WHERE target_type = 'service'")
def _(a, spark, sf):
    table = baseline.baselines(a.spans, a.any_pairs, a.stats, a.spine)
    return baseline.as_service_baselines(table)


@query("edge_baseline", f"SELECT as_of, caller AS caller_service, callee AS callee_service, {BASELINE_SQL} FROM baselines WHERE target_type = 'edge'")
def _(a, spark, sf):
    return baseline.as_edge_baselines(a.baselines)


@query(
    "call_rate_history",
    """SELECT as_of, target_type, target, window_count_observed, call_rate_median::DOUBLE AS call_rate_median, call_rate_mad::DOUBLE AS call_rate_mad FROM history""",
)
def _(a, spark, sf):
    table = baseline.call_rate_history(a.stats).join(
        a.spine.select(F.col("window_start").alias("as_of")), "as_of", "left_semi"
    )
    label = aggregates.target_label().alias("target")
    return table.select("as_of", "target_type", label, "window_count_observed", "call_rate_median", "call_rate_mad")


@query("baseline_cold_counts", "SELECT as_of, target_type, count(*) AS cold FROM baselines WHERE NOT ready GROUP BY ALL")
def _(a, spark, sf):
    return baseline.cold_counts(a.baselines)


@query("detect_percentile_deviation", f"SELECT {DETECTION_SQL} FROM d_percentile")
def _(a, spark, sf):
    return detect.detect_percentile_deviation(a.stats, a.baselines).select(*DETECTION)


@query("detect_error_rate", f"SELECT {DETECTION_SQL} FROM d_error")
def _(a, spark, sf):
    return detect.detect_error_rate(a.stats, a.baselines).select(*DETECTION)


@query("detect_call_rate_drop", f"SELECT {DETECTION_SQL} FROM d_rate")
def _(a, spark, sf):
    return detect.detect_call_rate_drop(a.stats, a.baselines).select(*DETECTION)


@query("run_detection", f"SELECT {DETECTION_SQL} FROM detections")
def _(a, spark, sf):
    return detect.run_detection(a.stats, a.baselines).select(*DETECTION)


@query(
    "robust_z_severity",
    """SELECT s.window_start, s.target_type, s.target, round((p99 - latency_median_ms) / (1.4826 * latency_mad_ms), 6) AS z,
 CASE WHEN (p99 - latency_median_ms) / (1.4826 * latency_mad_ms) > 7.0 THEN 'critical' ELSE 'warning' END AS severity
FROM stats s JOIN baselines b ON b.as_of = s.window_start AND b.target_type = s.target_type AND b.target = s.target WHERE latency_mad_ms > 0""",
)
def _(a, spark, sf):
    base = a.baselines.withColumnRenamed("as_of", "window_start")
    z = detect.robust_z(F.col("latency_p99_ms"), F.col("latency_median_ms"), F.col("latency_mad_ms"))
    joined = a.stats.join(base, ["window_start", "target_type", "target"]).withColumn("z", z).filter("z IS NOT NULL")
    return joined.select("window_start", "target_type", "target", "z", detect.severity(F.col("z"), 3.5).alias("severity"))


# --- incidents ------------------------------------------------------------


@query("recent_detections", f"SELECT {DETECTION_SQL} FROM detections WHERE window_start {RANGE_SQL}")
def _(a, spark, sf):
    return incidents.recent_detections(a.detections, *RANGE).select(*DETECTION)


@query("group_detections", f"SELECT {INCIDENT_SQL} FROM grouped")
def _(a, spark, sf):
    return incidents.group_detections(a.detections).select(*INCIDENT)


@query(
    "incident_peak",
    """SELECT target_type, target, detector, severity, round(deviation, 6) AS deviation, window_start FROM (SELECT *, row_number() OVER (PARTITION BY target_type, target, detector
 ORDER BY CASE severity WHEN 'critical' THEN 2 ELSE 1 END DESC, abs(deviation) DESC, window_start) AS rn FROM detections) WHERE rn = 1""",
)
def _(a, spark, sf):
    peak = F.max_by(F.struct("severity", "deviation", "window_start"), incidents.peak_order()).alias("_p")
    return a.detections.groupBy("target_type", "target", "detector").agg(peak).select("target_type", "target", "detector", "_p.*")


@query("topology_edges", "SELECT caller AS caller_service, callee AS callee_service FROM topology")
def _(a, spark, sf):
    return incidents.topology_edges(a.service_edges)


@query(
    "incident_overlap",
    """SELECT a.incident_id, b.incident_id AS other_id, b.target AS other_target FROM grouped a JOIN grouped b
 ON b.target = a.target AND b.target_type = a.target_type AND a.start_window <= b.end_window AND b.start_window <= a.end_window""",
)
def _(a, spark, sf):
    pairs = incidents.incident_overlap(a.grouped, a.grouped, ["target_type", "target"])
    return pairs.select("incident_id", "other_id", "other_target")


@query("suppress_propagated", f"SELECT {INCIDENT_SQL}, derived, root_cause_incident_id FROM incidents")
def _(a, spark, sf):
    return incidents.suppress_propagated(a.grouped, a.service_edges).select(*INCIDENT, "derived", "root_cause_incident_id")


@query("suppress_service_roots", "SELECT incident_id, root_id FROM roots")
def _(a, spark, sf):
    return incidents.service_roots(a.grouped, a.service_edges).select("incident_id", "root_id")


@query(
    "rolling_regroup",
    f"""SELECT {INCIDENT_SQL}, derived, root_cause_incident_id FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY as_of DESC) AS rn
 FROM r_incidents) WHERE rn = 1""",
)
def _(a, spark, sf):
    out = incidents.rolling_regroup(a.detections, a.service_edges, a.spine)
    return out.select(*INCIDENT, "derived", "root_cause_incident_id")


@query(
    "incident_counters",
    """SELECT coalesce(o.as_of, s.as_of) AS window_start, coalesce(incidents_open, 0) AS incidents_open, coalesce(suppressed_count, 0) AS suppressed_count
FROM (SELECT as_of, count(*) AS incidents_open FROM r_incidents WHERE end_window = as_of GROUP BY 1) o
FULL JOIN (SELECT d.window_start AS as_of, count(*) AS suppressed_count FROM detections d WHERE EXISTS (SELECT 1 FROM r_incidents i
  WHERE i.as_of = d.window_start AND i.derived AND i.target_type = d.target_type AND i.target = d.target AND i.detector = d.detector) GROUP BY 1) s
ON s.as_of = o.as_of""",
)
def _(a, spark, sf):
    return incidents.incident_counters(a.rolling, a.detections)


# --- read queries ---------------------------------------------------------

_DURATION = "(SELECT trace_id, round((max(end_ns) - min(start_ns)) / 1e6, 6) AS duration_ms FROM spans GROUP BY 1)"


@query("q_trace_durations", f"SELECT trace_id, duration_ms FROM {_DURATION}")
def _(a, spark, sf):
    return queries.q_trace_durations(a.spans)


_SUMMARY_COLUMNS = "trace_id, window_start, depth, span_count, root_service, complete, incompleteness_reason, orphan_count"


@query(
    "q_traces",
    f"""SELECT row_number() OVER (ORDER BY window_start DESC, trace_id)::INTEGER AS position, {_SUMMARY_COLUMNS}, duration_ms,
 n > 45 AS has_more, false AS duration_filter_truncated FROM (SELECT *, count(*) OVER () AS n FROM summaries LEFT JOIN {_DURATION} d USING (trace_id)
  WHERE window_start {RANGE_SQL} AND root_service = 'frontend' AND coalesce(duration_ms, 0) >= 450.0)
 QUALIFY position > 5 AND position <= 45""",
)
def _(a, spark, sf):
    return queries.q_traces(
        a.summaries, a.spans, *RANGE, service="frontend", min_duration_ms=450.0, limit=40, offset=5
    )


@query(
    "q_traces_incomplete",
    f"""SELECT row_number() OVER (ORDER BY window_start DESC, trace_id)::INTEGER AS position, {_SUMMARY_COLUMNS}, duration_ms,
 n > 700 AS has_more, false AS duration_filter_truncated FROM (SELECT *, count(*) OVER () AS n FROM summaries LEFT JOIN {_DURATION} d USING (trace_id)
  WHERE window_start {RANGE_SQL} AND NOT complete) QUALIFY position <= 700""",
)
def _(a, spark, sf):
    return queries.q_traces(a.summaries, a.spans, *RANGE, complete=False, limit=700)


def _one_trace() -> str:
    """The trace id of order 42."""
    return format(43, "x")[::-1].ljust(32, "0")


_AS_OF = f"""(SELECT service_name, arg_max(offset_ns, window_start) AS offset_ns, arg_max(confidence, window_start) AS confidence FROM offsets
 WHERE window_start * 1000000000 <= (SELECT min(start_ns) FROM spans WHERE trace_id = {oracle.tid('42')}) GROUP BY 1)"""


@query(
    "q_trace_detail",
    f"""SELECT s.span_id, s.parent_span_id, s.service_name, s.span_name, s.start_ns AS start_time_unix_nano, s.end_ns AS end_time_unix_nano,
 s.status_code, s.attributes, c.classification, o.offset_ns, o.confidence FROM spans s LEFT JOIN classes c USING (trace_id, span_id)
 LEFT JOIN {_AS_OF} o USING (service_name)
WHERE s.trace_id = {oracle.tid('42')}""",
)
def _(a, spark, sf):
    out = queries.q_trace_detail(a.spans, a.classifications, _one_trace(), a.offsets)
    # Maps have no order: as sorted text.
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("attributes", F.coalesce(F.array_join(pairs, ","), F.lit("")))


@query(
    "q_offsets_as_of",
    f"""SELECT service_name, arg_max(offset_ns, window_start) AS offset_ns, arg_max(confidence, window_start) AS confidence FROM offsets
WHERE window_start * 1000000000 <= (SELECT min(start_ns) FROM spans WHERE trace_id = {oracle.tid('42')})
 AND service_name IN (SELECT service_name FROM spans WHERE trace_id = {oracle.tid('42')}) GROUP BY 1""",
)
def _(a, spark, sf):
    return queries.q_offsets_as_of(a.spans, a.offsets, _one_trace())


@query(
    "q_topology",
    f"""SELECT caller AS caller_service, callee AS callee_service, sum(call_count)::BIGINT AS call_count, sum(error_count)::BIGINT AS error_count,
 round(arg_max(p50, window_start), 6) AS latency_p50_ms, round(arg_max(p95, window_start), 6) AS latency_p95_ms, round(arg_max(p99, window_start), 6) AS latency_p99_ms,
 max(window_start) AS latest_window_start, round(sum(error_count) / sum(call_count)::DOUBLE, 6) AS error_rate, false AS has_more
FROM stats WHERE target_type = 'edge' AND window_start {RANGE_SQL}
 AND (caller = 'catalog' OR callee = 'catalog') GROUP BY ALL""",
)
def _(a, spark, sf):
    return queries.q_topology(a.service_edges, *RANGE, service="catalog")


@query(
    "q_detections",
    f"""SELECT p.incident_id, p.target_type, p.target, p.detector, p.peak_severity AS severity, p.start_window, p.end_window, p.window_count,
 round(p.peak_deviation, 6) AS peak_deviation, p.derived, nullif(p.root_cause_incident_id, '') AS root_cause_incident_id, r.target AS root_cause_target, false AS has_more
FROM (SELECT * FROM incidents WHERE end_window >= {RANGE[0]} AND start_window <= {RANGE[1]}) p
LEFT JOIN (SELECT * FROM incidents WHERE end_window >= {RANGE[0]} AND start_window <= {RANGE[1]}) r ON r.incident_id = p.root_cause_incident_id""",
)
def _(a, spark, sf):
    return queries.q_detections(a.incidents, *RANGE)


@query(
    "q_clock_offsets",
    f"""SELECT service_name, offset_ns, confidence, window_start FROM (SELECT *, row_number() OVER (PARTITION BY service_name
 ORDER BY confidence DESC, window_start DESC) AS rn FROM offsets WHERE window_start {RANGE_SQL}) WHERE rn = 1""",
)
def _(a, spark, sf):
    return queries.q_clock_offsets(a.offsets, *RANGE)


# --- shape ----------------------------------------------------------------

_TREE = """t_kinds AS (SELECT s.*, CASE WHEN s.parent_span_id = '' THEN 'root' WHEN p.span_id IS NULL THEN 'orphan' ELSE 'linked' END AS t_kind
 FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id AND s.parent_span_id <> ''),
t_walk AS (SELECT trace_id, span_id, parent_span_id, t_kind, t_kind AS top, 0::BIGINT AS depth, [span_id] AS above FROM t_kinds WHERE t_kind <> 'linked'
 UNION ALL SELECT k.trace_id, k.span_id, k.parent_span_id, k.t_kind, w.top, w.depth + 1, list_append(w.above, k.span_id)
 FROM t_walk w JOIN t_kinds k ON k.trace_id = w.trace_id AND k.parent_span_id = w.span_id AND k.t_kind = 'linked')"""


def _with_tree(final: str) -> str:
    full = sql("SELECT 1 FROM spans")
    return full[: full.rindex("\nSELECT 1")] + ",\n" + _TREE + "\n" + final


def tree_query(name: str, final: str):
    def wrap(fn):
        query(name)(fn)
        REGISTRY[name] = (REGISTRY[name][0], _with_tree(final))
        return fn

    return wrap


@tree_query(
    "span_tree",
    "SELECT trace_id, span_id, parent_span_id, depth, t_kind = 'orphan' AS is_orphan, top = 'orphan' AS in_orphan_subtree FROM t_walk",
)
def _(a, spark, sf):
    return shape.span_tree(a.spans)


@tree_query(
    "subtree_sizes",
    """SELECT trace_id, span_id, depth, descendants, CASE WHEN depth = 8 THEN descendants ELSE 0 END AS hidden_descendants
FROM (SELECT w.trace_id, w.span_id, w.depth, coalesce(n, 0) AS descendants FROM t_walk w LEFT JOIN (
 SELECT trace_id, anc AS span_id, count(*) AS n FROM (SELECT trace_id, span_id, unnest(above) AS anc FROM t_walk) WHERE anc <> span_id GROUP BY ALL) d
 USING (trace_id, span_id))""",
)
def _(a, spark, sf):
    return shape.subtree_sizes(a.spans)


@query("trace_bounds", "SELECT trace_id, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM spans GROUP BY 1")
def _(a, spark, sf):
    return shape.trace_bounds(a.spans)


@query(
    "span_fraction",
    """SELECT trace_id, span_id, CASE WHEN z <= a THEN 0.0 ELSE round((start_ns - a)::DOUBLE / (z - a), 6) END AS "left",
 CASE WHEN z <= a THEN 1.0 ELSE round(greatest((end_ns - start_ns)::DOUBLE / (z - a), 0.001), 6) END AS width
FROM (SELECT *, min(start_ns) OVER (PARTITION BY trace_id) AS a, max(end_ns) OVER (PARTITION BY trace_id) AS z FROM spans)""",
)
def _(a, spark, sf):
    return shape.span_fraction(a.spans)


@query("service_depths", "SELECT service, depth FROM depths")
def _(a, spark, sf):
    return shape.service_depths(a.service_edges)


@query(
    "worst_incident_per_service",
    """SELECT target, peak_severity AS severity, derived, incident_id FROM (SELECT *, row_number() OVER (PARTITION BY target
 ORDER BY CASE peak_severity WHEN 'critical' THEN 2 ELSE 1 END DESC, start_window DESC, incident_id DESC) AS rn FROM incidents WHERE target_type = 'service') WHERE rn = 1""",
)
def _(a, spark, sf):
    return shape.worst_incident_per_service(a.incidents)


@query(
    "skewed_spans",
    """SELECT s.trace_id, s.span_id, s.service_name, o.offset_ns, o.confidence
FROM spans s JOIN (SELECT trace_id, min(start_ns) AS begun FROM spans GROUP BY 1) t USING (trace_id)
ASOF JOIN offsets o ON o.service_name = s.service_name AND t.begun // 1000000000 >= o.window_start
WHERE o.confidence >= 30 AND abs(o.offset_ns) > 1000000""",
)
def _(a, spark, sf):
    return shape.skewed_spans(a.spans, a.offsets, a.spine)


@query(
    "incident_example_traces",
    """SELECT incident_id, position, window_start, trace_id FROM (SELECT i.incident_id, s.window_start, s.trace_id,
 row_number() OVER (PARTITION BY i.incident_id ORDER BY s.window_start DESC, s.trace_id)::INTEGER AS position
 FROM incidents i JOIN summaries s ON s.window_start BETWEEN i.start_window AND i.end_window) WHERE position <= 5""",
)
def _(a, spark, sf):
    return shape.incident_example_traces(a.incidents, a.summaries)


# --- evaluation -----------------------------------------------------------


def _windows_of_runs(gt: dict[str, DataFrame]) -> DataFrame:
    return evaluate.run_windows(evaluate.eval_run_range(gt["spans"]))


def _eval_inputs(a: Analysis, spark: SparkSession, sf: str):
    gt = _ground_truth(spark, sf)
    spread = _windows_of_runs(gt)
    return gt, spread, evaluate.true_incidents(gt["incidents"]), evaluate.run_incidents(a.incidents, spread)


@query("eval_run_range", "SELECT run_id, lo_ns, hi_ns, from_ns, to_ns FROM ranges")
def _(a, spark, sf):
    return evaluate.eval_run_range(_ground_truth(spark, sf)["spans"])


@query("eval_landed", "SELECT run_id, trace_id, span_id FROM landed")
def _(a, spark, sf):
    return evaluate.eval_landed(_ground_truth(spark, sf)["spans"], a.spans)


@query("eval_classifications", "SELECT run_id, trace_id, span_id, classification FROM e_classes")
def _(a, spark, sf):
    return evaluate.eval_classifications(_ground_truth(spark, sf)["spans"], a.classifications)


_PRF_SQL = "round(edge_precision, 6) AS edge_precision, round(edge_recall, 6) AS edge_recall, round(edge_f1, 6) AS edge_f1"


@query("eval_edges_prf", f"SELECT run_id, true_edge_count, found_edge_count, edge_true_positive_count, {_PRF_SQL} FROM edges_prf")
def _(a, spark, sf):
    gt = _ground_truth(spark, sf)
    return evaluate.eval_edges_prf(gt["edges"], a.service_edges, _windows_of_runs(gt))


_ATTACH_SQL = """attachment_denominator, attachment_correct, orphan_denominator, orphan_correct,
 round(attachment_correct / nullif(attachment_denominator, 0)::DOUBLE, 6) AS attachment_accuracy, round(orphan_correct / nullif(orphan_denominator, 0)::DOUBLE, 6) AS orphan_accuracy"""


@query("eval_attachment", f"SELECT run_id, {_ATTACH_SQL} FROM attachment")
def _(a, spark, sf):
    gt = _ground_truth(spark, sf)["spans"]
    return evaluate.eval_attachment(gt, evaluate.eval_landed(gt, a.spans), evaluate.eval_classifications(gt, a.classifications))


_CLOCK_ERROR_SQL = """SELECT g.run_id, g.service_name, g.offset_ns AS true_ns, d.offset_ns AS detected_ns, d.offset_ns - g.offset_ns AS error_ns
FROM gt_offsets g JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, service_name ORDER BY confidence DESC, window_start DESC) AS rn
 FROM (SELECT r.run_id, o.* FROM offsets o JOIN ranges r ON o.window_start * 1000000000 BETWEEN r.from_ns AND r.to_ns)) d
ON d.run_id = g.run_id AND d.service_name = g.service_name AND d.rn = 1"""


@query("eval_clock_error", _CLOCK_ERROR_SQL)
def _(a, spark, sf):
    gt = _ground_truth(spark, sf)
    return evaluate.eval_clock_error(gt["offsets"], a.offsets, _windows_of_runs(gt))


@query("eval_incident_match", "SELECT run_id, incident_id, type, matches, detected, first_window FROM matched")
def _(a, spark, sf):
    _, _, true, found = _eval_inputs(a, spark, sf)
    return evaluate.eval_incident_match(true, found).select("run_id", "incident_id", "type", "matches", "detected", "first_window")


_LATENCY_SQL = "CASE WHEN detected THEN greatest(0.0, first_window + 60 - start_time)::DOUBLE END"


@query("eval_detection_latency", f"SELECT run_id, incident_id, detected, {_LATENCY_SQL} AS detection_latency_seconds FROM matched")
def _(a, spark, sf):
    _, _, true, found = _eval_inputs(a, spark, sf)
    out = evaluate.eval_detection_latency(evaluate.eval_incident_match(true, found))
    return out.select("run_id", "incident_id", "detected", "detection_latency_seconds")


@query(
    "eval_root_cause",
    "SELECT run_id, root_cause_total, root_cause_correct, round(root_cause_correct / root_cause_total::DOUBLE, 6) AS root_cause_accuracy FROM root_cause",
)
def _(a, spark, sf):
    _, _, true, found = _eval_inputs(a, spark, sf)
    return evaluate.eval_root_cause(true, found)


_IPRF_SQL = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


@query("eval_incident_prf", f"SELECT run_id, true_incident_count, found_incident_count, true_positive_count, {_IPRF_SQL} FROM incident_prf")
def _(a, spark, sf):
    gt, _, true, found = _eval_inputs(a, spark, sf)
    ranges = evaluate.eval_run_range(gt["spans"])
    return evaluate.eval_incident_prf(ranges, evaluate.eval_incident_match(true, found), true, found)


@query(
    "eval_healthy_rate",
    "SELECT run_id, total_detection_count, round(healthy_control_detections_per_hour, 6) AS healthy_control_detections_per_hour FROM healthy",
)
def _(a, spark, sf):
    gt, spread, true, _ = _eval_inputs(a, spark, sf)
    return evaluate.eval_healthy_rate(evaluate.eval_run_range(gt["spans"]), true, a.detections, spread)


@query("eval_observed_magnitude", "SELECT run_id, incident_id, round(observed_magnitude, 6) AS observed_magnitude FROM observed")
def _(a, spark, sf):
    true = evaluate.true_incidents(_ground_truth(spark, sf)["incidents"])
    return evaluate.eval_observed_magnitude(true, a.stats, a.baselines)


@query("asof_bounded", "SELECT run_id, incident_id, call_count, error_count, round(p99, 6) AS latency_p99_ms FROM middle")
def _(a, spark, sf):
    true = evaluate.true_incidents(_ground_truth(spark, sf)["incidents"])
    points = true.withColumn("at", (F.col("start_time") + F.col("end_time")) / 2)
    return evaluate.asof_bounded(points, a.stats).select("run_id", "incident_id", "call_count", "error_count", "latency_p99_ms")


@query(
    "asof_ready_baseline",
    "SELECT run_id, incident_id, round(latency_median_ms, 6) AS latency_median_ms, round(call_rate_median, 6) AS call_rate_median FROM before",
)
def _(a, spark, sf):
    true = evaluate.true_incidents(_ground_truth(spark, sf)["incidents"])
    points = true.select("run_id", "incident_id", "target_type", "target", F.col("start_time").alias("at"))
    return evaluate.asof_ready_baseline(points, a.baselines).select("run_id", "incident_id", "latency_median_ms", "call_rate_median")


@query("eval_depths", "SELECT t.run_id, t.incident_id, t.target, d.depth AS target_depth FROM true_inc t LEFT JOIN depths d ON d.service = t.target")
def _(a, spark, sf):
    true = evaluate.true_incidents(_ground_truth(spark, sf)["incidents"])
    return evaluate.eval_depths(true, shape.service_depths(a.service_edges))


_DETAILS = f"""(SELECT m.run_id, m.incident_id, m.type, m.target_type, m.target, d.depth AS target_depth, m.magnitude::DOUBLE AS magnitude, m.detected,
 {_LATENCY_SQL} AS detection_latency_seconds, round(o.observed_magnitude, 6) AS observed_magnitude
 FROM matched m LEFT JOIN observed o USING (run_id, incident_id) LEFT JOIN depths d ON d.service = m.target)"""


@query("eval_incident_details", f"SELECT * FROM {_DETAILS}")
def _(a, spark, sf):
    _, _, true, found = _eval_inputs(a, spark, sf)
    return evaluate.incident_details(true, found, a.stats, a.baselines, shape.service_depths(a.service_edges))


@query(
    "evaluate",
    f"""SELECT r.run_id, (SELECT count(*) FROM gt_spans g WHERE g.run_id = r.run_id) AS ground_truth_span_count,
 (SELECT count(*) FROM landed l WHERE l.run_id = r.run_id) AS landed_span_count,
 true_edge_count, found_edge_count, edge_true_positive_count, {_PRF_SQL}, {_ATTACH_SQL},
 true_incident_count, found_incident_count, true_positive_count, {_IPRF_SQL}, coalesce(root_cause_total, 0) AS root_cause_total,
 coalesce(root_cause_correct, 0) AS root_cause_correct, round(root_cause_correct / root_cause_total::DOUBLE, 6) AS root_cause_accuracy,
 total_detection_count, round(healthy_control_detections_per_hour, 6) AS healthy_control_detections_per_hour,
 coalesce(clock_offset_count, 0) AS clock_offset_count, round(clock_offset_mean_error_ns, 6) AS clock_offset_mean_error_ns, clock_offset_max_error_ns
FROM ranges r LEFT JOIN (SELECT run_id, count(*) AS clock_offset_count, avg(abs(error_ns)) AS clock_offset_mean_error_ns, max(abs(error_ns)) AS clock_offset_max_error_ns
 FROM ({_CLOCK_ERROR_SQL}) GROUP BY run_id) USING (run_id) LEFT JOIN edges_prf USING (run_id) LEFT JOIN attachment USING (run_id) LEFT JOIN incident_prf USING (run_id)
LEFT JOIN root_cause USING (run_id) LEFT JOIN healthy USING (run_id)""",
)
def _(a, spark, sf):
    tables = {
        "spans": a.spans,
        "classifications": a.classifications,
        "edges": a.service_edges,
        "incidents": a.incidents,
        "detections": a.detections,
        "offsets": a.offsets,
    }
    return evaluate.evaluate(_ground_truth(spark, sf), tables)


_POINTS = """(SELECT run_id, type, count(*) AS true_incident_count, count(*) FILTER (detected) AS true_positive_count,
 (SELECT count(DISTINCT (f.target_type, f.target)) FROM run_inc f WHERE f.run_id = m.run_id AND f.detector = m.detector AND NOT f.derived
  AND EXISTS (SELECT 1 FROM true_inc t WHERE t.run_id = f.run_id AND t.type = m.type AND f.start_window <= t.end_time AND t.start_time <= f.end_window)) AS found_incident_count
 FROM matched m GROUP BY run_id, type, detector)"""


def _points(a: Analysis, spark: SparkSession, sf: str) -> DataFrame:
    """An evaluation point per run and incident type."""
    _, _, true, found = _eval_inputs(a, spark, sf)
    typed = true.select("run_id", "type", "detector", "start_time", "end_time")
    kinds = typed.select("run_id", "type", "detector").distinct()
    own = found.filter("NOT derived").join(kinds, ["run_id", "detector"])
    hit = evaluate.overlapping_any(own, typed, 60, {"type": "type"})
    counted = hit.select("run_id", "type", "target_type", "target").distinct().groupBy("run_id", "type").agg(
        F.count(F.lit(1)).alias("found_incident_count")
    )
    truth = evaluate.eval_incident_match(true, found).groupBy("run_id", "type").agg(
        F.count(F.lit(1)).alias("true_incident_count"), F.count_if("detected").alias("true_positive_count")
    )
    return truth.join(counted, ["run_id", "type"], "left").fillna(0, ["found_incident_count"])


@query(
    "sweep_summary",
    f"""SELECT type, found_incident_count, true_positive_count, true_incident_count, {_IPRF_SQL} FROM (
 SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN precision + recall = 0 THEN 0.0 END AS f1 FROM (
  SELECT *, true_positive_count / nullif(found_incident_count, 0)::DOUBLE AS precision, true_positive_count / nullif(true_incident_count, 0)::DOUBLE AS recall FROM (
   SELECT type, sum(found_incident_count)::BIGINT AS found_incident_count, sum(true_positive_count)::BIGINT AS true_positive_count, sum(true_incident_count)::BIGINT AS true_incident_count FROM {_POINTS} GROUP BY 1)))""",
)
def _(a, spark, sf):
    return evaluate.sweep_summary(_points(a, spark, sf))


@query(
    "latency_distribution",
    f"""SELECT type, count(*) AS detected, round(min(s), 6) AS latency_min, round(quantile_cont(s, 0.25), 6) AS latency_p25, round(median(s), 6) AS latency_median,
 round(quantile_cont(s, 0.75), 6) AS latency_p75, round(max(s), 6) AS latency_max, round(avg(s), 6) AS latency_mean
FROM (SELECT type, {_LATENCY_SQL} AS s FROM matched WHERE detected) GROUP BY 1""",
)
def _(a, spark, sf):
    _, _, true, found = _eval_inputs(a, spark, sf)
    return evaluate.latency_distribution(evaluate.eval_detection_latency(evaluate.eval_incident_match(true, found)))


# --- streaming: the same results from streams over the same spans ----------


def _store(spark: SparkSession, name: str) -> TableStore:
    return TableStore(spark, scratch_path(spark, name))


_ARRIVALS: dict[tuple[str, str], tuple[str, int]] = {}
_PROCESSED: dict[tuple[str, str], TableStore] = {}


def arrivals(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A folder with the received spans in three pieces by arrival, and the number of files a piece."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _ARRIVALS:
        path = scratch_path(spark, "arrivals")
        _ARRIVALS[key] = path, tabular.arrivals(spark, sf_dir, path, 3)
    return _ARRIVALS[key]


def _stream(spark: SparkSession, sf_dir: str, pieces: int | None = None) -> DataFrame:
    """The received spans as a stream, ``pieces`` to a micro-batch (all without)."""
    path, files = arrivals(spark, sf_dir)
    return tabular.span_stream(spark, path, **({"maxFilesPerTrigger": pieces * files} if pieces else {}))


def processed(spark: SparkSession, sf_dir: str) -> TableStore:
    """The tables of a window processor that took a file at a time, run once per session."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _PROCESSED:
        store = _store(spark, "windows")
        stream = _stream(spark, sf_dir, 1)
        ingest.run_to_end(WindowProcessor(store).stream(stream, scratch_path(spark, "offsets"), available_now=True))
        _PROCESSED[key] = store
    return _PROCESSED[key]


@query("stream_ingest", f"SELECT {SLIM_SQL} FROM spans")
def _(a, spark, sf):
    store = _store(spark, "stream_ingest")
    ingest.run_to_end(ingest.stream_ingest(_stream(spark, sf, 2), store, scratch_path(spark, "offsets"), available_now=True))
    return store.read("spans").select(*SLIM)


@query("stream_dedup", "SELECT trace_id, span_id, min(ingested_ns) AS ingested_at_unix_nano FROM raw GROUP BY ALL")
def _(a, spark, sf):
    store = _store(spark, "stream_dedup")
    ingest.run_to_end(ingest.stream_dedup(_stream(spark, sf, 1), store, scratch_path(spark, "offsets"), available_now=True))
    return store.versions("spans").select("trace_id", "span_id", "ingested_at_unix_nano")


@query(
    "stream_service_stats",
    """SELECT window_start, service_name, count(*) AS call_count, count(*) FILTER (status_code = 2) AS error_count,
 round(quantile_cont(ms, 0.5), 6) AS latency_p50_ms, round(quantile_cont(ms, 0.95), 6) AS latency_p95_ms, round(quantile_cont(ms, 0.99), 6) AS latency_p99_ms
FROM (SELECT start_ns // 60000000000 * 60 AS window_start, service_name, status_code, (end_ns - start_ns) / 1e6 AS ms FROM raw)
WHERE window_start + 60 + 30 <= (SELECT max(start_ns) // 1000000 / 1e3 FROM raw) GROUP BY ALL""",
)
def _(a, spark, sf):
    store = _store(spark, "stream_service_stats")
    ingest.run_to_end(ingest.stream_service_stats(_stream(spark, sf), store, scratch_path(spark, "offsets"), available_now=True))
    return store.read("service_stats")


@query(
    "stream_late_side_output",
    """SELECT trace_id, span_id, max(ingested_ns) AS ingested_at_unix_nano FROM raw
WHERE ingested_ns > (start_ns // 60000000000 * 60 + 90) * 1000000000 GROUP BY ALL""",
)
def _(a, spark, sf):
    late = _store(spark, "late")
    run = ingest.stream_late_side_output(
        _stream(spark, sf, 2), _store(spark, "on_time"), late, scratch_path(spark, "offsets"), available_now=True
    )
    ingest.run_to_end(run)
    return late.read("spans").select("trace_id", "span_id", "ingested_at_unix_nano")


# What the processor sees, and all windows it closes, silent ones at the end included.
_STREAMED = {
    "raw": oracle.SEEN_RAW,
    "spine": f"SELECT unnest(range((SELECT min(window_start) FROM spans), (SELECT until FROM closed), {oracle.W})) AS window_start",
}
_CLOSED = "window_start + 60 <= (SELECT until FROM closed)"
_CLOSED_AS_OF = "as_of + 60 <= (SELECT until FROM closed)"


def _processor_table(table: str, final: str) -> None:
    @query(f"stream_processor_{table}", final, **_STREAMED)
    def _(a, spark, sf):
        return processed(spark, sf).read(table)


@query(
    "stream_window_processor",
    f"""SELECT window_start, caller AS caller_service, callee AS callee_service, call_count, error_count, {STATS_SQL}
FROM stats WHERE target_type = 'edge' AND {_CLOSED}""",
    **_STREAMED,
)
def _(a, spark, sf):
    return processed(spark, sf).read("service_edges")


_processor_table("trace_summaries", f"SELECT trace_id, window_start, depth, span_count, root_service, complete, incompleteness_reason, orphan_count FROM summaries WHERE {_CLOSED}")
_processor_table("span_classifications", f"SELECT trace_id, span_id, window_start, classification FROM classes WHERE {_CLOSED}")
_processor_table("service_stats", f"SELECT window_start, callee AS service_name, call_count, error_count, {STATS_SQL} FROM stats WHERE target_type = 'service' AND {_CLOSED}")
_processor_table("service_clock_offsets", f"SELECT window_start, service_name, offset_ns, confidence FROM offsets WHERE {_CLOSED}")
_processor_table("service_baselines", f"SELECT as_of, callee AS service_name, {BASELINE_SQL} FROM baselines WHERE target_type = 'service' AND {_CLOSED_AS_OF}")
_processor_table("edge_baselines", f"SELECT as_of, caller AS caller_service, callee AS callee_service, {BASELINE_SQL} FROM baselines WHERE target_type = 'edge' AND {_CLOSED_AS_OF}")
_processor_table("detections", f"SELECT {DETECTION_SQL} FROM detections WHERE {_CLOSED}")
_processor_table("topology", f"SELECT DISTINCT caller AS caller_service, callee AS callee_service FROM stats WHERE target_type = 'edge' AND {_CLOSED}")
_processor_table(
    "detected_incidents",
    f"""SELECT {INCIDENT_SQL}, derived, root_cause_incident_id FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY as_of DESC) AS rn
 FROM r_incidents WHERE {_CLOSED_AS_OF}) WHERE rn = 1""",
)


@query(
    "stream_counters",
    f"""SELECT 'late_spans' AS metric, '' AS label, count(*)::BIGINT AS value FROM received WHERE ingested_ns > (start_ns // 60000000000 * 60 + 90) * 1000000000
UNION ALL SELECT 'traces_processed', '', count(*)::BIGINT FROM summaries WHERE {_CLOSED}
UNION ALL SELECT 'incomplete_traces', incompleteness_reason, count(*)::BIGINT FROM summaries WHERE NOT complete AND {_CLOSED} GROUP BY 2
UNION ALL SELECT 'orphan_spans', classification, count(*)::BIGINT FROM classes WHERE classification <> 'ok' AND {_CLOSED} GROUP BY 2
UNION ALL SELECT 'clock_violations', callee, count(*)::BIGINT FROM pairs WHERE (c_start < p_start OR c_end > p_end) AND {_CLOSED} GROUP BY 2
UNION ALL SELECT 'cold_baselines', target_type, count(*)::BIGINT FROM baselines WHERE NOT ready AND {_CLOSED_AS_OF} GROUP BY 2
UNION ALL SELECT 'incidents_open', '', count(*)::BIGINT FROM r_incidents WHERE end_window = as_of AND {_CLOSED_AS_OF}
UNION ALL SELECT 'suppressed', '', count(*)::BIGINT FROM detections d WHERE {_CLOSED} AND EXISTS (SELECT 1 FROM r_incidents r
 WHERE r.as_of = d.window_start AND r.derived AND r.target_type = d.target_type AND r.target = d.target AND r.detector = d.detector)""",
    **_STREAMED,
)
def _(a, spark, sf):
    rows = processed(spark, sf).read("window_counters")
    label = F.when(F.col("metric") == "late_spans", "").otherwise(F.col("label"))
    return rows.groupBy("metric", label.alias("label")).agg(F.sum("value").alias("value"))


@query(
    "stream_open_incidents",
    # Event time has passed the end by more than a window and the watermark's 30 seconds.
    f"SELECT {INCIDENT_SQL}, end_window + 60 <= (SELECT max(window_start) FROM detections) - 30 AS closed FROM grouped",
)
def _(a, spark, sf):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, updates = scratch_path(spark, "detections"), scratch_path(spark, "updates")
    a.detections.select(*DETECTION).write.parquet(source)
    stream = spark.readStream.schema(a.detections.select(*DETECTION).schema).parquet(source)

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{updates}/batch={batch}")

    out = stream_open_incidents(stream)
    writer = out.writeStream.outputMode("update").foreachBatch(save)
    try:
        ingest.run_to_end(ingest.start(writer, scratch_path(spark, "offsets"), available_now=True))
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    rows = spark.read.parquet(updates).drop("batch")
    return latest_version(rows, ["incident_id"], ["window_count", "closed"]).select(*INCIDENT, "closed")
