"""Span tables by trace: what moves, what is read, and what happens to a trace that is too large."""

import pytest
from helpers import MS, span, spans

from spanlake.operators import baseline, reassembly, windows
from spanlake.plans import catalog, queries
from spanlake.plans.pipeline import Analysis
from spanlake.sources.layout import Layout, span_days
from spanlake.sources.tables import TableStore

DAY = 86_400
NS = 1_000_000_000
SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return plan(df).count("Exchange hashpartitioning")


def traces(spark, days, per_day=400):
    rows = []
    for d in range(days):
        for t in range(per_day):
            at = d * DAY * NS + t * 100 * MS
            trace = f"{d * per_day + t:032x}"
            rows += [span("r", "", "frontend", at, at + 9 * MS, trace), span("c", "r", "cart", at + MS, at + 5 * MS, trace)]
    return spans(spark, *rows).drop("window_start")


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_spans_move_once_up_to_the_summaries(spark, no_broadcast):
    a = Analysis(traces(spark, 2))
    dealt = Layout(4)
    a.__dict__["layout"] = dealt
    newest = catalog.latest_version(dealt.dealt(a.raw), ["trace_id", "span_id"], "ingested_at_unix_nano")
    assert shuffles(newest) == 1 and "REPARTITION_BY_NUM" in plan(newest)
    assert shuffles(reassembly.parent_links(a.spans)) == 0
    assert shuffles(reassembly.resolved_pairs(a.spans)) == 0
    seeds = reassembly.span_seeds(a.spans, a.links, lambda df: dealt.write(df, "doubled"))
    assert shuffles(seeds) == 0
    assert shuffles(reassembly.summarize(a.seeds)) == 0
    assert a.summaries.count() == 800 and a.summaries.filter("complete AND depth = 2").count() == 800


def scans(df) -> list:
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    leaves = [leaves.apply(k) for k in range(leaves.size())]
    return [leaf for leaf in leaves if "FileScan" in leaf.toString()]


def scanned(df) -> int:
    """Rows that the file scans of a query returned: those of the row groups that were read."""
    df.collect()
    return sum(scan.metrics().apply("numOutputRows").value() for scan in scans(df))


@pytest.fixture()
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_registered_scans_prune_days(spark):
    for name, columns in (("fetch_window", ["start_date"]), ("lookback_spans", ["start_date"]), ("late_spans", ["start_date", "arrival_date"])):
        (scan,) = scans(catalog.REGISTRY[name][0](spark, SF_DIR))
        assert all(c in scan.partitionFilters().toString() for c in columns), name


def test_a_trace_is_found_in_one_row_group_however_many_days(spark, static_plans):
    read = {}
    for days in (1, 6):
        raw = traces(spark, days)
        store = TableStore(spark, catalog.scratch_path(spark, "spans-by-day"))
        store.write("spans", raw.coalesce(1), 1)  # a file a day
        layout = Layout(2)
        table = layout.write(layout.dealt(raw).withColumns(span_days()), "spans", ["start_date", "arrival_date"])
        trace = f"{123:032x}"
        own = [scanned(s.filter(f"trace_id = '{trace}'").select("span_id")) for s in (table, store.versions("spans"))]
        detail = queries.q_trace_detail(table, spark.createDataFrame([], "trace_id string, span_id string, classification string"), trace)
        assert detail.count() == 2
        read[days] = own
    assert read[1] == read[6] and read[6][0] < 800 and read[6][1] <= 800


def test_one_giant_trace_is_not_kept_in_one_bucket(spark):
    rows = [span(f"s{k}", "s0" if k else "", "cart", k * MS, k * MS + MS, "f" * 32) for k in range(600)]
    rows += [span("r", "", "cart", 0, MS, f"{k:032x}") for k in range(300)]
    raw = spans(spark, *rows).drop("window_start")
    assert Layout.of(raw).buckets == 1  # small as it is
    even, uneven = Layout.of(raw.filter("trace_id < 'f'"), hot_rows=100), Layout.of(raw, hot_rows=100)
    assert even.buckets == 1 and uneven.buckets == 0
    a, b = Analysis(raw), Analysis(raw)
    b.__dict__["layout"] = uneven
    for table in ("summaries", "classifications"):
        assert sorted(map(tuple, getattr(a, table).select(*getattr(b, table).columns).collect())) == sorted(map(tuple, getattr(b, table).collect()))
    assert "Bucketed: true" not in plan(b.spans)


def test_lookback_is_a_range_over_midnight(spark):
    raw = traces(spark, 2, 5)
    table = raw.withColumns(span_days())
    assert windows.fetch_window(table, 0, 2 * DAY).count() == 20
    assert baseline.lookback_spans(table, DAY + 1, 2).count() == 10
    assert windows.late_spans(table, 2 * DAY, -10 * DAY).count() == 20


def test_a_bucket_stays_small_enough_to_be_sorted_in_memory(spark):
    many = spark.range(6_000_000).selectExpr("CAST(id AS string) AS trace_id")
    assert 6_000_000 / Layout.of(many).buckets <= 600_000
