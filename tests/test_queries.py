import pytest
from helpers import MS, S, rows, span, spans

from spanlake.operators import reassembly, shape
from spanlake.plans import queries

SUMMARY = "trace_id string, window_start bigint, depth int, span_count bigint, root_service string, complete boolean, incompleteness_reason string, orphan_count bigint"


@pytest.fixture(scope="module")
def traces(spark):
    given = [span("r", trace=f"t{i}", service="front" if i % 2 else "back", start=i * 60 * S, end=i * 60 * S + i * 10 * MS) for i in range(10)]
    df = spans(spark, *given)
    return reassembly.reassemble(df)[0], df


@pytest.mark.parametrize("bad", [(10, 10), (10, 5), (0, 86_401)])
def test_ranges_are_checked(traces, bad):
    with pytest.raises(ValueError):
        queries.q_traces(*traces, *bad)
    with pytest.raises(ValueError):
        queries.q_topology(traces[0], *bad)


def test_a_full_day_is_allowed():
    queries.check_range(0, 86_400)


@pytest.mark.parametrize("bad", ["", "xyz", "g" * 32, "a" * 31])
def test_trace_ids_are_checked(bad):
    with pytest.raises(ValueError):
        queries.check_trace_id(bad)
    assert queries.check_trace_id("A" * 32) == "a" * 32


def page(df):
    return [r.trace_id for r in df.orderBy("position").collect()], df.first()


def test_paging_newest_first(traces):
    ids, row = page(queries.q_traces(*traces, 0, 600, limit=3))
    assert ids == ["t9", "t8", "t7"] and row.has_more and not row.duration_filter_truncated
    with pytest.raises(ValueError):
        queries.q_traces(*traces, 0, 600, limit=0)
    ids, row = page(queries.q_traces(*traces, 0, 600, limit=3, offset=8))
    assert ids == ["t1", "t0"] and not row.has_more
    ids, _ = page(queries.q_traces(*traces, 60, 120))
    assert ids == ["t2", "t1"]  # both ends belong to the range


def test_the_duration_filter_comes_before_the_page(traces):
    assert page(queries.q_traces(*traces, 0, 600, service="front"))[0] == ["t9", "t7", "t5", "t3", "t1"]
    assert queries.q_traces(*traces, 0, 600, complete=False).count() == 0
    ids, row = page(queries.q_traces(*traces, 0, 600, min_duration_ms=20.0))
    assert ids == [f"t{i}" for i in range(9, 1, -1)] and not row.has_more
    ids, row = page(queries.q_traces(*traces, 0, 600, min_duration_ms=20.0, limit=3, offset=2))
    assert ids == ["t7", "t6", "t5"] and row.has_more


def test_more_rows_than_any_page(spark):
    """Old matches behind thousands of short new ones, and answers of over 500 rows, are all found."""
    n = 1200
    summaries = spark.range(n).selectExpr("concat('t', lpad(id, 5, '0')) AS trace_id", "id AS window_start", "1 AS depth", "1L AS span_count", "'s' AS root_service", "true AS complete", "'' AS incompleteness_reason", "0L AS orphan_count")
    df = spark.range(n).selectExpr("concat('t', lpad(id, 5, '0')) AS trace_id", "0L AS start_time_unix_nano", "if(id < 600, 9000000L, 1000L) AS end_time_unix_nano")
    got = queries.q_traces(summaries, df, 0, n, min_duration_ms=5.0, limit=550)
    ids, row = page(got)
    assert len(ids) == 550 and ids[0] == "t00599" and row.has_more
    assert queries.q_traces(summaries, df, 0, n, limit=5000).count() == n
    edges = spark.range(n).selectExpr("0L AS window_start", "concat('a', id) AS caller_service", "'b' AS callee_service", "1L AS call_count", "0L AS error_count", "1.0D AS latency_p50_ms", "1.0D AS latency_p95_ms", "1.0D AS latency_p99_ms")
    assert queries.q_topology(edges, 0, 60).count() == n
    part = queries.q_topology(edges, 0, 60, limit=100, offset=n - 50).collect()
    assert len(part) == 50 and not part[0].has_more
    incidents = spark.range(n).selectExpr("concat('i', lpad(id, 5, '0')) AS incident_id", "'service' AS target_type", "concat('s', id) AS target", "'x' AS detector", "id AS start_window", "id AS end_window", "1L AS window_count", "'critical' AS peak_severity", "1.0D AS peak_deviation", "true AS derived", "'i00000' AS root_cause_incident_id")
    assert queries.q_detections(incidents, 0, n).filter("root_cause_target = 's0'").count() == n
    first = queries.q_detections(incidents, 0, n, limit=2).collect()
    assert [r.root_cause_target for r in first] == ["s0", "s0"] and first[0].has_more


def test_trace_without_spans_has_no_duration(spark, traces):
    summaries = traces[0].unionByName(spark.createDataFrame([("ghost", 0, 1, 1, "front", True, "", 0)], SUMMARY))
    got = {r.trace_id: r.duration_ms for r in queries.q_traces(summaries, traces[1], 0, 600).collect()}
    assert got["ghost"] is None and got["t3"] == 30.0
    assert "ghost" not in {r.trace_id for r in queries.q_traces(summaries, traces[1], 0, 600, min_duration_ms=1.0).collect()}


def test_trace_detail_and_offsets(spark):
    tid = "ab" * 16
    df = spans(spark, span("a", trace=tid, service="front", start=100 * S), span("b", "a", "cart", 101 * S, trace=tid))
    classes = spark.createDataFrame([(tid, "a", 60, "ok")], "trace_id string, span_id string, window_start bigint, classification string")
    got = queries.q_trace_detail(df, classes, tid.upper()).collect()
    assert [(r.span_id, r.classification) for r in got] == [("a", "ok"), ("b", None)]
    offsets = spark.createDataFrame(
        [(0, "cart", 5_000_000, 40), (60, "cart", 7_000_000, 40), (120, "cart", 9_000_000, 50), (120, "front", 1, 1)],
        "window_start bigint, service_name string, offset_ns bigint, confidence bigint",
    )
    assert rows(queries.q_offsets_as_of(df, offsets, tid), "service_name", "offset_ns") == [("cart", 7_000_000)]
    assert rows(queries.q_clock_offsets(offsets, 0, 120), "service_name", "offset_ns", "window_start") == [("cart", 9_000_000, 120), ("front", 1, 120)]
    spine = spark.createDataFrame([(0,), (60,), (120,)], "window_start bigint")
    assert rows(shape.skewed_spans(df, offsets, spine), "span_id", "offset_ns") == [("b", 7_000_000)]


def test_topology_and_detections(spark):
    edges = spark.createDataFrame(
        [(0, "a", "b", 10, 1, 1.0, 2.0, 3.0), (60, "a", "b", 5, 0, 4.0, 5.0, 6.0), (60, "c", "d", 1, 0, 1.0, 1.0, 1.0)],
        "window_start bigint, caller_service string, callee_service string, call_count bigint, error_count bigint, latency_p50_ms double, latency_p95_ms double, latency_p99_ms double",
    )
    got = queries.q_topology(edges, 0, 60, service="b").collect()
    assert [(r.call_count, r.error_count, r.latency_p99_ms, r.latest_window_start) for r in got] == [(15, 1, 6.0, 60)]
    assert got[0].error_rate == pytest.approx(1 / 15)
    incidents = spark.createDataFrame(
        [("i1", "service", "a", "x", 0, 60, 2, "warning", 1.0, True, "i2"), ("i2", "service", "b", "x", 0, 0, 1, "critical", 1.0, False, ""),
         ("i3", "service", "a", "x", 300, 300, 1, "critical", 1.0, True, "elsewhere")],
        "incident_id string, target_type string, target string, detector string, start_window bigint, end_window bigint, window_count bigint, peak_severity string, peak_deviation double, derived boolean, root_cause_incident_id string",
    )
    page = {r.incident_id: r for r in queries.q_detections(incidents, 0, 300).collect()}
    assert page["i1"].root_cause_target == "b" and page["i2"].root_cause_incident_id is None and page["i3"].root_cause_target is None
    assert {r.incident_id for r in queries.q_detections(incidents, 30, 299).collect()} == {"i1"}
    assert queries.q_detections(incidents, 0, 300, target="a").first().incident_id == "i3"
    worst = rows(shape.worst_incident_per_service(incidents), "target", "severity", "incident_id")
    assert worst == [("a", "critical", "i3"), ("b", "critical", "i2")]


def test_depths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "b"), ("x", "y"), ("y", "x"), ("r", "r")], "caller_service string, callee_service string")
    assert rows(shape.service_depths(edges), "service", "depth") == [("a", 0), ("b", 1), ("c", 1)]
