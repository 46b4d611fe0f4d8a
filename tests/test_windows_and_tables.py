import pytest
from helpers import S, rows, span, spans
from pyspark.sql import functions as F

from spanlake.operators import windows
from spanlake.operators.dedup import latest_version
from spanlake.session import scratch_path
from spanlake.sources.tables import TableStore, retention, span_sink

MIDNIGHT = 1_704_153_600


def test_windows_are_epoch_aligned_also_before_the_epoch(spark):
    df = spans(spark, span("a", start=0), span("b", start=60 * S - 1), span("c", start=60 * S), span("d", start=-1))
    assert rows(df, "span_id", "window_start") == [("a", 0), ("b", 0), ("c", 60), ("d", -60)]


def test_spine_keeps_silent_windows_and_waits_for_the_watermark(spark):
    df = spans(spark, span("a", start=10 * S), span("b", start=190 * S))
    assert rows(windows.window_spine(df), "window_start") == [(0,), (60,), (120,), (180,)]
    assert rows(windows.window_spine(df, now=149.9), "window_start") == [(0,)]
    assert rows(windows.window_spine(df, now=150), "window_start") == [(0,), (60,)]
    assert windows.window_spine(df, now=89).count() == 0
    assert windows.late_check_boundary(149.9) == 60 and windows.late_check_boundary(150) == 120


def test_late_spans(spark):
    df = spans(
        spark, span("ontime", start=10 * S, ingested=12 * S), span("late", start=10 * S, ingested=200 * S),
        span("open", start=130 * S, ingested=200 * S),
    )
    assert rows(windows.late_spans(df, 120, 100), "span_id") == [("late",)]
    assert rows(windows.as_seen(df), "span_id") == [("ontime",), ("open",)]
    assert rows(windows.arrived_late(df), "span_id") == [("late",)]


def test_newest_copy_wins_whatever_the_order(spark):
    given = [span("a", ingested=i * S, end=i) for i in (3, 9, 1)] + [span("b", ingested=1)] * 40
    for order in (given, given[::-1]):
        out = latest_version(spark.createDataFrame(order, spans(spark, given[0]).drop("window_start").schema), ["trace_id", "span_id"], "ingested_at_unix_nano")
        assert rows(out, "span_id", "end_time_unix_nano") == [("a", 9), ("b", 10_000_000)]


def test_window_across_midnight_reads_both_partitions(spark):
    at = MIDNIGHT * S
    df = spans(spark, span("a", start=at - S), span("b", start=at), span("c", start=at + 40 * S))
    path = scratch_path(spark, "straddle")
    span_sink(df.drop("window_start"), path)
    stored = spark.read.parquet(path)
    assert stored.select("start_date").distinct().count() == 2
    window = windows.fetch_window(stored, MIDNIGHT - 30, MIDNIGHT + 30)
    assert rows(window, "span_id") == [("a",), ("b",)]
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "start_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(start_time_unix_nano)" in plan
    assert rows(retention(df, F.lit("2024-01-02").cast("date"), 0), "span_id") == [("b",), ("c",)]


def test_store_replaces_by_key_and_retries_are_harmless(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    assert store.read("detections").count() == 0
    schema = "window_start bigint, target_type string, target string, detector string, severity string, observed_value double, baseline_value double, deviation double"
    one = spark.createDataFrame([(0, "service", "a", "call_rate", "warning", 1.0, 1.0, -4.0), (0, "service", "a", "error_rate", "warning", 1.0, 1.0, 4.0)], schema)
    store.write("detections", one, 1)
    store.write("detections", one.filter("detector = 'call_rate'").withColumn("severity", F.lit("critical")), 2)
    store.write("detections", one.filter("detector = 'call_rate'").withColumn("severity", F.lit("critical")), 2)
    store.write("detections", one.limit(0), 3)
    assert rows(store.read("detections"), "detector", "severity") == [("call_rate", "critical"), ("error_rate", "warning")]
    assert store.versions("detections").count() == 3


def test_retain_drops_whole_days(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    df = spans(spark, span("a", start=(MIDNIGHT - 1) * S), span("b", start=MIDNIGHT * S)).drop("window_start")
    store.write("spans", df, 0)
    assert store.expired_days("spans", "2024-01-02").count() == 1
    store.retain("spans", "2024-01-02")
    assert rows(store.read("spans"), "span_id") == [("b",)]
    assert rows(store.read("spans", MIDNIGHT - 60, MIDNIGHT + 60), "span_id") == [("b",)]


def test_half_open_store_range(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    df = spans(spark, *[span(f"s{i}", start=i * 60 * S) for i in range(4)]).drop("window_start")
    store.write("spans", df, 0)
    assert rows(store.read("spans", 60, 180), "span_id") == [("s1",), ("s2",)]
    with pytest.raises(KeyError):
        store.write("no such table", df, 0)


def test_a_day_of_versions_is_compacted(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    df = spans(spark, *[span(f"s{i}", start=MIDNIGHT * S + i * S, ingested=MIDNIGHT * S) for i in range(4)]).drop("window_start")
    for batch in range(5):
        for writer in ("a", "b"):
            store.write("spans", df.withColumn("ingested_at_unix_nano", F.lit(MIDNIGHT * S + batch)), batch, writer)
    store.write("spans", spans(spark, span("other day", start=(MIDNIGHT - 9) * S)).drop("window_start"), 0, "a")
    before = rows(store.read("spans"), "span_id", "ingested_at_unix_nano")
    store.compact("spans", "2024-01-02")
    stored = store.versions("spans")
    assert rows(store.read("spans"), "span_id", "ingested_at_unix_nano") == before and stored.count() == 5
    assert stored.filter("day = '2024-01-02'").select(F.input_file_name()).distinct().count() <= 4
    store.compact("spans", "2024-01-02")
    store.compact("spans", "1999-01-01")
    assert rows(store.read("spans"), "span_id", "ingested_at_unix_nano") == before
    store.write("spans", df.limit(1).withColumn("ingested_at_unix_nano", F.lit(MIDNIGHT * S + 99)), 5, "a")
    assert store.read("spans").filter(f"ingested_at_unix_nano = {MIDNIGHT * S + 99}").count() == 1


def test_scratch_of_a_scope_is_deleted(spark):
    from spanlake.session import exists, scratch_scope, write_scratch

    with scratch_scope(spark):
        inside = write_scratch(spark.range(3), "inside").inputFiles()[0].rsplit("/", 1)[0]
        assert exists(spark, inside)
    assert not exists(spark, inside)


def test_newest_rows_are_held_once(spark):
    """Ties by the other columns, maps last; one state of the aggregate holds a row once."""
    from spanlake.operators.dedup import latest_version

    df = spark.createDataFrame(
        [(1, 5, "b", {"x": "1", "a": "2"}), (1, 5, "b", {"a": "3"}), (1, 5, "a", {"z": "9"}), (1, 4, "z", None), (2, 1, None, None)],
        "k int, v int, s string, m map<string,string>",
    )
    out = latest_version(df, ["k"], "v")
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted((r.k, r.v, r.s, r.m) for r in out.collect()) == [(1, 5, "b", {"a": "3"}), (2, 1, None, None)]
    assert "max_by" not in out._jdf.queryExecution().optimizedPlan().toString()
