import pytest
from helpers import MS, S, rows, span, spans
from pyspark.sql import functions as F

from spanlake.operators import incidents, windows
from spanlake.plans.pipeline import Analysis
from spanlake.session import scratch_path
from spanlake.sources import otlp
from spanlake.sources.tables import TableStore
from spanlake.streaming import ingest
from spanlake.streaming.incidents import stream_open_incidents
from spanlake.streaming.processor import WindowProcessor

SETTINGS = {"lookback_seconds": 300, "min_samples": 10, "grouping_seconds": 120}
COLUMNS = ["trace_id", "span_id", "parent_span_id", "service_name", "start_time_unix_nano", "ingested_at_unix_nano"]


def traffic():
    """12 windows of 20 traces; in window 8 the backend is slow and in window 10 it is silent."""
    out = []
    for w in range(12):
        for i in range(20):
            at, trace = (6000 + w * 60 + 2 * i) * S, f"{w}-{i}"
            slow = 20 if w == 8 else 1
            out.append(span("a", "", "frontend", at, at + (100 + i) * MS * slow, trace))
            if w != 10:
                out.append(span("b", "a", "backend", at + 5 * MS, at + (50 + i) * MS * slow, trace, status=2 if i == 0 else 1))
    return out


def write_pieces(spark, given, cuts):
    """One file per piece, in order."""
    path = scratch_path(spark, "arrivals")
    given = sorted(given, key=lambda s: s[9])
    for lo, hi in zip(cuts, cuts[1:]):
        spans(spark, *given[lo:hi]).drop("window_start").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def arrivals(spark):
    given = traffic()
    return given, write_pieces(spark, given, [0, 100, 101, 260, 400, len(given)])


def test_window_processor_equals_the_batch_plan_also_after_a_restart(spark, arrivals):
    given, path = arrivals
    store, checkpoint = TableStore(spark, scratch_path(spark, "store")), scratch_path(spark, "cp")
    processor = WindowProcessor(store, **SETTINGS)
    ingest.run_to_end(processor.stream(stream(spark, path), checkpoint, available_now=True))
    closed = (max(s[9] for s in given) - 30 * S) // (60 * S) * 60
    before = store.read("service_stats").count()
    # a second start finds nothing new; redelivered spans in a new file change nothing
    spans(spark, *given[:50]).drop("window_start").coalesce(1).write.mode("append").parquet(path)
    ingest.run_to_end(WindowProcessor(store, **SETTINGS).stream(stream(spark, path), checkpoint, available_now=True))
    assert store.read("spans").count() == len(given) and store.read("service_stats").count() == before

    batch = Analysis(spans(spark, *given).drop("window_start"), **SETTINGS)
    done = f"window_start < {closed}"
    same = {
        "service_stats": batch.service_stats.filter(done),
        "service_edges": batch.service_edges.filter(done),
        "trace_summaries": batch.summaries.filter(done),
        "span_classifications": batch.classifications.filter(done),
        "service_clock_offsets": batch.offsets.filter(done),
        "detections": batch.detections.filter(done),
    }
    for table, want in same.items():
        columns = [c for c in store.read(table).columns]
        assert rows(store.read(table), *columns) == rows(want, *columns), table
    assert store.read("detections").count() > 0
    spine = batch.spine.filter(done)
    rolled = incidents.rolling_regroup(batch.detections.filter(done), batch.service_edges, spine, 60, 120)
    keep = ["incident_id", "start_window", "end_window", "window_count", "derived", "root_cause_incident_id"]
    assert rows(store.read("detected_incidents"), *keep) == rows(rolled, *keep)


def test_ingest_keeps_every_span_once(spark, arrivals):
    given, path = arrivals
    twice = write_pieces(spark, given + given[:30], [0, 200, len(given) + 30])
    store, checkpoint = TableStore(spark, scratch_path(spark, "store")), scratch_path(spark, "cp")
    ingest.run_to_end(ingest.stream_ingest(stream(spark, twice), store, checkpoint, available_now=True))
    assert store.read("spans").count() == len(given)
    assert store.versions("spans").count() == len(given) + 30
    first = TableStore(spark, scratch_path(spark, "store"))
    ingest.run_to_end(ingest.stream_dedup(stream(spark, twice), first, scratch_path(spark, "cp"), available_now=True))
    assert first.versions("spans").count() == len(given)


def test_dedup_keeps_spans_of_any_age(spark):
    """Old spans that come after newer ones, and copies of them, in later micro-batches."""
    given = [span(f"s{i}", start=at * S, ingested=(5000 + i) * S) for i, at in enumerate((4000, 10, 3000, 20, 4999))]
    copies = [span("s1", start=10 * S, ingested=9000 * S), span("s4", start=4999 * S, ingested=9001 * S)]
    path = write_pieces(spark, given + copies, [0, 1, 3, 5, 7])
    store = TableStore(spark, scratch_path(spark, "store"))
    ingest.run_to_end(ingest.stream_dedup(stream(spark, path), store, scratch_path(spark, "cp"), available_now=True))
    assert rows(store.versions("spans"), "span_id", "ingested_at_unix_nano") == [(s[1], s[9]) for s in given]


def test_writers_do_not_replace_each_other(spark):
    """Two streams on one store, and one with a new checkpoint, all beginning with batch 0."""
    store = TableStore(spark, scratch_path(spark, "store"))
    for i in range(3):
        path = write_pieces(spark, [span(f"s{i}", start=i * S), span("same", start=S, ingested=(50 + i) * S)], [0, 2])
        ingest.run_to_end(ingest.stream_ingest(stream(spark, path), store, scratch_path(spark, f"cp{i}"), available_now=True))
    assert rows(store.read("spans"), "span_id") == [("s0",), ("s1",), ("s2",), ("same",)]
    assert store.read("spans").filter("span_id = 'same'").first().ingested_at_unix_nano == 52 * S
    checkpoint = scratch_path(spark, "cp")
    assert ingest.writer_of(spark, checkpoint) == ingest.writer_of(spark, checkpoint) < ingest.writer_of(spark, scratch_path(spark, "cp"))


def test_a_fast_clock_closes_nothing(spark, arrivals):
    """A span stamped a day ahead, and one stamped 1970, leave the windows of the others alone."""
    given = traffic()[:200]
    odd = [span("ahead", start=(6000 + 86_400) * S, ingested=given[10][9] + 1), span("ancient", start=0, ingested=given[11][9] + 1)]
    results = []
    for more in ([], odd):
        path = write_pieces(spark, given + more, [0, 60, 130, len(given + more)])
        store = TableStore(spark, scratch_path(spark, "store"))
        ingest.run_to_end(WindowProcessor(store, **SETTINGS).stream(stream(spark, path), scratch_path(spark, "cp"), available_now=True))
        results.append(rows(store.read("service_edges"), "window_start", "caller_service", "callee_service", "call_count"))
    assert results[0] == results[1] and len(results[0]) > 2
    assert rows(store.read("window_counters").filter("metric = 'late_spans'"), "window_start", "value") == [(0, 1)]


def test_silence_is_noticed_by_the_clock(spark):
    """No span at all any more: windows close by the clock and the call-rate detector fires."""
    given = [s for s in traffic() if s[5] < (6000 + 8 * 60) * S]
    store = TableStore(spark, scratch_path(spark, "store"))
    processor = WindowProcessor(store, **SETTINGS)
    processor.advance(9_999)  # nothing known yet
    path = write_pieces(spark, given, [0, len(given)])
    ingest.run_to_end(processor.stream(stream(spark, path), scratch_path(spark, "cp"), available_now=True))
    assert store.read("detections").filter("detector = 'call_rate'").count() == 0
    end = 6000 + 8 * 60
    processor.advance(end + 29)  # the last window is not due yet
    before = store.read("service_stats").agg(F.max("window_start")).first()[0]
    processor.advance(end + 3 * 60 + 30)
    assert store.read("service_stats").agg(F.max("window_start")).first()[0] >= before
    silent = rows(store.read("detections").filter("detector = 'call_rate'"), "window_start", "target")
    assert {w for w, _ in silent} == {end, end + 60, end + 120} and {"frontend", "backend"} <= {t for _, t in silent}
    counted = store.read("window_counters")
    assert counted.filter(f"metric = 'incidents_open' AND window_start = {end + 120} AND value > 0").count() == 1
    n = store.read("detections").count()
    processor.advance(end + 3 * 60 + 30)
    assert store.read("detections").count() == n


def test_streamed_statistics_equal_batch(spark, arrivals):
    given, _ = arrivals
    path = write_pieces(spark, given, [0, 100, 300, len(given)])
    store = TableStore(spark, scratch_path(spark, "store"))
    ingest.run_to_end(ingest.stream_service_stats(stream(spark, path), store, scratch_path(spark, "cp"), available_now=True))
    batch = Analysis(spans(spark, *given).drop("window_start"), **SETTINGS).service_stats
    got = rows(store.read("service_stats"), *batch.columns)
    assert got == [r for r in rows(batch, *batch.columns) if r[0] + 90 <= max(s[5] for s in given) // S]


def test_late_spans_go_to_the_side(spark):
    given = [span("ok", start=10 * S, ingested=12 * S), span("late", start=10 * S, ingested=95 * S), span("edge", start=10 * S, ingested=90 * S)]
    path = write_pieces(spark, given, [0, 2, 3])
    on_time, late = (TableStore(spark, scratch_path(spark, n)) for n in ("ontime", "late"))
    ingest.run_to_end(ingest.stream_late_side_output(stream(spark, path), on_time, late, scratch_path(spark, "cp"), available_now=True))
    assert rows(late.read("spans"), "span_id") == [("late",)]
    assert rows(on_time.read("spans"), "span_id") == [("edge",), ("ok",)]
    assert windows.arrived_late(spans(spark, *given)).count() == 1


def test_open_incidents_extend_and_close(spark):
    ddl = "window_start bigint, target_type string, target string, detector string, severity string, deviation double"
    path, updates = scratch_path(spark, "detections"), scratch_path(spark, "updates")
    batches = [
        [(600, "service", "a", "x", "warning", 4.0), (600, "service", "b", "x", "warning", 4.0)],
        [(660, "service", "a", "x", "critical", -9.0)],
        [(900, "service", "a", "x", "warning", 5.0)],
    ]
    for given in batches:
        spark.createDataFrame(given, ddl).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)
    out = stream_open_incidents(source).writeStream.outputMode("update").foreachBatch(
        lambda df, batch: df.write.mode("overwrite").parquet(f"{updates}/batch={batch}")
    )
    ingest.run_to_end(ingest.start(out, scratch_path(spark, "cp"), available_now=True))
    got = spark.read.parquet(updates).groupBy("incident_id").agg(
        F.max("end_window").alias("end"), F.max("window_count").alias("n"), F.max("peak_severity").alias("low"),
        F.max_by("peak_deviation", "window_count").alias("peak"), F.max("closed").alias("closed"),
    )
    assert rows(got, "incident_id", "end", "n", "peak", "closed") == [
        ("service:a:x:600", 660, 2, -9.0, True), ("service:a:x:900", 900, 1, 5.0, False), ("service:b:x:600", 600, 1, 4.0, True),
    ]


def test_late_detections_join_or_stand_alone(spark):
    ddl = "window_start bigint, target_type string, target string, detector string, severity string, deviation double"
    path, updates = scratch_path(spark, "detections"), scratch_path(spark, "updates")
    for given in ([(900, "service", "a", "x", "warning", 4.0)], [(840, "service", "a", "x", "critical", 5.0)], [(660, "service", "a", "x", "warning", 6.0)]):
        spark.createDataFrame(given, ddl).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)
    out = stream_open_incidents(source, delay_seconds=600).writeStream.outputMode("update").foreachBatch(
        lambda df, batch: df.write.mode("overwrite").parquet(f"{updates}/batch={batch}")
    )
    ingest.run_to_end(ingest.start(out, scratch_path(spark, "cp"), available_now=True))
    last = spark.read.parquet(updates).groupBy("incident_id").agg(F.max_by(F.struct("start_window", "end_window", "window_count", "closed"), "window_count").alias("r"))
    assert rows(last, "incident_id", "r.*") == [("service:a:x:660", 660, 660, 1, True), ("service:a:x:900", 840, 900, 2, False)]


def test_a_day_of_micro_batches_leaves_few_files(spark):
    """Every batch is a file at first; merged by level, their number stays bounded and no span is lost."""
    path, n = scratch_path(spark, "arrivals"), 11
    given = [span(f"s{k % 6}", start=k * S, ingested=k * S, trace=f"t{k % 6}") for k in range(n)]
    given += [span("old", start=-40 * 86_400 * S, ingested=0)]
    for row in given:
        spans(spark, row).drop("window_start").coalesce(1).write.mode("append").parquet(path)
    store = TableStore(spark, scratch_path(spark, "store"))
    run = ingest.stream_ingest(stream(spark, path), store, scratch_path(spark, "cp"), merge_every=3, available_now=True)
    ingest.run_to_end(run)
    assert rows(store.read("spans").filter("span_id <> 'old'"), "span_id", "ingested_at_unix_nano") == sorted(
        (f"s{k % 6}", k * S) for k in range(n - 6, n)
    )
    assert store.versions("spans").filter("start_time_unix_nano >= 0").select("version").distinct().count() <= 5


def test_merging_goes_on_after_a_failure(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    df = spans(spark, *[span(f"s{k}", start=k * S) for k in range(4)]).drop("window_start")
    for version in range(4):
        store.write("spans", df.withColumn("ingested_at_unix_nano", F.lit(version).cast("bigint")), version, "w")
    store.write("spans", df, 7, "other")
    before = rows(store.read("spans"), *COLUMNS)
    # as if it had ended before the merged versions were deleted
    store.write("spans", store.versions("spans").filter("writer = 'w' AND version = 3").drop("day", "writer", "version"), 3, "w")
    ingest.maintain(store, "spans", "w", 4, every=4, days=None)
    ingest.maintain(store, "spans", "w", 4, every=4, days=None)
    assert rows(store.read("spans"), *COLUMNS) == before
    assert rows(store.versions("spans").select("writer", "version").distinct(), "writer", "version") == [("other", 7), ("w", 3)]


def test_size_or_time_at_the_topic():
    options = otlp.topic_options("broker:9092", "spans", startingOffsets="earliest", maxOffsetsPerTrigger=9000)
    assert options["minOffsetsPerTrigger"] == "5000" and options["maxTriggerDelay"] == "2000ms"
    assert options["maxOffsetsPerTrigger"] == "9000" and options["startingOffsets"] == "earliest" and options["subscribe"] == "spans"


def test_dedup_reads_the_batches_own_ranges_of_time(spark):
    hours = [span("x", start=h * 3600 * S) for h in range(50)]
    assert len(ingest.start_ranges(spans(spark, *hours))) == ingest.RANGES
    df = spans(spark, span("a", start=5 * S), span("b", start=9 * S), span("c", start=86_400 * S + 1))
    assert ingest.start_ranges(df) == [(5 * S, 9 * S), (86_400 * S + 1, 86_400 * S + 1)]
    assert ingest.start_ranges(df.limit(0)) == []


def test_late_spans_of_batches_at_one_clock_add_up(spark):
    """Late spans that arrived out of order do not move the clock; a repeated batch counts once."""
    store = TableStore(spark, scratch_path(spark, "store"))
    processor = WindowProcessor(store, **SETTINGS)
    one = lambda name, arrived: spans(spark, span(name, start=10 * S, ingested=arrived * S)).drop("window_start")
    processor.process_batch(spans(spark, span("r", start=895 * S, ingested=900 * S)).drop("window_start"), 0, "w")
    processor.process_batch(one("a", 300), 1, "w")
    processor.process_batch(one("b", 310).union(one("c", 320)), 2, "w")
    processor.process_batch(one("b", 310).union(one("c", 320)), 2, "w")
    late = store.read("window_counters").filter("metric = 'late_spans'")
    assert late.agg(F.sum("value")).first()[0] == 3
    names = store._names(f"{processor.progress_path}/writer=w", "batch=")
    assert names == ["1", "2"]


def test_arrivals_of_any_size_are_taken_in_order(spark):
    """A piece is many files, written side by side; micro-batches of any number of them follow one another."""
    from __spark_entry__ import SMOKE_DIR
    from spanlake.sources import tabular

    path = scratch_path(spark, "arrivals")
    each = tabular.arrivals(spark, SMOKE_DIR, path, 3, file_rows=500)
    files = [f for f in spark.read.parquet(path).inputFiles() if "part-" in f]
    assert each > 3 and len(files) == 3 * each
    seen = []

    def save(df, batch):
        seen.append(df.selectExpr("count(*)", "min(ingested_at_unix_nano)", "max(ingested_at_unix_nano)").first())

    source = tabular.span_stream(spark, path, maxFilesPerTrigger=4)
    ingest.run_to_end(ingest.start(source.writeStream.foreachBatch(save), scratch_path(spark, "cp"), available_now=True))
    assert len(seen) == -(-3 * each // 4) and sum(n for n, _, _ in seen) == tabular.raw_spans(spark, SMOKE_DIR).count()
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))
