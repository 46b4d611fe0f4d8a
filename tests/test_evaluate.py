import pytest
from helpers import BASELINE_DDL, STATS_DDL, S, rows

from spanlake.operators import evaluate as E

TRUE_DDL = "run_id string, incident_id string, type string, target_service string, target_edge string, start_time double, end_time double, magnitude double"
FOUND_DDL = "run_id string, incident_id string, target_type string, target string, detector string, start_window bigint, end_window bigint, derived boolean, root_cause_incident_id string"
GT_DDL = "run_id string, trace_id string, span_id string, parent_span_id string, service_name string, generated_at bigint"


def true(spark, *given):
    return E.true_incidents(spark.createDataFrame(list(given), TRUE_DDL))


def found(spark, *given):
    return spark.createDataFrame(list(given), FOUND_DDL)


def f(i, target="cart", start=0, end=0, detector="error_rate", kind="service", root=None, run="r"):
    return (run, i, kind, target, detector, start, end, root is not None, root or "")


def burst(i="t1", service="cart", start=30.0, end=90.0, run="r", kind="error_burst"):
    return (run, i, kind, service, "", start, end, 0.5)


def test_matching_and_latency(spark):
    t = true(spark, burst(), burst("t2", "stock", 500.0, 510.0), ("r", "t3", "edge_disappearance", "", "a->b", 70.0, 80.0, 1.0))
    a = found(
        spark, f("x", start=60, end=120), f("y", start=0, end=0), f("z", detector="call_rate", start=60, end=60),
        f("e", "a->b", 60, 120, "call_rate", "edge"),
    )
    matched = E.eval_detection_latency(E.eval_incident_match(t, a))
    assert rows(matched, "incident_id", "matches", "detected", "detection_latency_seconds") == [
        ("t1", 1, True, 90.0), ("t2", 0, False, None), ("t3", 1, True, 50.0),
    ]


def prf(spark, t, a, runs=("r",)):
    ranges = spark.createDataFrame([(r,) for r in runs], "run_id string")
    out = E.eval_incident_prf(ranges, E.eval_incident_match(t, a), t, a).collect()
    return {r.run_id: (r.true_incident_count, r.found_incident_count, r.precision, r.recall, r.f1) for r in out}


def test_precision_recall_and_undefined_values(spark):
    t = true(spark, burst(), burst("m", "stock", run="missed"))
    a = found(
        spark, f("x", start=60), f("again", start=60, end=120), f("other", "stock", 0, 60), f("echo", "front", 60, 60, root="x"),
        f("stray", "far", 6000, 6000), f("h", run="healthy", start=6000),
    )
    got = prf(spark, t, a, ("r", "missed", "healthy", "empty"))
    assert got["r"] == (1, 2, 0.5, 1.0, pytest.approx(2 / 3))
    assert got["missed"] == (1, 0, None, 0.0, None)
    assert got["healthy"] == (0, 1, 0.0, None, None)
    assert got["empty"] == (0, 0, None, None, None)


def test_short_incident_between_two_windows(spark):
    t = true(spark, burst(start=61.0, end=62.0))
    assert prf(spark, t, found(spark, f("x", start=60, end=60)))["r"][1] == 0
    assert prf(spark, t, found(spark, f("x", start=60, end=120)))["r"][1] == 1


def test_root_cause(spark):
    t = true(spark, burst())
    a = found(
        spark, f("root", start=60), f("good", "front", 60, 60, root="root"), f("bad", "edge", 60, 60, root="good"),
        f("lost", "edge", 60, 60, root="nowhere"), f("outside", "edge", 900, 900, root="root"),
    )
    assert rows(E.eval_root_cause(t, a), "root_cause_total", "root_cause_correct") == [(3, 1)]


def test_structure_scores(spark):
    gt = spark.createDataFrame(
        [("r", "t", s, p, "svc", 0) for s, p in [("a", ""), ("b", "a"), ("c", "b"), ("d", "lost"), ("lost", "a"), ("e", "a")]], GT_DDL
    )
    landed = spark.createDataFrame([("r", "t", s) for s in "abcde"], "run_id string, trace_id string, span_id string")
    classes = spark.createDataFrame(
        [("r", "t", "b", "ok"), ("r", "t", "c", "orphan_missing_parent"), ("r", "t", "d", "orphan_missing_parent")],
        "run_id string, trace_id string, span_id string, classification string",
    )
    got = E.eval_attachment(gt, landed, classes).first()
    assert (got.attachment_denominator, got.attachment_correct, got.orphan_denominator, got.orphan_correct) == (3, 1, 1, 1)
    true_edges = spark.createDataFrame([("r", "t", "a", "b", 0), ("r", "t", "a", "b", 0), ("r", "t", "a", "c", 0)], "run_id string, trace_id string, caller_service string, callee_service string, generated_at bigint")
    edges = spark.createDataFrame([(0, "a", "b"), (60, "x", "y"), (6000, "a", "c")], "window_start bigint, caller_service string, callee_service string")
    windows = spark.createDataFrame([("r", 0), ("r", 60), ("q", 6000)], "run_id string, window_start bigint")
    scores = {r.run_id: (r.edge_precision, r.edge_recall, r.edge_f1) for r in E.eval_edges_prf(true_edges, edges, windows).collect()}
    assert scores == {"r": (0.5, 0.5, 0.5), "q": (0.0, 0.0, 0.0)}


def test_run_windows_include_the_margin_exactly(spark):
    gt = spark.createDataFrame([("r", "t", "a", "", "svc", 90 * S), ("r", "t", "b", "a", "svc", 150 * S)], GT_DDL)
    assert rows(E.run_windows(E.eval_run_range(gt)), "window_start") == [(60,), (120,), (180,)]


def test_observed_magnitude_and_its_undefined_cases(spark):
    t = true(
        spark, ("r", "spike", "latency_spike", "cart", "", 100.0, 140.0, 4.0), ("r", "nobase", "latency_tail", "new", "", 100.0, 140.0, 4.0),
        ("r", "burst", "error_burst", "cart", "", 100.0, 140.0, 0.5), ("r", "quiet", "error_burst", "new", "", 700.0, 710.0, 0.5),
        ("r", "gone", "edge_disappearance", "", "a->b", 100.0, 140.0, 1.0),
    )
    stats = spark.createDataFrame(
        [(120, "service", "", "cart", "cart", 50, 20, 1.0, 2.0, 40.0), (60, "edge", "a", "b", "a->b", 30, 0, 1.0, 1.0, 1.0), (120, "service", "", "new", "new", 5, 0, 1.0, 1.0, 9.0)],
        STATS_DDL,
    )
    base = spark.createDataFrame(
        [(60, "service", "", "cart", "cart", 99, 10.0, 1.0, 0.0, 5.0, 1.0, 9, True), (120, "service", "", "cart", "cart", 99, 99.0, 1.0, 0.0, 5.0, 1.0, 9, True),
         (60, "service", "", "new", "new", 9, 9.0, 1.0, 0.0, 5.0, 1.0, 9, False), (0, "edge", "a", "b", "a->b", 99, 9.0, 1.0, 0.0, 30.0, 1.0, 9, True)],
        BASELINE_DDL,
    )
    got = dict(rows(E.eval_observed_magnitude(t, stats, base), "incident_id", "observed_magnitude"))
    assert got == {"spike": 4.0, "nobase": None, "burst": 0.4, "quiet": None, "gone": 1.0}
