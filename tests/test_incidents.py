import random

from helpers import DETECTION_DDL, INCIDENT_DDL, detection, incident, rows

from spanlake.operators import incidents as I


def detections(spark, *given):
    return spark.createDataFrame(list(given), DETECTION_DDL)


def suppress(spark, given, edges):
    df = spark.createDataFrame(list(given), INCIDENT_DDL)
    graph = spark.createDataFrame(list(edges), "caller_service string, callee_service string")
    out = I.suppress_propagated(df, graph).collect()
    assert len(out) == len(given)
    return {r.incident_id: r.root_cause_incident_id for r in out if r.derived}


def test_grouping_splits_at_gaps_and_keys(spark):
    got = I.group_detections(
        detections(
            spark, detection(120), detection(0), detection(60, severity="critical", deviation=-9.0),
            detection(240), detection(60, detector="error_rate"), detection(0, service="cart", caller="front"),
        )
    )
    assert rows(got, "incident_id", "end_window", "window_count", "peak_severity", "peak_deviation") == [
        ("edge:front->cart:percentile_deviation:0", 0, 1, "warning", 4.0),
        ("service:checkout:error_rate:60", 60, 1, "warning", 4.0),
        ("service:checkout:percentile_deviation:0", 120, 3, "critical", -9.0),
        ("service:checkout:percentile_deviation:240", 240, 1, "warning", 4.0),
    ]


def test_peak_keeps_the_first_of_equals(spark):
    got = I.group_detections(detections(spark, detection(0, deviation=-5.0), detection(60, deviation=5.0)))
    assert rows(got, "peak_deviation") == [(-5.0,)]


def test_three_hops_and_edges(spark):
    given = [incident("front"), incident("checkout"), incident("stock"), incident("checkout", caller="front"), incident("alone")]
    root = "service:stock:percentile_deviation:0"
    assert suppress(spark, given, [("front", "checkout"), ("checkout", "stock")]) == {
        "service:front:percentile_deviation:0": root,
        "service:checkout:percentile_deviation:0": root,
        "edge:front->checkout:percentile_deviation:0": root,
    }


def test_other_detector_or_no_overlap_stays_independent(spark):
    edges = [("front", "checkout")]
    assert suppress(spark, [incident("front"), incident("checkout", detector="error_rate")], edges) == {}
    assert suppress(spark, [incident("front", 0, 60), incident("checkout", 120, 180)], edges) == {}
    assert suppress(spark, [incident("front", 0, 120), incident("checkout", 120, 180)], edges) != {}


def test_only_the_latest_of_a_key_is_linked(spark):
    given = [incident("front", 0, 60), incident("front", 300, 360), incident("stock", 0, 360)]
    assert set(suppress(spark, given, [("front", "stock")])) == {"service:front:percentile_deviation:300"}


def test_ties_go_to_the_smallest_label_and_cycles_end(spark):
    given = [incident(s) for s in ("front", "zeta", "beta")]
    assert suppress(spark, given, [("front", "zeta"), ("front", "beta")])["service:front:percentile_deviation:0"] == (
        "service:beta:percentile_deviation:0"
    )
    ring = [incident(s) for s in ("a", "b", "c")]
    assert suppress(spark, ring, [("a", "b"), ("b", "c"), ("c", "a")]) == {}
    assert suppress(spark, [incident("a"), incident("b")], [("a", "a"), ("a", "b")]) == {}


def leaves(node, graph, seen):
    """Ends of all paths downwards; a node met again on its own path is an end."""
    if node in seen:
        return {node}
    nexts = graph.get(node, [])
    if not nexts:
        return {node}
    return set().union(*[leaves(n, graph, seen | {node}) for n in nexts])


def test_random_call_graphs_against_brute_force(spark):
    rng = random.Random(11)
    given, edges, want = [], set(), {}
    for g in range(25):
        names = [f"g{g}n{i}" for i in range(rng.randint(2, 6))]
        own = {(a, b) for a in names for b in names if rng.random() < 0.35}
        edges |= own
        given += [incident(n) for n in names]
        graph = {a: [b for x, b in own if x == a] for a in names}
        for n in names:
            root = min(leaves(n, graph, frozenset()))
            if root != n:
                want[f"service:{n}:percentile_deviation:0"] = f"service:{root}:percentile_deviation:0"
    assert suppress(spark, given, edges) == want


def test_rolling_regroup_slides_ids_and_keeps_the_last_write(spark):
    given = detections(spark, *[detection(60 * i) for i in range(8)])
    spine = spark.range(0, 600, 60).withColumnRenamed("id", "window_start")
    edges = spark.createDataFrame([("x", "y")], "caller_service string, callee_service string")
    got = rows(I.rolling_regroup(given, edges, spine), "start_window", "end_window", "window_count")
    # as_of 540 sees detections from 240 on; each older start was last seen by the regroup 300 s after it
    assert got == [(0, 300, 6), (60, 360, 6), (120, 420, 6), (180, 420, 5), (240, 420, 4)]
    counters = rows(I.incident_counters(I.rolling_incidents(given, edges, spine), given), "window_start", "incidents_open")
    assert counters == [(60 * i, 1) for i in range(8)]


def test_overlap_pairs(spark):
    df = spark.createDataFrame([incident("a", 0, 120), incident("a", 120, 180, "error_rate"), incident("a", 240, 240, "call_rate")], INCIDENT_DDL)
    got = rows(I.incident_overlap(df, df, ["target"]).filter("incident_id < other_id"), "start_window", "other_id")
    assert got == [(120, "service:a:percentile_deviation:0")]
