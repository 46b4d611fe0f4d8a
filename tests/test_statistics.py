import numpy as np
import pytest
from helpers import MS, S, rows, span, spans

from spanlake.operators import aggregates, baseline, clock, quantiles, reassembly
from spanlake.operators.windows import window_spine


@pytest.mark.parametrize("spread", [5, 1000, 10**12])
def test_exact_percentiles_and_mad_of_skewed_groups(spark, spread):
    rng = np.random.default_rng(spread)
    data = {
        "hot": rng.integers(-spread, spread, 3000),
        "same": np.full(500, 7),
        "one": np.array([42]),
        "two": np.array([1, 4]),
        "edges": np.array([0, 1, 31, 32, 33, 63, 64, 65, 2**40 - 1, 2**40, 2**40 + 1, -(2**40)]),
    }
    df = spark.createDataFrame([(k, int(v)) for k, vs in data.items() for v in vs], "k string, v bigint")
    got = {r.k: r for r in quantiles.percentiles(df, ["k"], "v", [0.0, 0.5, 0.95, 0.99, 1.0]).collect()}
    mads = {r.k: r for r in quantiles.median_mad(df, ["k"], "v").collect()}
    for k, values in data.items():
        want = np.percentile(values, [0, 50, 95, 99, 100])
        assert np.allclose([got[k][f"p{i}"] for i in range(5)], want, rtol=1e-12, atol=1e-6)
        assert got[k].n == mads[k].n == len(values)
        median = np.median(values)
        assert mads[k]["median"] == median and mads[k]["mad"] == np.median(np.abs(values - median))


@pytest.mark.parametrize("spread", [3, 10**4, 2**61])
def test_full_buckets_are_split_further(spark, monkeypatch, spread):
    """One bucket with far more values than a task may rank, and many copies of one value."""
    monkeypatch.setattr(quantiles, "RANKED", 40)
    monkeypatch.setattr(quantiles, "DIGITS", 3)
    seen = []
    original = quantiles._cumulative
    monkeypatch.setattr(quantiles, "_cumulative", lambda keys, order: (seen.append(order), original(keys, order))[1])
    rng = np.random.default_rng(7)
    data = {
        "hot": 2**62 + rng.integers(0, spread, 1500),  # one bucket
        "both": np.concatenate([rng.integers(-spread, spread, 700), np.full(600, 5)]),
        "few": np.array([3, 9]),
    }
    df = spark.createDataFrame([(k, int(v)) for k, vs in data.items() for v in vs], "k string, v bigint")
    got = {r.k: r for r in quantiles.percentiles(df, ["k"], "v", [0.25, 0.5, 0.99]).collect()}
    assert seen.count("_cell") >= (2 if spread > 40 else 1)
    for k, values in data.items():
        want = np.percentile(np.array(values, object), [25, 50, 99])
        assert np.allclose([got[k][f"p{i}"] for i in range(3)], [float(w) for w in want], rtol=1e-12)
    if spread > 2**60:
        return  # four times a deviation is beyond a BIGINT
    small = df.filter("k <> 'hot'").union(df.filter("k = 'hot'").selectExpr("k", "v - 4611686018427387904 + 1048576"))
    mads = {r.k: r for r in quantiles.median_mad(small, ["k"], "v").collect()}
    for k, values in data.items():
        values = values - 2**62 + 2**20 if k == "hot" else values
        assert mads[k]["median"] == np.median(values) and mads[k]["mad"] == np.median(np.abs(values - np.median(values)))


def test_no_task_ranks_more_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "RANKED", 100)
    monkeypatch.setattr(quantiles, "DIGITS", 4)
    values = spark.range(20_000).selectExpr("1 AS g", "id * 7919 % 65536 AS v", "CAST(1 AS BIGINT) AS _n", "CAST(0 AS BIGINT) AS _lo", "CAST(20000 AS BIGINT) AS n")
    from pyspark.sql import functions as F

    ranks = [F.lit(137), F.lit(9_999)]
    out = quantiles._ranked(values, ["g", "n"], ranks, "v", 20_000).collect()
    want = np.sort(np.arange(20_000) * 7919 % 65536)
    assert {r._x for r in out if any(r._lo <= k < r._hi for k in (137, 9_999))} == {want[137], want[9_999]}
    per_task = {}
    for r in out:
        per_task[r._cell] = per_task.get(r._cell, 0) + 1
    assert len(per_task) == 2 and max(per_task.values()) <= 100


def test_service_and_edge_stats(spark):
    df = spans(
        spark,
        span("a", service="front", end=100 * MS), span("b", "a", "cart", end=10 * MS, status=2),
        span("c", "a", "cart", end=30 * MS), span("d", "c", "cart", end=5 * MS, status=0), span("e", "gone", "cart"),
    )
    stats = rows(aggregates.service_stats(df), "service_name", "call_count", "error_count", "latency_p50_ms")
    assert stats == [("cart", 4, 1, 10.0), ("front", 1, 0, 100.0)]
    edges = rows(
        aggregates.service_edges(reassembly.resolved_pairs(df)),
        "caller_service", "callee_service", "call_count", "error_count", "latency_p99_ms",
    )
    assert [e[:4] for e in edges] == [("cart", "cart", 1, 0), ("front", "cart", 2, 1)]
    assert edges[1][4] == pytest.approx(29.8)


def hub(offsets, n=40):
    out = []
    for i in range(n):
        trace, at = f"t{i}", i * 100 * MS
        calls = [("r", "", "frontend", 0), ("c", "r", "checkout", 5), ("i", "c", "inventory", 9), ("s", "c", "shipping", 12), ("n", "s", "notifications", 15)]
        for sid, parent, service, shift in calls:
            begin = at + shift * MS + offsets.get(service, 0)
            out.append(span(sid, parent, service, begin, begin + (50 - shift) * MS, trace))
    return out


def test_skewed_hub_is_recovered(spark):
    pairs = reassembly.resolved_pairs(spans(spark, *hub({"checkout": -1700 * MS}), window=3600))
    pairs = pairs.filter("window_start = 0") if pairs.filter("window_start = 0").count() else pairs
    got = {r.service_name: r for r in clock.clock_offsets(pairs).collect() if r.window_start == 0}
    assert got["frontend"].offset_ns == 0 and got["frontend"].confidence == 0
    assert abs(got["checkout"].offset_ns + 1700 * MS) <= 10 * MS
    kinds = {r.kind for r in clock.clock_violations(pairs).collect()}
    assert kinds <= {"starts_before_parent", "ends_after_parent"}


def test_offsets_round_half_even_and_skip_unreachable(spark):
    gaps = spark.createDataFrame(
        [(0, "frontend", "a", 4, 3.0), (0, "a", "b", 4, 2.5), (0, "b", "c", 4, 3.5), (0, "x", "y", 9, 0.0), (0, "z", "z", 3, 9.0),
         (60, "q", "w", 2, 5.0)],
        "window_start bigint, caller_service string, callee_service string, n bigint, median_gap_ns double",
    )
    got = rows(clock.offsets_from_gaps(gaps), "window_start", "service_name", "offset_ns", "confidence")
    # frontend 0 -> a 3 -> b 5.5 (to 6) -> c 9.5 (to 10)
    assert got == [(0, "a", 3, 4), (0, "b", 6, 4), (0, "c", 10, 4), (0, "frontend", 0, 0), (60, "frontend", 0, 0)]


def test_baseline_ignores_the_judged_window_and_silent_ones(spark):
    given = []
    for w in (0, 1, 2, 4):
        for i in range(10 * (w + 1)):
            given.append(span(f"s{w}-{i}", "", "svc", w * 60 * S + i, w * 60 * S + i + (w + 1) * MS, f"t{w}-{i}", 2 if i == 0 else 1))
    # a call whose parent is in the window before: counts for edges over the lookback only
    given += [span("p", "", "up", 119 * S, None, "x"), span("k", "p", "down", 121 * S, None, "x")]
    df = spans(spark, *given)
    any_pairs = reassembly.resolved_pairs(df, False).withColumnRenamed("child_window_start", "window_start")
    stats = aggregates.window_stats(df, any_pairs.filter("window_start = parent_window_start"))
    table = baseline.baselines(df, any_pairs, stats, window_spine(df), 60, 180, 30)
    got = {(r.as_of, r.target): r for r in table.collect()}
    third = got[(180, "svc")]  # windows 0, 60, 120: 10 + 20 + 30 calls
    assert (third.call_count_observed, third.latency_median_ms, third.latency_mad_ms, third.ready) == (60, 2.5, 0.5, True)
    assert (third.call_rate_median, third.call_rate_mad, third.window_count_observed) == (20.0, 10.0, 3)
    assert third.error_rate == 3 / 60
    assert got[(60, "svc")].ready is False and (0, "svc") not in got
    assert (got[(240, "svc")].call_count_observed, got[(240, "svc")].window_count_observed) == (50, 2)
    edge = got[(180, "up->down")]
    assert (edge.call_count_observed, edge.window_count_observed, edge.call_rate_median) == (1, 0, 0.0)
    assert rows(baseline.cold_counts(table).filter("as_of = 60"), "target_type", "cold") == [("service", 1)]


def test_lookback_not_a_multiple_of_the_window(spark):
    df = spans(spark, *[span(f"s{i}", "", "svc", i * 10 * S, i * 10 * S + (i + 1) * MS, f"t{i}") for i in range(30)])
    pairs = reassembly.resolved_pairs(df, False).withColumnRenamed("child_window_start", "window_start")
    stats = aggregates.window_stats(df, pairs.drop("parent_window_start"))
    table = baseline.baselines(df, pairs, stats, window_spine(df), 60, 100, 1)
    for r in table.collect():
        inside = [i + 1.0 for i in range(30) if r.as_of - 100 <= i * 10 < r.as_of]
        assert r.call_count_observed == len(inside) and r.latency_median_ms == pytest.approx(np.median(inside))


def test_values_of_ranges_are_never_broadcast(spark):
    """The copies along a range escape the estimate of their size, so even small tables are joined by shuffles."""
    rows_ = spark.range(2000).selectExpr("id % 3 AS k", "id AS v", "id % 50 AS k_lo", "id % 50 + 14 AS k_hi")
    plan = quantiles.median_mad_over_ranges(rows_, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "_b#" in line]
    assert joins and all("strategy=merge" in line for line in joins)


@pytest.mark.parametrize("bound", [10**6, 60])
def test_rolling_medians_move_each_call_at_most_twice(spark, monkeypatch, bound):
    """The same medians from tasks that hold a stretch and from histograms; no copies along the ranges move."""
    monkeypatch.setattr(quantiles, "RANKED", bound)
    rng = np.random.default_rng(3)
    calls = [(int(k), int(lo), int(lo + w), int(v), int(e)) for k, lo, w, v, e in zip(
        rng.integers(0, 3, 900), np.where(rng.random(900) < 0.3, 45, rng.integers(-70, 200, 900)), rng.integers(-1, 15, 900), rng.integers(-50, 10**6, 900), rng.integers(0, 2, 900), strict=True)]
    df = spark.createDataFrame(calls, "k int, k_lo bigint, k_hi bigint, v bigint, e bigint")
    out = quantiles.rolling_median_mad(df, ["k"], "v", 60, ["e"])
    got = {(r.k, r.as_of_index): (r.n, r.e, r.median2, r.mad4) for r in out.collect()}
    want = {}
    for k in range(3):
        for at in range(-70, 215):
            mine = [(v, e) for q, lo, hi, v, e in calls if q == k and lo <= at <= hi]
            if mine:
                v = np.array([m[0] for m in mine])
                m2 = int(2 * np.median(v))
                want[k, at] = (len(v), sum(m[1] for m in mine), m2, int(2 * np.median(np.abs(2 * v - m2))))
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("FlatMapGroupsInArrow" in plan) and ("Union" in plan) == (bound == 60)


def test_percentiles_of_small_groups_take_one_shuffle(spark):
    df = spark.range(5000).selectExpr("id % 700 AS k", "id * 7919 % 10007 AS v", "1L AS e")
    out = quantiles.percentiles(df, ["k"], "v", [0.5, 0.95], ["e"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for r in out.collect():
        mine = np.arange(5000)[np.arange(5000) % 700 == r.k] * 7919 % 10007
        assert np.allclose([r.p0, r.p1], np.percentile(mine, [50, 95])) and r.n == r.e == len(mine)
