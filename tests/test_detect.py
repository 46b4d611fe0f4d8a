import pytest
from helpers import BASELINE_DDL, STATS_DDL, rows

from spanlake.operators import detect


def stats(spark, *given):
    full = [(60, "service", "", s, s, calls, errors, p50, p95, p99) for s, calls, errors, p50, p95, p99 in given]
    return spark.createDataFrame(full, STATS_DDL)


def base(spark, *given):
    full = [(60, "service", "", s, s, *rest) for s, *rest in given]
    return spark.createDataFrame(full, BASELINE_DDL)


def b(name, n=1000, median=10.0, mad=1.0, errors=0.01, rate=100.0, rate_mad=5.0, ready=True):
    return (name, n, median, mad, errors, rate, rate_mad, 15, ready)


def test_percentile_deviation(spark):
    now = stats(
        spark, ("tail", 50, 0, 10.0, 11.0, 30.0), ("p95", 50, 0, 10.0, 16.0, 15.9), ("calm", 50, 0, 10.0, 11.0, 12.0),
        ("cold", 50, 0, 10.0, 90.0, 90.0), ("flat", 50, 0, 10.0, 90.0, 90.0), ("unknown", 50, 0, 1.0, 90.0, 90.0),
    )
    past = base(spark, b("tail"), b("p95"), b("calm"), b("cold", ready=False), b("flat", mad=0.0))
    got = rows(detect.detect_percentile_deviation(now, past), "target", "severity", "observed_value", "deviation")
    assert [g[:3] for g in got] == [("p95", "warning", 16.0), ("tail", "critical", 30.0)]
    assert got[1][3] == pytest.approx(20 / 1.4826)


def test_error_rate(spark):
    now = stats(
        spark, ("burst", 100, 30, 1.0, 1.0, 1.0), ("few", 9, 9, 1.0, 1.0, 1.0), ("none", 100, 0, 1.0, 1.0, 1.0),
        ("all", 100, 100, 1.0, 1.0, 1.0), ("better", 100, 0, 1.0, 1.0, 1.0),
    )
    past = base(spark, b("burst"), b("few"), b("none", errors=0.0), b("all", errors=1.0), b("better", errors=0.5))
    got = rows(detect.detect_error_rate(now, past), "target", "severity", "observed_value", "baseline_value")
    assert got == [("burst", "critical", 0.3, 0.01)]


def test_call_rate_drop(spark):
    now = stats(
        spark, ("drop", 70, 0, 1.0, 1.0, 1.0), ("fine", 99, 0, 1.0, 1.0, 1.0), ("half", 49, 0, 1.0, 1.0, 1.0),
        ("more", 500, 0, 1.0, 1.0, 1.0), ("steady", 51, 0, 1.0, 1.0, 1.0),
    )
    past = base(
        spark, b("drop"), b("fine"), b("gone"), b("more"), b("half", rate_mad=0.0), b("steady", rate_mad=0.0),
        b("never", rate=0.0, rate_mad=0.0), b("cold", ready=False),
    )
    got = rows(detect.detect_call_rate_drop(now, past), "target", "severity", "observed_value", "deviation")
    assert [g[:3] for g in got] == [("drop", "warning", 70.0), ("gone", "critical", 0.0), ("half", "critical", 49.0)]
    assert got[2][3] == pytest.approx(-0.51)
    together = detect.run_detection(now, past)
    apart = [detect.detect_percentile_deviation(now, past), detect.detect_error_rate(now, past), detect.detect_call_rate_drop(now, past)]
    assert together.count() == sum(d.count() for d in apart)
