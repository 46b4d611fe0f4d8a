import json

import pytest
from helpers import S, rows, span, spans
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spanlake.operators import faults, groundtruth, telemetry
from spanlake.sources import otlp


def request(attributes, service="cart", span_id="0a", trace_id="0B", extra=()):
    one = {"traceId": trace_id, "spanId": span_id, "name": "op", "startTimeUnixNano": "1700000000000000001", "endTimeUnixNano": 1700000000000000002, "status": {"code": 2}, "attributes": attributes}
    resource = {"attributes": [{"key": "service.name", "value": {"stringValue": service}}] if service is not None else []}
    return json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": [one, *extra]}]}]})


def parse(spark, *lines):
    return otlp.parse_otlp(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_row_mapping(spark):
    attributes = [
        {"key": "s", "value": {"stringValue": "x"}}, {"key": "b", "value": {"boolValue": True}}, {"key": "i", "value": {"intValue": "-7"}},
        {"key": "n", "value": {"intValue": 8}}, {"key": "d", "value": {"doubleValue": 1.0}}, {"key": "l", "value": {"arrayValue": {"values": [{"intValue": "1"}]}}},
        {"key": "k", "value": {"kvlistValue": {"values": []}}}, {"key": "y", "value": {"bytesValue": "AA=="}}, {"key": "e", "value": {}},
        {"key": "service.name", "value": {"stringValue": "own"}}, {"key": "s", "value": {"stringValue": "last"}},
    ]
    row = otlp.normalize_span_row(otlp.otlp_flatten(parse(spark, request(attributes)))).first()
    assert (row.trace_id, row.span_id, row.parent_span_id, row.service_name, row.status_code) == ("0b", "0a", "", "cart", 2)
    assert (row.start_time_unix_nano, row.end_time_unix_nano) == (1700000000000000001, 1700000000000000002)
    assert row.attributes == {"s": "last", "b": "true", "i": "-7", "n": "8", "d": "1", "l": "", "k": "", "y": "", "e": ""}


def test_unreadable_times_are_set_aside(spark):
    def one(ident, start, end="1"):
        return {"traceId": "1", "spanId": ident, "startTimeUnixNano": start, "endTimeUnixNano": end}

    spans_ = [one("a", "12x"), one("b", "18446744073709551616"), one("c", "5"), one("d", None), one("e", "1", "")]
    flat = otlp.otlp_flatten(parse(spark, request([], extra=spans_)))
    good, bad = otlp.split_unreadable(flat)
    assert rows(bad, "spanId") == [("a",), ("b",), ("e",)]
    assert rows(otlp.normalize_span_row(flat), "span_id", "start_time_unix_nano")[1:] == [("c", 5), ("d", 0)]
    assert good.count() == 3


def test_service_name_falls_back(spark):
    df = otlp.otlp_flatten(parse(spark, request([], None), request([], "")))
    assert rows(df, "resource_service") == [("",), ("unknown_service",)]


def test_validation_counts_and_corrupt_lines(spark):
    lines = [request([], extra=[{"traceId": "", "spanId": "1"}, {"traceId": "1"}]), "{not json", request([])]
    good, bad = otlp.split_corrupt(parse(spark, *lines))
    assert rows(bad, "_corrupt_record") == [("{not json",)]
    flat = otlp.otlp_flatten(good)
    seen = Observation("ingest")
    assert otlp.validate_spans(flat, seen).count() == 2
    assert seen.get == {"received": 4, "invalid": 2}
    assert tuple(otlp.validation_counts(flat).first()) == (4, 2)


@pytest.mark.parametrize(
    "value,text",
    [(1.0, "1"), (0.0, "0"), (-0.5, "-0.5"), (0.25, "0.25"), (1e21, "1" + "0" * 21), (1.5e-7, "0.00000015"), (123456789.125, "123456789.125"), (-2.5e10, "-25000000000"), (float("nan"), "NaN"), (float("inf"), "+Inf"), (float("-inf"), "-Inf")],
)
def test_fixed_notation(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(otlp.fixed_notation(F.col("v"))).first()[0] == text


def test_ground_truth_edges(spark):
    ddl = "run_id string, trace_id string, span_id string, parent_span_id string, service_name string, generated_at bigint"
    gt = spark.createDataFrame([("r", "t", "a", "", "front", 0), ("r", "t", "b", "a", "cart", 0), ("r", "t", "c", "b", "cart", 0), ("r", "t", "d", "none", "x", 0), ("q", "t", "e", "a", "y", 0)], ddl)
    assert rows(groundtruth.ground_truth_edges(gt), "caller_service", "callee_service") == [("cart", "cart"), ("front", "cart")]


def test_active_incidents_compose(spark):
    specs = spark.createDataFrame(
        [("1", "error_burst", "cart", "", "", 0, 100, 0.2), ("2", "error_burst", "cart", "", "", 50, 100, 0.5), ("3", "latency_spike", "cart", "", "", 0, 60, 2.0), ("4", "latency_spike", "cart", "", "", 40, 60, 3.0)],
        "id string, type string, target_service string, target_caller string, target_callee string, start_offset_s int, duration_s int, magnitude double",
    )
    df = spans(spark, *[span(f"s{t:03d}", "", "cart", (1000 + t) * S) for t in (0, 45, 55, 99, 100, 149, 150)])
    got = rows(groundtruth.active_incidents(df, specs, 1000), "span_id", "error_probability", "spike_factor")
    assert got == [("s000", 0.2, 2.0), ("s045", 0.2, 6.0), ("s055", 0.5, 6.0), ("s099", 0.5, 3.0), ("s100", 0.5, 1.0), ("s149", 0.5, 1.0)]


def test_many_incidents_on_one_service(spark):
    """10,000 overlapping incidents on a service with most spans; only joins by target and cell of time."""
    n = 10_000
    specs = spark.range(n).selectExpr("cast(id AS string) AS id", "'error_burst' AS type", "'cart' AS target_service", "'' AS target_caller", "'' AS target_callee", "cast(id * 2 AS int) AS start_offset_s", "5 AS duration_s", "id / 10000.0D AS magnitude")
    df = spark.range(5000).selectExpr("'t' AS trace_id", "cast(id AS string) AS span_id", "'cart' AS service_name", "1000000000L * (1000 + 4 * id) + 500000000L AS start_time_unix_nano")
    got = {int(r.span_id): r.error_probability for r in groundtruth.active_incidents(df, specs, 1000).collect()}
    # At second 4 i + 0.5 the latest incident that holds has the largest magnitude.
    assert got == {i: pytest.approx(2 * i / 10_000) for i in range(5000)}


def test_faults(spark):
    df = spans(spark, *[span(f"s{i}", "s0" if i else "", "front" if i == 0 else "cart", i, i + 5, "t") for i in range(200)])
    assert faults.fault_drop(df, 0.0).count() == 200 and faults.fault_drop(df, 1.0).count() == 0
    assert 120 < faults.fault_drop(df, 0.25).count() < 180
    ooo = faults.apply_arrival(faults.fault_out_of_order(df, 1.0, 9))
    moved = [r.span_id for r in ooo.filter("ingested_at_unix_nano <> end_time_unix_nano").collect()]
    assert moved == ["s0"]
    late = faults.fault_late_arrival(df, 1.0, 10, 20)
    assert late.filter("arrival_delay_ns < 10 OR arrival_delay_ns >= 20").count() == 0
    both = faults.fault_late_arrival(faults.fault_out_of_order(df, 1.0, 50), 1.0, 10, 20)
    assert dict(rows(both.filter("span_id = 's0'"), "span_id", "arrival_delay_ns")) == {"s0": 50}
    skew = faults.fault_clock_skew(df, 1.0, 1000, "front")
    shift = {r.span_id: r.start_time_unix_nano - int(r.span_id[1:]) for r in skew.collect()}
    assert shift.pop("s0") == 0 and len(set(shift.values())) == 1 and 0 < abs(shift["s1"]) <= 1000
    assert skew.filter("end_time_unix_nano - start_time_unix_nano <> 5").count() == 0
    truth = dict(rows(faults.skew_ground_truth(df, 1.0, 1000, "front"), "service_name", "offset_ns"))
    assert truth == {"front": 0, "cart": shift["s1"]}


def test_telemetry(spark):
    df = spark.createDataFrame([(0.04,), (0.2,), (0.2,), (400.0,)], "v double")
    hist = telemetry.histogram(df, "v", telemetry.SPAN_AGE_BOUNDS)
    got = dict(rows(hist, "le", "cumulative"))
    assert (got[0.05], got[0.1], got[0.25], got[300.0], got[float("inf")]) == (1, 1, 3, 3, 4)
    assert telemetry.histogram_quantile(hist, 0.5).first()[0] == pytest.approx(0.175)
    assert telemetry.histogram_quantile(hist, 0.99).first()[0] == 300.0
    samples = spark.createDataFrame([("m", "i", t, v) for t, v in [(0, 10.0), (10, 30.0), (20, 5.0), (29, 8.0)]], "metric string, instance string, ts bigint, value double")
    assert rows(telemetry.counter_rate(samples, 30), "rate") == [((20 + 5 + 3) / 29,)]
    steps = spark.createDataFrame(
        [("r", 1, 500, 100.0, 99.0), ("r", 2, 1000, 100.0, 90.0), ("r", 3, 1000, 100.0, 99.0), ("r", 4, 2000, 100.0, 90.0), ("r", 5, 2000, 100.0, 97.9), ("r", 6, 2000, 100.0, 90.0)],
        "run string, sequence bigint, target_rate bigint, published double, consumed double",
    )
    verdict = telemetry.throughput_verdict(steps)
    assert rows(verdict.filter("confirmed"), "sequence") == [(4,), (5,)] and rows(verdict.filter("breaking_point"), "sequence") == [(4,)]
    cumulative = spark.createDataFrame([("b", s, le, c) for s, rows_ in {1: (2, 5, 5), 2: (2, 9, 10)}.items() for le, c in zip((2500.0, 5000.0, float("inf")), rows_)], "metric string, step bigint, le double, cumulative bigint")
    assert rows(telemetry.histogram_delta(cumulative, 2500.0, 5000.0), "step", "observations", "in_range") == [(1, 5, 3), (2, 5, 4)]


def test_export_requests_are_parsed_without_a_copy_of_their_text(spark, tmp_path):
    """The text is many times the tables: the queries store none of it, and a stored one reads the same."""
    import os

    from __spark_entry__ import SMOKE_DIR, queries
    from spanlake.plans import catalog
    from spanlake.session import shared_dir

    def stored():
        return {n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n.startswith("otlp")}

    before, run = stored(), queries()
    got = {n: run[n](spark, SMOKE_DIR).collect() for n in ("otlp_flatten", "validate_spans", "resolve_service_name", "normalize_span_row", "skip_corrupt")}
    assert stored() == before
    catalog.otlp_lines(spark, SMOKE_DIR).write.text(str(tmp_path / "lines"))
    requests = otlp.read_otlp(spark, str(tmp_path / "lines"))
    flat = otlp.otlp_flatten(otlp.skip_corrupt(requests))
    unreadable = otlp.split_unreadable(flat)[1].count()
    assert unreadable and got["skip_corrupt"][0].unreadable == unreadable
    assert got["validate_spans"] == otlp.validation_counts(flat).collect()
    assert sorted(map(tuple, got["otlp_flatten"])) == rows(flat, "traceId", "spanId", "resource_service", "name")


def test_unreadable_spans_of_a_request_are_counted_where_parts_are_missing(spark):
    spans_ = [{"traceId": "1", "spanId": "a", "startTimeUnixNano": "12x"}, {"traceId": "1", "spanId": "b", "endTimeUnixNano": ""}, None]
    df = parse(spark, request([], extra=spans_), '{"resourceSpans": [{}, {"scopeSpans": [{}, {"spans": []}]}, null]}', "{}", request([]))
    assert rows(df.select(otlp.unreadable_spans().alias("n")), "n") == [(0,), (0,), (0,), (2,)]
    assert otlp.split_unreadable(otlp.otlp_flatten(df))[1].count() == 2
