"""The processor's counters: one aggregation for all that is counted."""

import re

from helpers import BASELINE_DDL, DETECTION_DDL, MS, rows, span, spans

from spanlake.operators.reassembly import resolved_pairs
from spanlake.session import scratch_path
from spanlake.sources.tables import TableStore
from spanlake.streaming.processor import WindowProcessor

ROLLED_DDL = "as_of bigint, end_window bigint, derived boolean, target_type string, target string, detector string"


def test_counters_take_one_shuffle_however_many_metrics(spark):
    processor = WindowProcessor(TableStore(spark, scratch_path(spark, "store")))
    pairs = resolved_pairs(spans(spark, span("p", start=20 * MS), span("c", "p", "back", start=10 * MS), span("d", "p", "back", start=5 * MS)))
    cold = spark.createDataFrame([(0, "service", "", "a", "a", 1, 1.0, 1.0, 0.0, 1.0, 0.0, 1, False)], BASELINE_DDL)
    rolled = spark.createDataFrame([(0, 0, True, "service", "a", "call_rate")], ROLLED_DDL)
    found = spark.createDataFrame([(0, "service", "", "a", "a", "call_rate", "warning", 1.0, 1.0, 1.0)], DETECTION_DDL)
    out = processor._counters(60, cold, rolled, found, pairs)
    expected = [("clock_violations", "back", 2), ("cold_baselines", "service", 1), ("incidents_open", "", 1), ("suppressed", "", 1)]
    assert sorted(rows(out, "metric", "label", "value")) == expected
    plan = out._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :].split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(window_start#\d+L?, metric#", physical)) == 1
