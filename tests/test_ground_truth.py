"""Ground truth as a table by trace: only what is asked for is made, and joins within it move no span."""

import pytest

from spanlake.operators import evaluate
from spanlake.operators.dedup import latest_version
from spanlake.plans import catalog
from spanlake.schemas import KEYS
from spanlake.sources import tabular

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def truth(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    catalog._GROUND_TRUTH.clear()
    yield catalog._ground_truth(spark, SF_DIR)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_what_a_query_reads_is_written(truth):
    assert "type" in truth["incidents"].columns
    assert "edges" not in truth and "offsets" not in truth


def test_calls_and_landed_spans_are_joined_where_they_are(spark, truth):
    from spanlake.operators.groundtruth import ground_truth_edges

    a = catalog.analysis(spark, SF_DIR)
    assert "Exchange hashpartitioning" not in plan(ground_truth_edges(truth["spans"]))
    landed = evaluate.eval_landed(truth["spans"], a.spans)
    assert "Exchange hashpartitioning" not in plan(landed) and landed.count() > 0


def test_the_same_copy_stays_without_the_other_columns(spark, truth):
    whole = latest_version(tabular.sent_spans(spark, SF_DIR), KEYS["spans"], "ingested_at_unix_nano")
    columns = ["trace_id", "span_id", "parent_span_id", "service_name"]
    mine, theirs = truth["rows"].select(*columns), whole.select(*columns)
    assert mine.count() == theirs.count() and mine.exceptAll(theirs).isEmpty()
