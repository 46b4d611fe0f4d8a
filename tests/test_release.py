"""What the window processor leaves behind at the driver."""

import os
import time

from helpers import rows, span, spans

from spanlake.schemas import NS
from spanlake.session import scratch_path, shared_dir
from spanlake.sources.tables import TableStore
from spanlake.streaming.processor import WindowProcessor


def checkpoints(spark):
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {name for name in os.listdir(root) if name.startswith("rdd-")}


def test_a_micro_batch_leaves_no_checkpoints(spark):
    """They go with the plans that read them, not when the driver's heap happens to be full."""
    shared_dir(spark)
    processor = WindowProcessor(TableStore(spark, scratch_path(spark, "store")))
    given = spans(spark, span("p", ingested=NS), span("c", "p", "back", ingested=NS), span("last", start=600 * NS, ingested=600 * NS))
    before = checkpoints(spark)
    processor.process_batch(given, 0)
    assert rows(processor.store.read("service_edges"), "callee_service", "call_count") == [("back", 1)]
    until = time.time() + 20
    while (left := checkpoints(spark) - before) and time.time() < until:
        time.sleep(0.5)
    assert not left
