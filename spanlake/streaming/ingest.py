"""Structured Streaming: ingest, deduplication, late spans, window statistics."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from spanlake.functions.columns import duration_ns, floor_to, is_error, ns_to_timestamp
from spanlake.operators.aggregates import as_service_stats
from spanlake.operators.dedup import latest_version
from spanlake.operators.quantiles import percentiles
from spanlake.operators.windows import arrived_late, as_seen, with_window
from spanlake.schemas import KEYS, NS, WATERMARK_SECONDS, WINDOW_SECONDS
from spanlake.session import exists
from spanlake.sources.tables import TableStore

BATCH_INTERVAL = "2 seconds"
MERGE_EVERY, RETENTION_DAYS = 100, 30
#: Ranges of start times that a batch is compared with.
RANGES = 32


def start(writer: DataStreamWriter, checkpoint: str, available_now: bool = False, interval: str = BATCH_INTERVAL) -> StreamingQuery:
    """Micro-batches by size (the source's limit) or time, whichever comes first."""
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The id under which the stream with that checkpoint writes; later streams sort behind.

    It is kept with the checkpoint: a restart goes on as the same writer, and a new
    checkpoint, whose batches count from 0 again, is a new one.
    """
    path = f"{checkpoint.rstrip('/')}/writer"
    if not exists(spark, f"{path}/_SUCCESS"):
        name = f"{time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex[:8]}"
        spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).first()[0]


def maintain(store: TableStore, table: str, writer: str, batch: int, every: int = MERGE_EVERY, days: int | None = RETENTION_DAYS) -> None:
    """What a stream does for its table between two batches.

    After every ``every`` batches those become one version, after ``every`` times as
    many these do, and so on: a day of batches leaves less than ``every`` versions a
    level, and a row is rewritten once a level. Days past the retention are dropped.
    """
    size, merged = every, False
    while batch and batch % size == 0:
        store.merge_batches(table, writer, batch, size)
        size, merged = size * every, True
    if merged and days is not None:
        store.keep_days(table, days)


def stream_ingest(
    spans: DataFrame, store: TableStore, checkpoint: str, merge_every: int = MERGE_EVERY, retention_days: int | None = RETENTION_DAYS, **options
) -> StreamingQuery:
    """Append every micro-batch to the span table, and keep the table in order.

    The batch id is the version written, so a batch repeated after a failure
    replaces itself; copies sent twice by the producers go at read time.
    """
    writer = writer_of(store.spark, checkpoint)

    def save(df: DataFrame, batch: int) -> None:
        maintain(store, "spans", writer, batch, merge_every, retention_days)
        store.write("spans", df, batch, writer)

    return start(spans.writeStream.foreachBatch(save), checkpoint, **options)


def with_event_time(spans: DataFrame, delay_seconds: int = WATERMARK_SECONDS) -> DataFrame:
    """Event time and watermark, for aggregations that end with their windows.

    The watermark follows the latest event seen, not the clock, and rows behind it are
    dropped by the engine: what must be kept goes through :func:`stream_dedup`,
    :func:`stream_late_side_output` or the window processor.
    """
    return spans.withColumn("event_time", ns_to_timestamp(F.col("start_time_unix_nano"))).withWatermark(
        "event_time", f"{delay_seconds} seconds"
    )


def stream_dedup(
    spans: DataFrame, store: TableStore, checkpoint: str, merge_every: int = MERGE_EVERY, retention_days: int | None = RETENTION_DAYS, **options
) -> StreamingQuery:
    """The first copy of every (trace_id, span_id) to the span table, however late it comes.

    A micro-batch is held against the stored spans that start when its own do, not
    against state with a watermark, behind which rows would be dropped. Files are from
    a batch or a few, so of a day only those of the batch's ranges of time are read,
    however much the day holds.
    """
    writer = writer_of(store.spark, checkpoint)

    def save(df: DataFrame, batch: int) -> None:
        maintain(store, "spans", writer, batch, merge_every, retention_days)
        first = latest_version(df.withColumn("_first", -F.col("ingested_at_unix_nano")), KEYS["spans"], "_first").drop("_first")
        first = first.persist()
        try:
            ranges = start_ranges(first)
            if not ranges:
                return
            known = store.versions("spans").filter(_within(ranges))
            known = known.filter((F.col("writer") != writer) | (F.col("version") != batch))  # not what a retry wrote
            store.write("spans", first.join(known.select(*KEYS["spans"]), KEYS["spans"], "left_anti"), batch, writer)
        finally:
            first.unpersist()

    return start(spans.writeStream.foreachBatch(save), checkpoint, **options)


def start_ranges(spans: DataFrame, most: int = RANGES, cell_seconds: int = 600) -> list[tuple[int, int]]:
    """Ranges of start times (ns, inclusive) that cover all spans; the narrowest gaps are closed first."""
    cell = floor_to(F.col("start_time_unix_nano"), cell_seconds * NS)
    cells = spans.groupBy(cell.alias("cell")).agg(F.min("start_time_unix_nano").alias("low"), F.max("start_time_unix_nano").alias("high"))
    # A row per ten minutes of what one batch covers.
    ranges = sorted((r.low, r.high) for r in cells.collect())
    while len(ranges) > most:
        k = min(range(len(ranges) - 1), key=lambda i: ranges[i + 1][0] - ranges[i][1])
        ranges[k : k + 2] = [(ranges[k][0], ranges[k + 1][1])]
    return ranges


def _within(ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        days = [F.timestamp_seconds(F.lit(at // NS)).cast("date") for at in (low, high)]
        out = out | (F.col("day").between(*days) & F.col("start_time_unix_nano").between(low, high))
    return out


def service_frequencies(
    spans: DataFrame, window_seconds: int = WINDOW_SECONDS, delay_seconds: int = WATERMARK_SECONDS
) -> DataFrame:
    """Counts per (window, service, duration), emitted once when the window closes.

    The state is one small row per distinct duration, spread over all tasks.
    """
    calls = with_event_time(spans, delay_seconds).withColumns(
        {"_v": duration_ns(), "_e": is_error().cast("bigint")}
    )
    return (
        calls.groupBy(F.window("event_time", f"{window_seconds} seconds").alias("w"), "service_name", "_v")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_e").alias("error_count"))
        .select(
            F.unix_timestamp("w.start").alias("window_start"),
            F.lit("service").alias("target_type"),
            F.lit("").alias("caller"),
            F.col("service_name").alias("callee"),
            "_v",
            "_n",
            "error_count",
        )
    )


def stream_service_stats(
    spans: DataFrame,
    store: TableStore,
    checkpoint: str,
    window_seconds: int = WINDOW_SECONDS,
    delay_seconds: int = WATERMARK_SECONDS,
    **options,
) -> StreamingQuery:
    """Exact statistics of every closed window and service.

    All counts of a window arrive in the one micro-batch that closes it, so
    its percentiles can be finished there.
    """

    def finish(freq: DataFrame, batch: int) -> None:
        keys = ["window_start", "target_type", "caller", "callee"]
        freq = freq.persist()  # read twice; the state must be read once
        try:
            out = percentiles(freq, keys, "_v", [0.5, 0.95, 0.99], ["error_count"], weight="_n")
            ms = [(F.col(f"p{i}") / 1e6).alias(f"latency_p{p}_ms") for i, p in enumerate((50, 95, 99))]
            stats = out.select(*keys, F.col("n").alias("call_count"), "error_count", *ms)
            store.write("service_stats", as_service_stats(stats), batch, writer)
        finally:
            freq.unpersist()

    writer = writer_of(store.spark, checkpoint)
    freq = service_frequencies(spans, window_seconds, delay_seconds)
    return start(freq.writeStream.outputMode("append").foreachBatch(finish), checkpoint, **options)


def stream_late_side_output(
    spans: DataFrame,
    on_time: TableStore,
    late: TableStore,
    checkpoint: str,
    window_seconds: int = WINDOW_SECONDS,
    delay_seconds: int = WATERMARK_SECONDS,
    **options,
) -> StreamingQuery:
    """Keep spans that arrive after their window closed apart from the others.

    A window closes at its end plus the watermark on the clock, as ingestion
    time shows it; the engine's own watermark would drop such rows silently.
    """

    writer = writer_of(on_time.spark, checkpoint)

    def split(df: DataFrame, batch: int) -> None:
        df = with_window(df, window_seconds).persist()
        try:
            on_time.write("spans", as_seen(df, window_seconds, delay_seconds), batch, writer)
            late.write("spans", arrived_late(df, window_seconds, delay_seconds), batch, writer)
        finally:
            df.unpersist()

    return start(spans.writeStream.foreachBatch(split), checkpoint, **options)


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an ``available_now`` query and raise what it raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


