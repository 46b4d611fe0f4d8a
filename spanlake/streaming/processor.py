"""The window processor: every micro-batch closes windows and analyses them.

The batch operators do the work; what is kept between micro-batches is in the
tables (including the progress), so a restart continues where it stopped.

The clock is ingestion time: a window closes once a span has arrived the watermark
or more after its end, whatever time that span claims for itself, and it is analysed
over the spans that had arrived by then. Spans that arrive later are stored and
counted. Without traffic :meth:`WindowProcessor.advance` moves the clock, so that
silence is analysed, too. One processor writes to a store at a time; the version of
its tables is the end of the windows closed, which only grows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlake.functions.columns import floor_to, split_target, target_label
from spanlake.operators import aggregates, baseline, clock, detect, incidents, reassembly
from spanlake.operators.dedup import latest_version
from spanlake.operators.windows import arrived_late, with_window
from spanlake.schemas import (
    BASELINE_LOOKBACK_SECONDS,
    BASELINE_MIN_SAMPLES,
    GROUPING_LOOKBACK_SECONDS,
    NS,
    ROOT_SERVICE,
    WATERMARK_SECONDS,
    WINDOW_SECONDS,
)
from spanlake.session import delete, exists, file_system, release, scratch_scope, write_scratch
from spanlake.sources.tables import TableStore
from spanlake.streaming.ingest import RETENTION_DAYS, maintain, start, writer_of

_PROGRESS = "clock_ns bigint, closed_to bigint, writer string, batch bigint"
_Put = Callable[[str, DataFrame], None]
_STATS = ["call_count", "error_count", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms"]


class WindowProcessor:
    def __init__(
        self,
        store: TableStore,
        window_seconds: int = WINDOW_SECONDS,
        watermark_seconds: int = WATERMARK_SECONDS,
        lookback_seconds: int = BASELINE_LOOKBACK_SECONDS,
        min_samples: int = BASELINE_MIN_SAMPLES,
        grouping_seconds: int = GROUPING_LOOKBACK_SECONDS,
        root_service: str = ROOT_SERVICE,
        retention_days: int | None = RETENTION_DAYS,
    ):
        self.store = store
        self.retention_days = retention_days
        self.window_seconds = window_seconds
        self.watermark_seconds = watermark_seconds
        self.lookback_seconds = lookback_seconds
        self.min_samples = min_samples
        self.grouping_seconds = grouping_seconds
        self.root_service = root_service
        self.progress_path = f"{store.root}/_progress_of_windows"

    def stream(self, spans: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        writer = writer_of(self.store.spark, checkpoint)
        return start(
            spans.writeStream.foreachBatch(lambda df, batch: self.process_batch(df, batch, writer)), checkpoint, **options
        )

    def _progress(self, but: tuple[str, int] | None = None) -> tuple[int | None, int | None]:
        """(latest arrival, end of the closed windows); ``but``: without that (writer, batch) and later ones of it."""
        spark = self.store.spark
        if not exists(spark, self.progress_path):
            return None, None
        rows = spark.read.schema(_PROGRESS).parquet(self.progress_path)
        if but is not None:
            rows = rows.filter((F.col("writer") != but[0]) | (F.col("batch") < but[1]))
        row = rows.agg(F.max("clock_ns"), F.max("closed_to")).first()
        return row[0], row[1]

    def _save_progress(self, clock_ns: int | None, closed_to: int | None, writer: str, batch: int) -> None:
        row = self.store.spark.createDataFrame([(clock_ns, closed_to, writer, batch)], _PROGRESS)
        row.coalesce(1).write.partitionBy("writer", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(
            self.progress_path
        )
        # Earlier rows of this writer say nothing more: one is left besides the last.
        fs, at = file_system(self.store.spark, f"{self.progress_path}/writer={writer}")
        names = [status.getPath().getName() for status in fs.listStatus(at)]
        earlier = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        for old in [n for n in earlier if n < batch][:-1]:
            delete(self.store.spark, f"{self.progress_path}/writer={writer}/batch={old}")

    def process_batch(self, batch_spans: DataFrame, batch: int, writer: str = "0") -> None:
        maintain(self.store, "spans", writer, batch, days=self.retention_days)
        self.store.write("spans", batch_spans, batch, writer)
        stored = self.store.versions("spans").filter((F.col("writer") == writer) & (F.col("version") == batch))
        low, first_seen, last_seen = stored.agg(
            F.min("start_time_unix_nano"), F.min("ingested_at_unix_nano"), F.max("ingested_at_unix_nano")
        ).first()
        clock, closed_to = self._progress((writer, batch))
        if low is None:
            self._save_progress(clock, closed_to, writer, batch)
            return
        if closed_to is None:
            # Nothing before the lookback is analysed, however old a first span claims to be.
            w = self.window_seconds
            closed_to = max(low // NS, first_seen // NS - self.lookback_seconds) // w * w
        clock = last_seen if clock is None else max(clock, last_seen)
        late = arrived_late(with_window(stored, self.window_seconds), self.window_seconds, self.watermark_seconds)
        closed_to = self._close(clock, closed_to)
        self._count_late(late, writer, batch)
        self._save_progress(clock, closed_to, writer, batch)

    def advance(self, now: float) -> None:
        """Closes what is due at ``now`` (unix seconds) without new spans."""
        clock, closed_to = self._progress()
        if closed_to is None:
            return
        clock = max(clock or 0, int(now * NS))
        closed_to = self._close(clock, closed_to)
        self._save_progress(clock, closed_to, "clock", closed_to)

    def _close(self, clock_ns: int, closed_to: int) -> int:
        w = self.window_seconds
        until = (clock_ns - self.watermark_seconds * NS) // (w * NS) * w
        if until > closed_to:
            with scratch_scope(self.store.spark):
                self.process_windows(closed_to, until, until)
            release(self.store.spark)
        return max(until, closed_to)

    def _count_late(self, late: DataFrame, writer: str, batch: int) -> None:
        """The batch's late spans by the window they came too late for.

        Rows and version are the batch's own: one repeated after a failure replaces
        its counts, and one that does not move the clock adds to those before.
        """
        counts = late.groupBy("window_start").agg(F.count("*").alias("value"))
        label = F.lit(f"{writer}:{batch}")
        rows = counts.select("window_start", F.lit("late_spans").alias("metric"), label.alias("label"), "value")
        self.store.write("window_counters", rows, batch, f"late-{writer}")

    def process_windows(self, first: int, until: int, version: int) -> None:
        """Analyse the windows starting in [first, until) and write their rows."""
        store, w = self.store, self.window_seconds
        past = first - self.lookback_seconds
        closes = floor_to(F.col("start_time_unix_nano"), w * NS) + (w + self.watermark_seconds) * NS
        arrived = F.col("ingested_at_unix_nano") <= closes
        spans = write_scratch(with_window(store.read("spans", past, until, arrived), w), "recent_spans")
        links = write_scratch(reassembly.parent_links(spans), "recent_links")
        any_pairs = reassembly.pairs_of_links(links)
        pairs = any_pairs.filter("window_start = parent_window_start").filter(F.col("window_start") >= first)
        current = spans.filter(F.col("window_start") >= first)
        spine = store.spark.range(first, until, w).select(F.col("id").alias("window_start"))
        put = partial(self._put, version)

        # Every stage and scan leaves a broadcast of some MB at the driver: they go after each step of a few plans.
        release(store.spark)
        self._reassemble(put, current, links.filter(F.col("window_start") >= first))
        stats = self._statistics(put, current, pairs)
        offsets = clock.clock_offsets(pairs, self.root_service)
        release(store.spark)
        put("service_clock_offsets", offsets)
        table = self._baselines(put, spans, any_pairs, spine, past, until)
        put("detections", detect.run_detection(stats, table))
        recent = store.read("detections", first - self.grouping_seconds, until).select("*", *split_target())
        rolled = self._incidents(put, recent, spine)
        put("window_counters", self._counters(version, table, rolled, recent.filter(F.col("window_start") >= first), pairs))

    def _put(self, version: int, table: str, df: DataFrame) -> None:
        self.store.write(table, df, version, "windows")
        release(self.store.spark)

    def _reassemble(self, put: _Put, current: DataFrame, links: DataFrame) -> None:
        summaries, classes = reassembly.reassemble(current, links)
        release(self.store.spark)
        put("trace_summaries", summaries)
        put("span_classifications", classes)

    def _statistics(self, put: _Put, current: DataFrame, pairs: DataFrame) -> DataFrame:
        stats = write_scratch(aggregates.window_stats(current, pairs), "recent_stats")
        release(self.store.spark)
        put("service_stats", aggregates.as_service_stats(stats))
        edges = aggregates.as_service_edges(stats)
        put("service_edges", edges)
        calls = edges.select("caller_service", "callee_service").distinct()
        put("topology", calls.join(self.store.read("topology"), ["caller_service", "callee_service"], "left_anti"))
        return stats

    def _baselines(self, put: _Put, spans: DataFrame, any_pairs: DataFrame, spine: DataFrame, past: int, until: int) -> DataFrame:
        history = self.history(past, until)
        table = baseline.baselines(
            spans, any_pairs, history, spine, self.window_seconds, self.lookback_seconds, self.min_samples
        )
        release(self.store.spark)
        table = write_scratch(table, "recent_baselines")
        put("service_baselines", baseline.as_service_baselines(table))
        put("edge_baselines", baseline.as_edge_baselines(table))
        return table

    def _incidents(self, put: _Put, recent: DataFrame, spine: DataFrame) -> DataFrame:
        edges = self.store.read("topology")
        rolled = incidents.rolling_incidents(recent, edges, spine, self.window_seconds, self.grouping_seconds)
        release(self.store.spark)
        rolled = write_scratch(rolled, "rolled")
        put("detected_incidents", latest_version(rolled, ["incident_id"], "as_of"))
        return rolled

    def _counters(self, version: int, table: DataFrame, rolled: DataFrame, recent: DataFrame, pairs: DataFrame) -> DataFrame:
        """Per window: traces, incomplete ones by reason, spans by class, violations, cold baselines, incidents.

        ``version`` holds the windows just closed and no others, a row per key. All that is counted goes through
        one aggregation, so the driver plans and runs one shuffle, not one a metric.
        """

        def own(name: str) -> DataFrame:
            return self.store.versions(name).filter((F.col("writer") == "windows") & (F.col("version") == version))

        def rows(df: DataFrame, metric: str, label: Column, at: str = "window_start") -> DataFrame:
            return df.select(F.col(at).alias("window_start"), F.lit(metric).alias("metric"), label.alias("label"))

        summaries = own("trace_summaries")
        parts = [
            rows(summaries, "traces_processed", F.lit("")),
            rows(summaries.filter("NOT complete"), "incomplete_traces", F.col("incompleteness_reason")),
            rows(own("span_classifications").filter("classification <> 'ok'"), "orphan_spans", F.col("classification")),
            rows(clock.clock_violations(pairs), "clock_violations", F.col("callee_service")),
            rows(table.filter("NOT ready"), "cold_baselines", F.col("target_type"), "as_of"),
        ]
        counted = parts[0]
        for part in parts[1:]:
            counted = counted.unionByName(part)
        counts = counted.groupBy("window_start", "metric", "label").agg(F.count("*").alias("value"))
        opened = incidents.incident_counters(rolled, recent)
        both = [
            F.struct(F.lit(metric).alias("metric"), F.lit("").alias("label"), F.col(value).alias("value"))
            for metric, value in (("incidents_open", "incidents_open"), ("suppressed", "suppressed_count"))
        ]
        return counts.unionByName(opened.select("window_start", F.inline(F.array(*both))))

    def history(self, low: int, high: int) -> DataFrame:
        """Stored window statistics of all targets."""
        services = self.store.read("service_stats", low, high).select(
            "window_start", F.lit("service").alias("target_type"), F.lit("").alias("caller"),
            F.col("service_name").alias("callee"), *_STATS,
        )
        edges = self.store.read("service_edges", low, high).select(
            "window_start", F.lit("edge").alias("target_type"), F.col("caller_service").alias("caller"),
            F.col("callee_service").alias("callee"), *_STATS,
        )
        return services.unionByName(edges).withColumn("target", target_label())
