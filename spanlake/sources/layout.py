"""Span tables laid out by trace: bucketed and sorted by trace id, days as folders.

Everything that puts a trace's spans together (parent links, reassembly, summaries)
then joins and aggregates bucket by bucket without moving spans again. A look-up of
one trace reads one bucket, and of its files only the row groups whose Bloom filter
knows the id; a range of time reads its days.

Buckets keep a trace in one task. Where one trace, or a few that share a hash, hold
too many rows for that, the table is written without buckets: its joins then shuffle,
and the engine splits their skewed partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.columns import int_div, seconds_to_date
from spanlake.schemas import NS
from spanlake.session import configure, scratch_path

#: Rows that a bucket has on large tables (one task sorts them, at up to a kilobyte a row) and at least has on small ones.
BUCKET_ROWS, LEAST_ROWS = 500_000, 25_000
#: A load of a cell of traces is hot beyond this many rows and times the mean.
HOT_ROWS, HOT_TIMES, CELLS = 1_000_000, 8, 1024

#: Row groups know their trace ids, in filters as large as the ids need.
BLOOM = {
    "parquet.bloom.filter.enabled#trace_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.max.bytes": str(4 << 20),
}


@dataclass(frozen=True)
class Layout:
    """``buckets`` is 0 where traces are too uneven to be kept in one task each."""

    buckets: int

    @staticmethod
    def of(rows: DataFrame, hot_rows: int = HOT_ROWS) -> Layout:
        """From one pass over the trace ids, summed up by hash cells before anything moves."""
        cells = rows.groupBy(F.pmod(F.xxhash64("trace_id"), F.lit(CELLS)).alias("cell")).agg(F.count("*").alias("n"))
        total, largest = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if largest > max(hot_rows, HOT_TIMES * total / CELLS):
            return Layout(0)
        few = min(rows.sparkSession.sparkContext.defaultParallelism, total // LEAST_ROWS + 1)
        return Layout(max(few, total // BUCKET_ROWS + 1))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """The rows by bucket; as they are where there are none."""
        return rows.repartition(self.buckets, "trace_id") if self.buckets else rows

    def write(self, rows: DataFrame, name: str, days: Sequence[str] = ()) -> DataFrame:
        """Writes rows that are dealt by trace (else every task adds a file to every bucket) and reads them back.

        The bucketed table is an external one in the shared folder; its catalog entry
        lives as long as the session's catalog does.
        """
        spark = configure(rows.sparkSession)
        path = scratch_path(spark, name)
        writer = rows.write.options(**BLOOM)
        if days:
            writer = writer.partitionBy(*days)
        if not self.buckets:
            writer.parquet(path)
            return spark.read.schema(rows.schema).parquet(path)
        order = [c for c in ("trace_id", "window_start", "span_id") if c in rows.columns]
        table = f"{name}_{uuid.uuid4().hex}"
        writer.bucketBy(self.buckets, "trace_id").sortBy(*order).option("path", path).format("parquet").saveAsTable(table)
        return spark.table(table)


def day(ns: Column) -> Column:
    return seconds_to_date(int_div(ns, NS))


def span_days() -> dict[str, Column]:
    """The folders of a span table: days of start and, nearly always the same, of arrival."""
    return {"start_date": day(F.col("start_time_unix_nano")), "arrival_date": day(F.col("ingested_at_unix_nano"))}


def in_days(spans: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Only the folders of days that hold instants from ``low`` to ``high`` (unix seconds), where the table has them."""
    if column not in spans.columns:
        return spans
    at = lambda sec: F.timestamp_seconds(F.lit(int(sec // 1))).cast("date")
    if low is not None:
        spans = spans.filter(F.col(column) >= at(low))
    if high is not None:
        spans = spans.filter(F.col(column) <= at(high))
    return spans
