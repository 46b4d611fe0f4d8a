"""Parquet tables with replace-latest semantics, date partitions and retention."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.columns import seconds_to_date
from spanlake.operators.dedup import latest_version
from spanlake.schemas import KEYS, NS, SCHEMAS, TIME_COLUMN
from spanlake.session import delete, exists, file_system, scratch_scope, write_scratch
from spanlake.sources.layout import BLOOM
from spanlake.sources.layout import day as day_of


def _day(table: str) -> Column:
    column = F.col(TIME_COLUMN[table])
    return day_of(column) if table == "spans" else seconds_to_date(column)


class TableStore:
    """The span table and the derived tables under one folder.

    A write appends the rows as one numbered version of one writer, partitioned by
    day. A repeated write of the same number by the same writer replaces its own
    partitions, so a retried micro-batch is harmless; other writers' rows stay.
    A read returns the newest row per key: the later writer's, then the higher
    version's. :meth:`compact` turns a closed day into one version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, table: str, df: DataFrame, version: int, writer: str = "0") -> None:
        columns = [f.name for f in SCHEMAS[table].fields]
        rows = df.select(*columns)
        partitions = ["writer", "version"]
        if table in TIME_COLUMN:
            rows = rows.withColumn("day", _day(table))
            partitions = ["day", *partitions]
        rows = rows.withColumns({"writer": F.lit(writer), "version": F.lit(int(version)).cast("bigint")})
        if "trace_id" in columns:
            # Sorted files with Bloom filters: a look-up of one trace skips what cannot hold it.
            rows = rows.sortWithinPartitions(*partitions, "trace_id")
        (
            rows.write.partitionBy(*partitions)
            .options(**(BLOOM if "trace_id" in columns else {}))
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .parquet(self.path(table))
        )

    def exists(self, table: str) -> bool:
        return exists(self.spark, self.path(table))

    def versions(self, table: str) -> DataFrame:
        """Every stored row, with ``day``, ``writer`` and ``version``."""
        schema = SCHEMAS[table]
        extra = "writer string, version bigint"
        if table in TIME_COLUMN:
            extra = f"day date, {extra}"
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        if not self.exists(table):
            return self.spark.createDataFrame([], f"{ddl}, {extra}")
        return self.spark.read.schema(f"{ddl}, {extra}").parquet(self.path(table))

    def read(self, table: str, low: int | None = None, high: int | None = None, where: Column | None = None) -> DataFrame:
        """Newest rows; ``low``/``high`` (unix seconds, half open) prune days first.

        The range may only be given where the time column is part of the key or
        fixed by it, so that no newer version lies outside the range. ``where``
        chooses among the stored rows before the newest one is taken.
        """
        df = self.versions(table)
        column = F.col(TIME_COLUMN[table]) if table in TIME_COLUMN else None
        scale = NS if table == "spans" else 1
        day = lambda sec: F.timestamp_seconds(F.lit(sec)).cast("date")
        if low is not None:
            df = df.filter((F.col("day") >= day(low)) & (column >= low * scale))
        if high is not None:
            df = df.filter((F.col("day") <= day(high)) & (column < high * scale))
        if where is not None:
            df = df.filter(where)
        return self._newest(table, df).drop("day", "writer", "version")

    def _newest(self, table: str, df: DataFrame) -> DataFrame:
        if table not in KEYS:
            return df
        newest = ["writer", "version"] if table != "spans" else ["ingested_at_unix_nano", "writer", "version"]
        return latest_version(df, KEYS[table], newest)

    def compact(self, table: str, day: str) -> None:
        """One version in place of all of a day that gets no more rows.

        The newest rows go to the partition of the last writer and version, in one
        replacing write; then the others go. Rows that are there twice in between are
        equal, and a read takes one of each key.
        """
        if table not in KEYS:
            raise ValueError(f"{table} has no key to tell copies by")
        stored = self.versions(table).filter(F.col("day") == F.lit(day).cast("date"))
        last = stored.select("writer", "version").distinct().orderBy(F.desc("writer"), F.desc("version")).first()
        if last is None:
            return
        with scratch_scope(self.spark):
            rows = write_scratch(self._newest(table, stored), "compacted")
            self.write(table, rows, last.version, last.writer)
        kept = f"{self.path(table)}/day={day}/writer={last.writer}"
        for folder, stay in ((f"{self.path(table)}/day={day}", kept), (kept, f"{kept}/version={last.version}")):
            fs, at = file_system(self.spark, folder)
            for status in fs.listStatus(at):
                if status.getPath().getName() != stay.rsplit("/", 1)[1]:
                    fs.delete(status.getPath(), True)

    def merge_batches(self, table: str, writer: str, before: int, count: int) -> None:
        """One version in place of the last ``count`` versions of a writer below ``before``, day by day.

        Only that writer may call it, between two of its batches: no batch below
        ``before`` is written again. Newest rows stay, as in :meth:`compact`.
        """
        if table not in KEYS or "day" not in self.versions(table).columns:
            raise ValueError(f"{table} has no key and day to merge by")
        for day in self._names(self.path(table), "day="):
            folder = f"{self.path(table)}/day={day}/writer={writer}"
            mine = sorted(int(v) for v in self._names(folder, "version="))
            mine = [v for v in mine if before - count <= v < before]
            if len(mine) < 2:
                continue
            stored = self.versions(table).filter(
                (F.col("day") == F.lit(day).cast("date")) & (F.col("writer") == writer) & F.col("version").between(mine[0], mine[-1])
            )
            with scratch_scope(self.spark):
                self.write(table, write_scratch(self._newest(table, stored), "merged"), mine[-1], writer)
            for version in mine[:-1]:
                delete(self.spark, f"{folder}/version={version}")

    def _names(self, folder: str, prefix: str) -> list[str]:
        fs, at = file_system(self.spark, folder)
        if not fs.exists(at):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(at)]
        return sorted(name.removeprefix(prefix) for name in names if name.startswith(prefix))

    def keep_days(self, table: str, days: int) -> None:
        """:meth:`retain` counted back from the newest day that has rows."""
        stored = self._names(self.path(table), "day=")
        if stored:
            self.retain(table, str(date.fromisoformat(stored[-1]) - timedelta(days)))

    def expired_days(self, table: str, before: str) -> DataFrame:
        return self.versions(table).filter(F.col("day") < F.lit(before).cast("date")).select("day").distinct()

    def retain(self, table: str, first_day: str) -> None:
        """Drop whole day partitions before ``first_day``; no data is rewritten."""
        fs, base = file_system(self.spark, self.path(table))
        if not fs.exists(base):
            return
        for status in fs.listStatus(base):
            name = status.getPath().getName()
            if name.startswith("day=") and name[4:] < first_day:
                fs.delete(status.getPath(), True)


def span_sink(spans: DataFrame, path: str) -> None:
    """Bulk append, partitioned by start date."""
    with_day = spans.withColumn("start_date", _day("spans"))
    with_day.write.partitionBy("start_date").mode("append").parquet(path)


def retention(spans: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """The spans that are not older than ``days`` by start date."""
    return spans.filter(_day("spans") >= F.date_sub(today, days))
