"""Spans derived from the orders and lineitem tables.

An order is a trace: the order is its root span, a line is a child span. The
derivation is a projection (no join, no window function), so it scales with
the files, and it works on streams as well. Missing line numbers give orphans,
repeated (order, line) pairs give redelivered spans, and a few fixed rules give
cycles, second roots, clock skew, late arrivals and incidents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.columns import int_div
from spanlake.session import file_system

# Fixed values of the derivation (restated in plans/oracle.py).
BASE_SECONDS = 1_704_151_800  # 2024-01-01 23:30 UTC: the spans cross a midnight
GAP_US = 400_000
HORIZON_US = 2_592_000_000_000
RUN_SECONDS = 2_400
SKEW_US = 40_000
LATE_SECONDS = 120
#: Rows of a file of arrivals.
FILE_ROWS = 500_000


def trace_start_us(key: Column) -> Column:
    return F.lit(BASE_SECONDS * 1_000_000) + F.pmod(key * GAP_US, F.lit(HORIZON_US))


def _scattered(number: Column, width: int) -> Column:
    """A unique hex id whose leading digits vary, like random ids do."""
    return F.rpad(F.reverse(F.lower(F.hex(number))), width, "0")


def span_id(key: Column, line: Column) -> Column:
    return _scattered(key * 16 + line + 1, 16)


def trace_id(key: Column) -> Column:
    return _scattered(key + 1, 32)


def minute_index(us: Column) -> Column:
    return int_div(us - BASE_SECONDS * 1_000_000, 60_000_000)


def _finish(df: DataFrame) -> DataFrame:
    return df.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "service_name",
        F.concat(F.lit("handle "), "service_name").alias("span_name"),
        (F.col("start_us") * 1000).alias("start_time_unix_nano"),
        ((F.col("start_us") + F.col("dur_us")) * 1000).alias("end_time_unix_nano"),
        F.col("status").cast("int").alias("status_code"),
        "attributes",
        ((F.col("start_us") + F.col("dur_us") + F.col("delay_us")) * 1000).alias("ingested_at_unix_nano"),
        "key",
    )


def root_spans(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    minute = minute_index(F.col("start_us"))
    slow = F.pmod(minute, F.lit(23)).isin(14, 15)
    base = orders.select("o_orderkey", "o_custkey", "o_orderpriority").withColumn("start_us", trace_start_us(key))
    return _finish(
        base.select(
            key.alias("key"),
            trace_id(key).alias("trace_id"),
            span_id(key, F.lit(0)).alias("span_id"),
            F.lit("").alias("parent_span_id"),
            F.lit("frontend").alias("service_name"),
            "start_us",
            ((350_000 + F.pmod("o_custkey", F.lit(1500)) * 100) * F.when(slow, 3).otherwise(1)).alias("dur_us"),
            F.when(key % 50 == 0, 2).otherwise(1).alias("status"),
            F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("attributes"),
            F.lit(2_000_000).alias("delay_us"),
        )
    )


def line_spans(lineitem: DataFrame) -> DataFrame:
    key = F.col("l_orderkey")
    line = F.col("l_linenumber").cast("bigint")
    parent_line = int_div(line - 1, 2)
    by_line = ["checkout", "catalog", None, "inventory", "shipping", "search", "notifications"]
    service = F.when(line == 3, F.when(F.col("l_suppkey") % 2 == 0, "payments").otherwise("inventory"))
    for number, name in enumerate(by_line, start=1):
        if name:
            service = service.when(line == number, name)
    parent = (
        F.when((key % 101 == 3) & (line == 5), span_id(key, line))
        .when((key % 97 == 5) & (line == 1), span_id(key, F.lit(3)))
        .when((key % 89 == 7) & (line == 2), "")
        .otherwise(span_id(key, parent_line))
    )
    skew = F.when(F.col("service_name") == "inventory", -SKEW_US).otherwise(0)
    start = trace_start_us(key) + line * 15_000 + F.col("l_partkey") % 997 + skew
    minute = minute_index(F.col("start_us"))
    slow = F.pmod(minute, F.lit(23)).isin(14, 15)
    level_us = F.when(line <= 2, 120_000).when(line <= 6, 40_000).otherwise(0)
    factor = F.when(slow & (line == 5), 8).when(slow & (line == 2), 4).otherwise(1)
    duration = (level_us + F.col("l_quantity").cast("bigint") * 1000 + F.col("l_suppkey") % 89 * 10) * factor
    failing = (F.pmod(minute, F.lit(19)) == 15) & (line == 6) & (F.col("l_suppkey") % 2 == 0)
    delay = F.when((key % 29 == 0) & (line == 3), LATE_SECONDS * 1_000_000).otherwise(
        2_000_000 + F.col("l_partkey") % 1009 * 1000
    )
    base = (
        lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
        .withColumn("service_name", service)
        .withColumn("start_us", start)
    )
    return _finish(
        base.select(
            key.alias("key"),
            trace_id(key).alias("trace_id"),
            span_id(key, line).alias("span_id"),
            parent.alias("parent_span_id"),
            "service_name",
            "start_us",
            duration.alias("dur_us"),
            F.when(failing | (F.col("l_partkey") % 40 == 0), 2).otherwise(1).alias("status"),
            F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("attributes"),
            delay.alias("delay_us"),
        )
    )


def _lost_root(df: DataFrame) -> DataFrame:
    return df.filter(F.col("key") % 13 != 4)


def _silent(df: DataFrame) -> DataFrame:
    minute = minute_index(int_div(F.col("start_time_unix_nano"), 1000))
    return df.filter(~((F.col("service_name") == "payments") & (F.pmod(minute, F.lit(17)) == 12)))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def sent_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span as sent (ground truth side), redeliveries included."""
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    return root_spans(orders).unionByName(line_spans(lineitem))


def raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span as received: some roots and one silent service are missing."""
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    return _lost_root(root_spans(orders)).unionByName(_silent(line_spans(lineitem))).drop("key")


def arrivals(spark: SparkSession, sf_dir: str, path: str, pieces: int, file_rows: int = FILE_ROWS) -> int:
    """The received spans as files under ``path`` that follow one another by arrival; the number of files a piece.

    The spans are dealt by ranges of arrival, a range to a task and a file of some
    ``file_rows`` rows. Streams take files by their time of modification, which is set
    to the order of the ranges: any number of files in turn is all that arrived first.
    """
    spans = raw_spans(spark, sf_dir)
    each = spans.count() // (pieces * file_rows) + 1
    spans.repartitionByRange(pieces * each, "ingested_at_unix_nano").write.parquet(path)
    fs, at = file_system(spark, path)
    files = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    newest = max(fs.getFileStatus(f).getModificationTime() for f in files)
    for i, file in enumerate(reversed(files)):
        fs.setTimes(file, newest - 1000 * i, -1)
        if fs.getFileStatus(file).getModificationTime() > newest - 1000 * i:
            raise RuntimeError(f"{path}: its file system keeps no times of modification, which order a stream's files")
    return each


def span_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stored arrivals as a stream; ``options`` may limit a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(path)
