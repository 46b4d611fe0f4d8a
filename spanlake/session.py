"""Session settings, reliable checkpoints and scratch tables."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Partition counts and memory stay with
# the cluster: AQE coalesces or splits whatever they are set to.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort a join whose every shuffled partition proved small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Tables bucketed by trace join on (trace, span) without a shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Recursive queries end by themselves: every service of a window is met once.
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.cteRecursionLevelLimit": "-1",
    # Attributes sent twice: the last one stands, as in a map assignment.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "spanlake", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.extraJavaOptions", "-Dlog4j2.level=ERROR")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``;
    only where that is unset (tests, local runs) a temporary one is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the plan, survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCOPES = threading.local()  # a scope belongs to the thread that opened it


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for open_scope in getattr(_SCOPES, "open", [])[-1:]:
        open_scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the scratch tables written inside it."""
    _SCOPES.open = [*getattr(_SCOPES, "open", []), []]
    try:
        yield
    finally:
        *_SCOPES.open, paths = _SCOPES.open
        for path in paths:
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Drop what finished plans left at the driver, and with it their shuffles, broadcasts and checkpoints.

    Spark removes those when the driver has collected its garbage, which by itself it does when
    its heap is full: a driver that runs plan after plan grows to its bound however little it holds.
    Plans that are still referenced stay.
    """
    gc.collect()
    spark._jvm.System.gc()


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back (columnar, prunable)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The state of a loop of joins as a written table; a round's takes the place of the one before.

    A checkpoint keeps the estimated size of its plan, which for a join is the product of
    its sides'. From round to round the number's own length multiplies, until it alone
    fills the driver. The size of a written table is that of its files; they say little of
    its rows, so joins of states are hinted to shuffle.
    """

    def __init__(self, name: str):
        self.name = name
        self.path: str | None = None

    def keep(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        before, self.path = self.path, scratch_path(spark, self.name)
        df.write.parquet(self.path)
        if before is not None:
            delete(spark, before)
        return spark.read.schema(df.schema).parquet(self.path)
