"""Reading the given tables, size-checked broadcasts, components of a graph."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.session import RUNTIME_CONF, checkpoint, configure, write_scratch

#: Rows that a broadcast side may have, for rows of up to about 100 bytes.
BROADCAST_ROWS = 200_000
#: 64-bit words of a bit map of keys: 8 MB of bits.
SLOTS = 1 << 20

__all__ = ["BROADCAST_ROWS", "RUNTIME_CONF", "checkpoint", "components", "configure", "documents", "is_small", "mapped", "split_by_keys", "table", "write_scratch"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this library on the path of the Python workers.

    Where executors do not see the folder it lies in, ship it with ``--py-files``.
    """
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return df.mapInArrow(run, schema)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most that many rows; looks at no more than are needed to tell."""
    return df.limit(rows + 1).count() <= rows


def split_by_keys(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is certainly none of ``keys``, the others), without moving a row.

    ``keys`` has one column of 64-bit hashes. They become a bit map of ``SLOTS`` words at
    most, which is what is broadcast, however many keys there are; the more, the more
    other rows are taken along with those that have a key.
    """
    (name,) = keys.columns
    slot = lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(SLOTS - 1).cast("long"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = keys.select(slot(F.col(name)).alias("bitmap_slot"), bit(F.col(name)).alias("bitmap_bit"))
    words = write_scratch(words.groupBy("bitmap_slot").agg(F.bit_or("bitmap_bit").alias("bitmap_word")), "bitmap")
    found = rows.alias("r").join(F.broadcast(words).alias("w"), slot(key) == F.col("w.bitmap_slot"), "left")
    hit = F.coalesce(F.col("w.bitmap_word"), F.lit(0)).bitwiseAND(bit(key)) != 0
    own = [F.col(f"r.`{c}`") for c in rows.columns]
    return found.where(~hit).select(*own), found.where(hit).select(*own)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Alternates large-star and small-star steps: each ties every neighbour of a node
    to the smallest one, in a group-by and an equi-join, until no edge changes. A
    node with very many neighbours is one skewed key of a join, which AQE splits.
    Loops (a = b) are dropped; a node without another neighbour has no row.
    """
    pairs = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _summary(pairs)
    while state[0]:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).where("a != b")
        pairs = checkpoint(small.distinct())
        now = _summary(pairs)
        if now == state:
            break
        state = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _summary(pairs: DataFrame) -> tuple:
    """Equal for equal sets of edges; two hashes make other matches practically impossible."""
    h = F.xxhash64("a", "b")
    return tuple(
        pairs.agg(
            F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))
        ).first()
    )
