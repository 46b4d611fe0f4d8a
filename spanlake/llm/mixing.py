"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a word budget. As many complete epochs as fit are taken of all its
documents; what is left is filled in the order of exponential keys -ln(u) / weight
(u: uniform, a hash of the document id and the seed; weight: document quality), whose
prefix sums of words are cut at the rest. The document at the cut is taken if that
brings the source nearer to its budget.

A source may hold most rows, so no source is sorted in one task. Keys map
monotonically to ``BUCKETS`` buckets; sums per bucket find the one in which the cut
lies, the same again inside it, and only documents of that sub-bucket (one in
``BUCKETS`` squared) are sorted. The decision then needs one row per source.

Defined results: null text has size 0; a source without words takes none; null
sources are one source, last in order; rows with equal keys and ids are taken
together; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.arrays import WHITE, column, flat, slices, sums
from spanlake.llm.tables import is_small, mapped, write_scratch

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
BUCKETS, SEED = 4096, "mix-1"

_ODD = np.zeros(256, bool)
_ODD[list(b"#*$%&|<>!{}[]\\^~_=+@")] = True


def _measured(batches):
    """Words of each text, and its quality weight: the share of bytes that belong to prose, squared."""
    for batch in slices(batches):
        raw, offsets = flat(column(batch, "text"))
        inside = ~WHITE[raw]
        new = inside.copy()
        if len(raw):
            new[1:] &= ~inside[:-1]
            begins = offsets[:-1][offsets[:-1] < len(raw)]
            new[begins] = inside[begins]
        size = sums(new, offsets)
        odd = sums(_ODD[raw], offsets) / np.maximum(sums(inside, offsets), 1)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").cast(pa.int64()), column(batch, "source").cast(pa.string()), pa.array(size, pa.int64()), pa.array(0.05 + 0.95 * (1 - odd) ** 2)],
            names=["doc_id", "source", "size", "weight"],
        )


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, weight) of every document."""
    return mapped(docs.select("doc_id", "source", "text"), _measured, "doc_id long, source string, size long, weight double")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """In (0, 1), from 48 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): shares by weight, limited to ``repeats`` times each source's size.

    The limit binds where ``repeats * size / weight`` is small, so in that order the
    limited sources come first: prefix sums replace the rounds of resharing. One row per
    source enters; their order is by code point, nulls last.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = _ranked(per)
    n = len(weights)
    per = place.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % n + 1).cast("int")))
    per = per.withColumn("level", F.lit(repeats) * F.col("source_size") / F.col("w"))
    per = write_scratch(per, "sources")
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    # One row per distinct level, and a water line: below it sources are full.
    low, high = 0.0, float(per.agg(F.max("level")).first()[0] or 0.0)
    line = _water_line(per, total, low, high, repeats)
    return per.select(
        "source", "source_size", F.least(F.lit(float(repeats)) * F.col("source_size"), F.lit(line) * F.col("w")).alias("target")
    )


def _ranked(per: DataFrame) -> DataFrame:
    """Place of each source in the order of names, nulls last: a sort by range and counts per range."""
    ordered = per.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = write_scratch(ordered, "ordered")
    counts = ordered.groupBy("part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        ordered.join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part")  # one row per partition
        .withColumn("place", F.col("before") + F.row_number().over(inside) - 1)
        .drop("part", "before")
    )


def _water_line(per: DataFrame, total: float, low: float, high: float, repeats: int) -> float:
    """The level t with sum(min(repeats * size, t * w)) = total, or the highest level if all are full.

    Each round halves an interval of levels with one aggregate; between two
    neighbouring levels the sum is linear in t, which the last step solves.
    """
    def at(t: float):
        full = F.col("level") <= t
        return per.agg(
            F.coalesce(F.sum(F.when(full, repeats * F.col("source_size"))), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)),
            F.coalesce(F.count(F.when(F.col("level") > t, 1)), F.lit(0)),
            F.max(F.when(full, F.col("level"))),
            F.min(F.when(~full, F.col("level"))),
        ).first()

    if total <= 0 or high <= 0:
        return 0.0
    full, open_, n, _, _ = at(high)
    if full <= total:
        return high
    t = low
    while True:
        # Newton's step from below: the sum is concave in t, so it never oversteps.
        full, open_, n, _, nearest = at(t)
        step = (total - full) / open_ if open_ else high
        if step <= t or nearest is None:
            return max(t, step)
        if step < nearest:
            return step
        t = step


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: complete epochs, and the last (key, doc_id) of the fractional selection."""
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goals = write_scratch(goals, "goals")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    level1 = rows.groupBy("source", "b1").agg(F.sum("size").alias("words"))
    first = _crossing(level1, goals, "b1")
    inside = rows.join(_hint(first), same(rows, first) & (rows["b1"] == first["at"]), "left_semi")
    level2 = inside.groupBy("source", "b2").agg(F.sum("size").alias("words"))
    rest = first.select("source", F.col("left").alias("rest"))
    second = _crossing(level2, rest, "b2")
    both = first.select("source", F.col("at").alias("at1")).join(
        second.select(F.col("source").alias("s2"), F.col("at").alias("at2"), "left"), F.col("source").eqNullSafe(F.col("s2"))
    ).drop("s2")
    both = write_scratch(both, "crossings")
    few = rows.alias("r").join(_hint(both).alias("c"), F.expr("r.source <=> c.source AND r.b1 = c.at1 AND r.b2 = c.at2")).select("r.source", "key", "doc_id", "size", "left")
    few = few.groupBy("source", "key", "doc_id", "left").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first())
    few = few.withColumn("through", F.sum("size").over(upto)).withColumn("fits", F.col("left") - (F.col("through") - F.col("size")) >= F.col("size") / 2)
    last = few.where("fits").groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("last"))
    out = goals.join(both.select(F.col("source").alias("sb"), "at1", "at2"), F.col("source").eqNullSafe(F.col("sb")), "left").drop("sb")
    out = out.join(last.select(F.col("source").alias("sl"), "last"), F.col("source").eqNullSafe(F.col("sl")), "left").drop("sl")
    return write_scratch(out, "cuts")


def _crossing(sums_: DataFrame, goals: DataFrame, bucket: str) -> DataFrame:
    """The bucket of each source in which the prefix sum passes the rest, and what is left for it."""
    upto = Window.partitionBy("source").orderBy(bucket)  # at most BUCKETS rows
    run = sums_.withColumn("through", F.sum("words").over(upto))
    goal = goals.select(F.col("source").alias("g"), "rest")
    run = run.join(goal, F.col("source").eqNullSafe(F.col("g"))).where("through > rest AND rest >= 0")
    out = run.groupBy("source").agg(F.min_by(F.struct(F.col(bucket).alias("at"), (F.col("rest") - (F.col("through") - F.col("words"))).alias("left")), bucket).alias("m"))
    return write_scratch(out.select("source", "m.at", "m.left"), "crossing")


def _hint(df: DataFrame) -> DataFrame:
    """Broadcast if few rows; else a join by shuffle."""
    return F.broadcast(df) if is_small(df) else df


def keyed(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds the exponential key and its buckets. x grows with the key and lies in [0, 1)."""
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("weight"))
    x = (1 - F.exp(-F.col("key") / 2)) * BUCKETS
    rows = rows.withColumn("b1", F.least(F.floor(x), F.lit(BUCKETS - 1)).cast("int"))
    return rows.withColumn("b2", F.least(F.floor((x - F.col("b1")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def decided(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds source_size, target and copies (how often the mix takes a document)."""
    c = _hint(cut).select(F.col("source").alias("cut_source"), "source_size", "target", "epochs", "at1", "at2", "last")
    joined = rows.join(c, rows["source"].eqNullSafe(F.col("cut_source"))).drop("cut_source")
    # Without a crossing the rest takes nothing (it is 0) or the source has no words.
    before = F.struct("b1", "b2") < F.struct(F.col("at1").alias("b1"), F.col("at2").alias("b2"))
    inside = (F.col("b1") == F.col("at1")) & (F.col("b2") == F.col("at2"))
    upto = F.struct("key", "doc_id") <= F.col("last")
    more = F.coalesce(before | (inside & F.coalesce(upto, F.lit(False))), F.lit(False))
    return joined.withColumn("copies", F.col("epochs") + F.when(more & (F.col("target") > F.col("epochs") * F.col("source_size")), 1).otherwise(0)).drop(
        "epochs", "at1", "at2", "last"
    )


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    rows = write_scratch(keyed(measured(docs), seed), "measured")
    out = decided(rows, cuts(rows, targets(rows, **shares)))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def repeated(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The documents of the mix with all their columns, as often as it takes them.

    Every row is decided by itself, where it is read: its size, weight and key are worked
    out again and held against its source's cut. Texts do not move, and rows that share
    an id (and so a key) are taken alike.
    """
    rows = write_scratch(keyed(measured(docs), seed), "measured")
    cut = cuts(rows, targets(rows, **shares))
    # The columns as one struct, so that no name of theirs can clash with one used here.
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType(
        [T.StructField("row", plain.schema["row"].dataType), *[T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("source", T.StringType()), ("size", T.LongType()), ("weight", T.DoubleType()))]]
    )

    def run(batches):
        names = ["doc_id", "source", "text"]
        opened = (pa.RecordBatch.from_arrays([column(b, "row"), *[column(b, "row").field(n) for n in names]], names=["row", *names]) for b in batches)
        for batch in slices(opened):
            (found,) = _measured([batch])
            yield pa.RecordBatch.from_arrays([column(batch, "row"), *found.columns], names=["row", *found.schema.names])

    taken = decided(keyed(mapped(plain, run, schema), seed), cut).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
