"""Exact percentiles, medians and MADs of groups of any size.

Groups of up to ``RANKED`` rows are dealt to tasks, each row once, and ranked there. What
is larger goes another way, which no task has to hold: such a group
is first reduced to a log-linear histogram with a bounded number of buckets
(combined before the shuffle); the histogram says which buckets hold the wanted
ranks, and only the values of those buckets are counted and ranked. The rows
themselves are not shuffled by group, and the result is exact.

A wanted bucket that still holds more than ``RANKED`` rows is split further, round
after round (radix selection): its values fall into ``2**DIGITS`` cells of equal width,
whose counts name the cells with the wanted ranks. No task sees more than one
histogram, or ``RANKED`` rows, or copies of one value.

The input is read twice, so an expensive one should be a written table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.columns import floor_to, int_div, log_bucket
from spanlake.session import checkpoint, write_scratch

BITS = 5  # 32 buckets per octave: about 3 % wide
#: Rows of a bucket that one task may rank; bits of a value that a further round looks at.
RANKED, DIGITS = 1_000_000, 14
#: Hash cells by which groups are counted before their rows move.
CELLS = 8192


def _crowded(rows: DataFrame, group: Sequence[str]) -> DataFrame | None:
    """The groups of more than ``RANKED`` rows, at most one for so many rows; None without any.

    Counts by hash cells are summed up where the rows are; only cells that are too full
    are counted by group.
    """
    cell = F.pmod(F.xxhash64(*group), F.lit(CELLS)).alias("_cell")
    cells = rows.groupBy(cell).agg(F.count("*").alias("_rows"))
    full = [r._cell for r in cells.filter(F.col("_rows") > RANKED).collect()]
    if not full:
        return None
    within = rows.select(*group, cell).join(F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in full], "_cell bigint")), "_cell")
    found = checkpoint(within.groupBy(*group).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > RANKED).select(*group))
    return None if found.isEmpty() else found


def _by_size(rows: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups that one task may rank, rows of the others)."""
    crowded = _crowded(rows, group)
    if crowded is None:
        return rows, None
    crowded = F.broadcast(crowded)
    return rows.join(crowded, list(group), "left_anti"), rows.join(crowded, list(group), "left_semi")


def _rank_columns(total: Column, probs: Sequence[float]) -> list[Column]:
    ranks = []
    for p in probs:
        r = F.lit(float(p)) * (total - 1)
        ranks += [F.floor(r).cast("bigint"), F.ceil(r).cast("bigint")]
    return ranks


def _holds_any(ranks: list[Column], low: str, high: str) -> Column:
    hit = F.lit(False)
    for r in ranks:
        hit = hit | ((r >= F.col(low)) & (r < F.col(high)))
    return hit


def _cumulative(keys: Sequence[str], order: str) -> Window:
    return (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _ranked(rows: DataFrame, group: Sequence[str], ranks: list[Column], value: str, largest: int | None) -> DataFrame:
    """Distinct values ``_x`` of each group, at least those that hold ``ranks``, with the ranks [_lo, _hi) they take.

    A row stands for ``_n`` copies of its value; ``_lo`` is the number of the group's
    values below all the rows given. ``group`` determines ``_lo`` and ``ranks``;
    ``largest`` is the number of rows of its largest group.
    """
    group = list(group)
    if (largest or 0) > RANKED:
        rows = write_scratch(rows.withColumn("_cell", F.lit(0).cast("bigint")), "to-rank")
        low, high = rows.agg(F.min(value), F.max(value)).first()
        shift = (high - low).bit_length()
        while largest > RANKED and shift > 0:
            shift = max(0, shift - DIGITS)
            cells = rows.withColumns({"_up": F.col("_cell"), "_cell": F.shiftright(value, shift)})
            counts = (
                cells.groupBy(*group, "_up", "_cell")
                .agg(F.sum("_n").alias("_n"), F.count("*").alias("_rows"), F.min("_lo").alias("_lo"))
                .withColumn("_hi", F.col("_lo") + F.sum("_n").over(_cumulative([*group, "_up"], "_cell")))
                .withColumn("_lo", F.col("_hi") - F.col("_n"))
            )
            picked = checkpoint(counts.filter(_holds_any(ranks, "_lo", "_hi")).select(*group, "_cell", "_lo", "_rows"))
            largest = picked.agg(F.max("_rows")).first()[0]
            rows = write_scratch(cells.drop("_lo", "_up").join(picked.drop("_rows"), [*group, "_cell"]), "to-rank")
        group.append("_cell")
    return (
        rows.groupBy(*group, "_lo", F.col(value).alias("_x"))
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_hi", F.col("_lo") + F.sum("_n").over(_cumulative(group, "_x")))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )


def _picks(ranks: list[Column]) -> list[Column]:
    """The value at each rank, as ``_r0``, ``_r1``, ... of a group's ranked values."""
    return [F.max(F.when((r >= F.col("_lo")) & (r < F.col("_hi")), F.col("_x"))).alias(f"_r{i}") for i, r in enumerate(ranks)]


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    sums: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """keys, n, summed extras, and ``p0..`` with linear interpolation at p*(n-1).

    ``value`` is a BIGINT; ``weight`` names a column that says how many rows a
    row stands for (1 without it).
    """
    keys = list(keys)
    rows = df.select(
        *keys,
        F.col(value).alias("_v"),
        *([F.col(weight).cast("bigint").alias("_n")] if weight else []),
        *[F.col(x).alias(f"_s_{x}") for x in sums],
    )
    few, many = _by_size(rows, keys)
    n = F.col("_n") if weight else F.lit(1).cast("bigint")
    ranked = (
        few.withColumn("_hi", F.sum(n).over(_cumulative(keys, "_v")))
        .withColumn("_lo", F.col("_hi") - n)
        .withColumn("n", F.sum(n).over(Window.partitionBy(*keys)))
        .withColumnRenamed("_v", "_x")
    )
    ranks = _rank_columns(F.col("n"), probs)
    picked = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[F.sum(f"_s_{x}").alias(x) for x in sums], *_picks(ranks))
    if many is not None:
        picked = picked.unionByName(_picked_by_histogram(many.withColumn("_n", n), keys, ranks, sums))
    out = []
    for i, p in enumerate(probs):
        r = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        out.append((low + (high - low) * (r - F.floor(r))).alias(f"p{i}"))
    return picked.select(*keys, "n", *sums, *out)


def _picked_by_histogram(rows: DataFrame, keys: list[str], ranks: list[Column], sums: Sequence[str]) -> DataFrame:
    """keys, n, sums and the values at ``ranks`` of groups that are too large for one task."""
    rows = rows.withColumn("_b", log_bucket(F.col("_v"), BITS))
    whole = Window.partitionBy(*keys)
    hist = (
        rows.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_n"), F.count("*").alias("_rows"), *[F.sum(f"_s_{s}").alias(s) for s in sums])
        .withColumn("_hi", F.sum("_n").over(_cumulative(keys, "_b")))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .withColumn("n", F.sum("_n").over(whole))
        .withColumns({s: F.sum(s).over(whole) for s in sums})
    )
    wanted = checkpoint(hist.filter(_holds_any(ranks, "_lo", "_hi")).select(*keys, "_b", "_lo", "n", *sums, "_rows"))
    held = rows.select(*keys, "_b", "_v", "_n").join(wanted.drop("_rows"), [*keys, "_b"])
    largest = wanted.agg(F.max("_rows")).first()[0]
    ranked = _ranked(held, [*keys, "_b", "n", *sums], ranks, "_v", largest)
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(s).alias(s) for s in sums], *_picks(ranks))


def _expand_sources(df: DataFrame) -> DataFrame:
    return df.withColumn("as_of_index", F.explode(F.sequence("k_lo", "k_hi")))


def median_mad_over_ranges(
    df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str] = ()
) -> DataFrame:
    """Exact median and MAD of ``value`` for every (keys, as_of_index).

    A row of ``df`` counts towards every index in its [k_lo, k_hi]. Only
    histograms are copied along that range; rows follow only for the buckets
    around the median and the MAD. The result holds ``n``, the summed extras,
    and both statistics as integers: ``median2`` is twice the median, ``mad4``
    four times the MAD.
    """
    keys = list(keys)
    # The selective integers lead: sorts then rarely compare the other keys.
    source = ["k_lo", "k_hi", *keys]
    group = ["as_of_index", *keys]
    # Read three times: the histogram, and twice for the values of wanted buckets.
    rows = write_scratch(
        df.filter("k_lo <= k_hi").select(
            *source, F.col(value).alias("_v"), log_bucket(F.col(value), BITS).alias("_b"), *sums
        ),
        "coded",
    )
    parts = checkpoint(
        rows.groupBy(*source, "_b").agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.sum(s).alias(s) for s in sums],
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
        )
    )
    hist = checkpoint(
        _expand_sources(parts)
        .groupBy(*group, "_b")
        .agg(
            F.sum("_n").alias("_n"),
            *[F.sum(s).alias(s) for s in sums],
            F.min("_min").alias("_min"),
            F.max("_max").alias("_max"),
        )
    )

    def values_of(wanted: DataFrame) -> DataFrame:
        """The values in the wanted buckets of the groups.

        Sizes are estimated from the columns of files and know nothing of the copies, so
        a side of 10 MB by estimate can be a gigabyte at the driver: none is broadcast.
        """
        need = _expand_sources(parts.select(*source, "_b")).hint("merge").join(wanted, [*group, "_b"])
        return rows.select(*source, "_b", "_v").hint("merge").join(need, [*source, "_b"])

    whole = Window.partitionBy(*group)
    middle = [
        ((F.col("n") - 1) / 2).cast("bigint"),
        (F.col("n") / 2).cast("bigint"),
    ]
    wanted = (
        hist.withColumn("_hi", F.sum("_n").over(_cumulative(group, "_b")))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .withColumn("n", F.sum("_n").over(whole))
        .withColumns({s: F.sum(s).over(whole) for s in sums})
        .filter(_holds_any(middle, "_lo", "_hi"))
    )
    wanted = checkpoint(wanted.select(*group, "_b", "_lo", "n", *sums, "_n"))
    held = values_of(wanted.drop("_n")).withColumn("_n", F.lit(1).cast("bigint"))
    largest = wanted.agg(F.max("_n")).first()[0]
    ranked = _ranked(held, [*group, "_b", "n", *sums], middle, "_v", largest)
    medians = ranked.groupBy(*group).agg(F.max("n").alias("n"), *[F.max(s).alias(s) for s in sums], *_picks(middle))
    medians = checkpoint(
        medians.select(*group, "n", *sums, (F.col("_r0") + F.col("_r1")).alias("median2"))
    )

    # Bounds of |2v - median2| inside each bucket, then of the wanted ranks.
    at_min = F.abs(2 * F.col("_min") - F.col("median2"))
    at_max = F.abs(2 * F.col("_max") - F.col("median2"))
    inside = (2 * F.col("_min") <= F.col("median2")) & (F.col("median2") <= 2 * F.col("_max"))
    bounded = (
        hist.select(*group, "_b", "_n", "_min", "_max")
        .join(medians.select(*group, "n", "median2"), group)
        .withColumn("_dlo", F.when(inside, F.lit(0)).otherwise(F.least(at_min, at_max)))
        .withColumn("_dhi", F.greatest(at_min, at_max))
        .withColumn("_clo", F.sum("_n").over(_cumulative(group, "_dlo")))
        .withColumn("_chi", F.sum("_n").over(_cumulative(group, "_dhi")))
        .withColumn("_floor", F.min(F.when(F.col("_clo") > middle[0], F.col("_dlo"))).over(whole))
        .withColumn("_ceil", F.min(F.when(F.col("_chi") > middle[1], F.col("_dhi"))).over(whole))
        .withColumn(
            "_below",
            F.sum(F.when(F.col("_dhi") < F.col("_floor"), F.col("_n")).otherwise(0)).over(whole),
        )
        .filter((F.col("_dhi") >= F.col("_floor")) & (F.col("_dlo") <= F.col("_ceil")))
    )
    bounded = checkpoint(bounded.select(*group, "_b", "n", "median2", F.col("_below").alias("_lo"), "_n"))
    largest = bounded.groupBy(*group).agg(F.sum("_n").alias("_n")).agg(F.max("_n")).first()[0]
    held = values_of(bounded.drop("_n")).select(
        *group, "n", "_lo", F.abs(2 * F.col("_v") - F.col("median2")).alias("_d"), F.lit(1).cast("bigint").alias("_n")
    )
    mads = _ranked(held, [*group, "n"], middle, "_d", largest).groupBy(*group).agg(*_picks(middle))
    return medians.join(
        mads.select(*group, (F.col("_r0") + F.col("_r1")).alias("mad4")), group
    )


def rolling_median_mad(df: DataFrame, keys: Sequence[str], value: str, stretch: int, sums: Sequence[str] = ()) -> DataFrame:
    """As :func:`median_mad_over_ranges`, for ranges that are short against ``stretch``.

    Rows are dealt by keys and stretch of indexes, one that counts on both sides of a
    border to both; a stretch has its medians in its task, so the copies along the ranges
    never exist as rows. Stretches of more than ``RANKED`` rows are done by histograms.
    """
    keys, sums = list(keys), list(sums)
    wide = F.lit(stretch).cast("bigint")
    of = lambda k: int_div(floor_to(F.col(k), stretch), stretch)
    rows = df.filter(F.col("k_lo") <= F.col("k_hi")).filter(F.col(value).isNotNull()).select(
        *keys,
        F.explode(F.sequence(of("k_lo"), of("k_hi"))).alias("_s"),
        "k_lo",
        "k_hi",
        F.col(value).alias("_v"),
        *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in sums],
    )
    rows = rows.withColumns(
        {"k_lo": F.greatest("k_lo", F.col("_s") * wide), "k_hi": F.least("k_hi", F.col("_s") * wide + (stretch - 1))}
    )
    few, many = _by_size(rows, [*keys, "_s"])
    numbers = ["as_of_index", "n", *sums, "median2", "mad4"]
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in numbers])

    def rolled(table: pa.Table) -> pa.Table:
        found = _rolled(*(table[c].to_numpy() for c in ("k_lo", "k_hi", "_v", *sums)))
        same = [pa.repeat(table[k][0], found.shape[1]) for k in keys]
        return pa.Table.from_arrays([*same, *(pa.array(c) for c in found)], names=[*keys, *numbers])

    out = few.groupBy(*keys, "_s").applyInArrow(rolled, schema)
    if many is None:
        return out
    return out.unionByName(median_mad_over_ranges(many, keys, "_v", sums))


def _rolled(k_lo: np.ndarray, k_hi: np.ndarray, v: np.ndarray, *sums: np.ndarray) -> np.ndarray:
    """Lines of index, n, sums, twice the median and four times the MAD, a column per index with a value."""
    if max(int(v.max()), -int(v.min())) >= 1 << 60:
        raise OverflowError("four times a deviation is beyond a BIGINT")
    order = np.argsort(k_lo, kind="stable")
    k_lo, k_hi, v = k_lo[order], k_hi[order], v[order]
    sums = [s[order] for s in sums]
    reach = int((k_hi - k_lo).max())
    ks = np.arange(k_lo[0], k_hi.max() + 1)
    begin, end = np.searchsorted(k_lo, ks - reach), np.searchsorted(k_lo, ks, "right")
    out = []
    for k, a, z in zip(ks, begin, end, strict=True):
        mine = k_hi[a:z] >= k
        x = v[a:z][mine]
        n = len(x)
        if not n:
            continue
        middle = [(n - 1) // 2, n // 2]
        median2 = np.partition(x, middle)[middle].sum()
        mad4 = np.partition(np.abs(2 * x - median2), middle)[middle].sum()
        out.append((k, n, *(s[a:z][mine].sum() for s in sums), median2, mad4))
    return np.array(out, np.int64).T


def median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, ``median`` and unscaled ``mad`` of a BIGINT ``value``."""
    one = F.lit(0).cast("bigint")
    return median_mad_over_ranges(df.withColumns({"k_lo": one, "k_hi": one}), keys, value).select(
        *keys, "n", (F.col("median2") / 2).alias("median"), (F.col("mad4") / 4).alias("mad")
    )


def small_median(values: Column) -> Column:
    """Median of a short array column without nulls (bounded by a lookback's windows); empty is 0."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        low = F.element_at(s, (F.floor((n - 1) / 2) + 1).cast("int"))
        high = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
        return F.when(n == 0, F.lit(0.0)).otherwise((low + high) / 2)

    return _bound(F.sort_array(values), middle)


def small_mad(values: Column) -> Column:
    return _bound(small_median(values), lambda center: small_median(F.transform(values, lambda x: F.abs(x - center).cast("double"))))


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once, however often ``of`` names it: expressions are trees, copied per use."""
    return F.transform(F.array(value), of)[0]
