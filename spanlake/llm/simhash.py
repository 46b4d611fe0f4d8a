"""SimHash near-duplicates through segment-popcount embedding.

A 64-bit fingerprint becomes the vector of the bit counts of its 32 two-bit
segments. The Manhattan distance of two vectors is a lower bound of the Hamming
distance of the fingerprints, so links (at most ``RADIUS`` = 2 differing bits) are
found among vectors at most 2 apart. The grid join for that: every fingerprint
visits the cell of its own vector and the cells one step away. Two vectors at most 2
apart share a cell (a vector half way), and two that share one are at most 2 apart.
That is up to 65 cells per fingerprint instead of the 2,000 that a one-sided search
would visit. Members of a cell are then compared exactly.

Cells with more than ``CELL`` fingerprints (clusters of near copies) are not
compared pairwise. Their members go to an exact second way: a fingerprint visits
itself and its 64 one-bit changes, and those that meet differ in at most 2 bits, so
a star to the smallest of them keeps the same links' components. Equal fingerprints
are one node throughout.

Defined results: null and wordless texts have the fingerprint 0 and link like any
other; repeated rows get the same class; a null doc_id counts for the class id only
where no member has one; an empty table gives no rows. ``representatives`` states
which row stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.arrays import LOWER, Words, column, flat, slices
from spanlake.llm.tables import components, mapped, split_by_keys, write_scratch

SHINGLE, SEED, CELL = 3, 42, 64
ODD_BITS = 0x5555555555555555
#: Each byte's bits, spread over the bytes of a word, lowest first.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints_of(values: pa.Array) -> np.ndarray:
    """Unsigned fingerprint of each text."""
    from xxhash import xxh64_intdigest

    raw, offsets = flat(values)
    words = Words(raw, offsets)
    out = np.zeros(words.rows, np.uint64)
    if len(words.start) == 0:
        return out
    length = words.end - words.start
    # All words, lower-cased, with one space after each.
    at = np.concatenate([[0], np.cumsum(length + 1)])
    data = np.full(int(at[-1]), 0x20, np.uint8)
    data[np.arange(len(data)) != np.repeat(at[1:] - 1, length + 1)] = LOWER[raw[words.inside]]
    text = data.tobytes()
    # Rows with fewer words than a shingle have one, the whole row.
    n = np.where(words.count >= SHINGLE, words.count - SHINGLE + 1, np.minimum(words.count, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(words.rows), n)
    first = words.first[:-1][row] + np.arange(bounds[-1]) - bounds[:-1][row]
    last = np.minimum(first + SHINGLE, words.first[1:][row]) - 1
    starts, ends = at[first].tolist(), (at[last] + length[last]).tolist()
    hashes = np.array([xxh64_intdigest(text[s:e], SEED) for s, e in zip(starts, ends, strict=True)], "<u8")
    real = np.flatnonzero(n)
    # Eight counters of a byte each in a word, so at most 255 hashes are summed at once.
    blocks = -(-n[real] // 255)
    first = np.concatenate([[0], np.cumsum(blocks)])
    block = bounds[:-1][real].repeat(blocks) + 255 * (np.arange(first[-1]) - first[:-1].repeat(blocks))
    counts = np.add.reduceat(SPREAD[hashes.view(np.uint8)].reshape(-1, 8), block, axis=0)
    ones = np.add.reduceat(counts.view(np.uint8).reshape(-1, 64), first[:-1], axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > n[real][:, None], axis=1, bitorder="little")
    out[real] = packed.view("<u8")[:, 0]
    return out


def _fingerprints(batches):
    for batch in slices(batches):
        found = fingerprints_of(column(batch, "text")).view(np.int64)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(found), column(batch, "row_hash")], names=["doc_id", "fp", "row_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, row_hash): the fingerprint's 64 bits as a signed long, and a hash of id and text."""
    return mapped(docs.select("doc_id", "text", row_hash().alias("row_hash")), _fingerprints, "doc_id long, fp long, row_hash long")


def row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cells(points: DataFrame) -> DataFrame:
    """(fp, cell): the cell of the fingerprint's segment counts and those one step away."""
    x = F.col("fp")
    pairs = F.shiftrightunsigned(x, 1)
    both = F.shiftleft(x.bitwiseAND(pairs).bitwiseAND(F.lit(ODD_BITS)), 1)
    counts = both.bitwiseOR(x.bitwiseXOR(pairs).bitwiseAND(F.lit(ODD_BITS)))
    # Per segment: 0 to 1 and back flips the low bit, 1 to 2 and back flips both; 3 is no count.
    steps = [0, *[_signed(m << 2 * i) for i in range(32) for m in (1, 3)]]
    near = points.select("fp", counts.alias("own"), F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step"))
    near = near.select("fp", F.col("own").bitwiseXOR(F.col("step")).alias("cell"))
    cell = F.col("cell")
    return near.where(cell.bitwiseAND(F.shiftrightunsigned(cell, 1)).bitwiseAND(F.lit(ODD_BITS)) == 0)


def links(points: DataFrame, cell_limit: int = CELL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links.

    Spark sizes what an explode makes by what goes in, a sixty-fifth of it, and would
    broadcast it: all joins here are hinted to shuffle.
    """
    visits = cells(points)
    shared = visits.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    members = write_scratch(visits.join(shared.hint("merge"), "cell"), "cells")
    small = members.where(F.col("n") <= cell_limit)
    a, b = small.select("cell", F.col("fp").alias("a")), small.select("cell", F.col("fp").alias("b"))
    pairs = a.join(b.hint("merge"), "cell").where("a < b AND bit_count(a ^ b) <= 2").select("a", "b").distinct()
    dense = members.where(F.col("n") > cell_limit).select("fp").distinct()
    flips = [0, *[_signed(1 << i) for i in range(64)]]
    meet = dense.select("fp", F.explode(F.array(*[F.lit(s).cast("long") for s in flips])).alias("flip"))
    meet = meet.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    least = meet.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = meet.join(least.hint("merge"), "z").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.union(stars)


def classes(docs: DataFrame, cell_limit: int = CELL) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows, named = _classified(docs, cell_limit)
    return rows.join(named.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classified(docs: DataFrame, cell_limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, row_hash) of every row, and (fp, component_id, root) of every fingerprint."""
    rows = write_scratch(fingerprints(docs), "fingerprints")
    points = write_scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points.select("fp"), cell_limit))
    rooted = points.join(roots.hint("merge"), points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = write_scratch(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, rooted.join(ids.hint("merge"), "root").select("fp", "component_id", "root")


def representatives(docs: DataFrame, cell_limit: int = CELL) -> DataFrame:
    """One row of each class with all its columns: that of the smallest id, null ids last.

    Rows are told apart by id and text: of different texts with one id, or without an id,
    the one with the smallest hash of both stands for the class, and of rows equal in
    both one stays. Texts move only for rows that go and the few that share their place
    in a bit map of those.
    """
    rows, named = _classified(docs, cell_limit)
    found = write_scratch(rows.join(named.hint("merge"), "fp").select("doc_id", "row_hash", "root"), "classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    kept = found.groupBy("root").agg(F.min_by("row_hash", order).alias("row_hash"), F.count("*").alias("members"))
    kept = write_scratch(kept.where("members > 1").drop("members"), "representatives")
    # All rows of classes with several, the kept ones marked; single rows need no decision.
    decided = found.join(kept.withColumnRenamed("row_hash", "kept_hash").hint("merge"), "root")
    decided = decided.groupBy("doc_id", "row_hash").agg(F.bool_or(F.col("row_hash") == F.col("kept_hash")).alias("kept"), F.count("*").alias("rows"))
    odd = write_scratch(decided.where("NOT kept OR rows > 1"), "decisions")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), row_hash().alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stay, asked = split_by_keys(rows, F.col("r.hash"), odd.select("row_hash"))
    asked = asked.join(odd.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("row_hash")), "left")
    single, several = asked.where("row_hash IS NULL"), asked.where("kept")
    # Rows equal in id and text: any one of them, whatever their other columns say.
    several = several.groupBy("id", "hash").agg(F.first("row").alias("row"))
    return stay.select("row").unionByName(single.select("row")).unionByName(several.select("row")).select("row.*")
