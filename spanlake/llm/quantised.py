"""Near-duplicate embeddings by product quantisation.

Vectors link at a cosine of ``NEAR`` or more, within their label and dimension. Equal
vectors of a label are one node with its number of rows.

* Coarse lists: directions of unit length from spherical k-means on a sample. A vector
  belongs to the list of its nearest direction.
* Probes: a vector visits its own list and every list of a smaller number that a
  linked vector could belong to: the plane between two lists passes through the
  origin, and a vector nearer to it than the sine of the linking angle may have links
  beyond it. So no link is lost, whatever the sample was; a pair meets in one list.
  There are as many lists as keep the sample's mean of probes under ``PROBES``.
* Codes: the residual of a vector from its list's direction is coded by subspaces of
  ``WIDTH`` components with ``CODEWORDS`` codewords each. A visitor has a table of its
  residual's squared distances to all codewords; adding up table entries gives its
  distance to a coded vector. The length of what the code leaves out is stored with
  it, and by the triangle inequality what is further away than both lengths allow has
  no link. What remains is compared by exact cosine in double precision.

A list of a label is compared in blocks of ``BLOCK`` vectors against blocks of as many
visitors, each pair of blocks a group of its own, so no task holds a large list. A
group returns link counts and a star per component of its links, not the pairs.

The sample that lists and codewords are learned from is ``SAMPLE`` vectors in the
mean, chosen by hash; every vector is indexed.

Defined results: vectors that are null, empty, zero or hold nulls, NaN or infinities,
and all vectors of a null label have no links and are their own component; repeated
rows are copies that link; a null vec_id counts for a component's id only where no
member has one, and is kept where that is so; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.arrays import column
from spanlake.llm.tables import components, mapped, write_scratch

NEAR, SAMPLE, PROBES, LISTS = 0.98, 20_000, 8.0, 1024
WIDTH, CODEWORDS, BLOCK = 4, 16, 1024
#: Rounding that the bounds leave room for; exact comparison decides.
SLACK = 1e-6

NODES = "vec_id long, node string, label string, vector binary"
PLACED = "node string, label string, list int, copies long, vector binary, codes binary, rest double, home boolean"


def _units(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of float64 little-endian bytes as a matrix, filled with zeros at the right; their norms)."""
    rows = [np.frombuffer(b, "<f8") for b in data.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, np.linalg.norm(out, axis=1)


def _nodes(batches):
    """The node of each row: a digest of label and vector, none where nothing can link."""
    for batch in batches:
        vectors, labels = column(batch, "embedding"), column(batch, "label").to_pylist()
        nodes, kinds, values = [], [], []
        for vector, label in zip(vectors.to_pylist(), labels, strict=True):
            node = kind = value = None
            if vector and label is not None and None not in vector:
                x = np.array(vector, np.float64) + 0.0  # no negative zeros
                if np.isfinite(x).all() and x.any():
                    value, kind = x.astype("<f8").tobytes(), f"{len(x)}:{label}"
                    node = hashlib.blake2b(kind.encode() + b"\0" + value, digest_size=16).hexdigest()
            nodes.append(node)
            kinds.append(kind)
            values.append(value)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "vec_id").cast(pa.int64()), pa.array(nodes, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.binary())],
            names=["vec_id", "node", "label", "vector"],
        )


def nodes(rows: DataFrame) -> DataFrame:
    """(vec_id, node, label, vector) of each row; ``label`` also names the dimension."""
    return mapped(rows.select("vec_id", "embedding", F.col("label").cast("string").alias("label")), _nodes, NODES)


class Index:
    """Directions of the lists and codewords of the subspaces."""

    def __init__(self, directions: np.ndarray, books: np.ndarray, near: float):
        self.directions, self.books, self.near = directions, books, near
        self.far = np.sqrt(2 - 2 * near)  # distance of unit vectors at the linking angle
        between = directions[:, None, :] - directions[None, :, :]
        # Across the plane between two lists: how far at most a linked vector's partner is from it.
        self.margin = np.linalg.norm(between, axis=2) * np.sqrt(1 - near * near) + SLACK

    def probed(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list of each vector, matrix of the lists it visits besides)."""
        cosine = units @ self.directions.T
        home = cosine.argmax(axis=1)
        best = cosine[np.arange(len(units)), home]
        visits = best[:, None] - cosine <= self.margin[home]
        visits &= np.arange(len(self.directions))[None, :] < home[:, None]
        return home, visits

    def split(self, residual: np.ndarray) -> np.ndarray:
        n, d = residual.shape
        parts = self.books.shape[0]
        full = np.zeros((n, parts * WIDTH))
        full[:, :d] = residual
        return full.reshape(n, parts, WIDTH)

    def coded(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what they leave out)."""
        parts = self.split(residual)
        codes = self.tables(residual).argmin(axis=2).astype(np.uint8)
        left = parts - self.books[np.arange(self.books.shape[0])[None, :], codes]
        return codes, np.sqrt((left * left).sum(axis=(1, 2)))

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distance of each vector's subspaces to all codewords."""
        parts = self.split(residual)
        cross = np.einsum("nmw,mkw->nmk", parts, self.books)
        return (parts * parts).sum(axis=2)[:, :, None] - 2 * cross + (self.books * self.books).sum(axis=2)[None]


def _seeds(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k points, each drawn with a weight of its squared distance to those before."""
    chosen = [points[rng.integers(len(points))]]
    gap = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and gap.sum() > 1e-12:
        chosen.append(points[rng.choice(len(points), p=gap / gap.sum())])
        gap = np.minimum(gap, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _means(points: np.ndarray, k: int, unit: bool, rounds: int = 12) -> np.ndarray:
    centres = _seeds(points, k, np.random.default_rng(k))
    for _ in range(rounds):
        score = points @ centres.T - (0 if unit else (centres * centres).sum(axis=1) / 2)
        mine = score.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, points)
        n = np.bincount(mine, minlength=len(centres))
        size = np.linalg.norm(sums, axis=1) if unit else n
        real = (n > 0) & (size > 1e-9)
        centres[real] = sums[real] / size[real, None]
    return centres


def fit(sample: np.ndarray, n_vectors: int, near: float = NEAR, probes: float = PROBES) -> Index:
    """Lists and codewords from a sample of unit vectors.

    The number of lists doubles while a list would still have 256 vectors, the sample
    32 for each, and a vector few enough probes.
    """
    d = sample.shape[1]
    lists, directions = 1, _means(sample, 1, True)
    empty = np.zeros((-(-d // WIDTH), 1, WIDTH))
    while 2 * lists <= min(LISTS, n_vectors / 256, len(sample) / 32):
        more = _means(sample, 2 * lists, True)
        if Index(more, empty, near).probed(sample)[1].sum(axis=1).mean() > probes:
            break
        lists, directions = 2 * lists, more
    index = Index(directions, empty, near)
    home, _ = index.probed(sample)
    parts = index.split(sample - directions[home])
    books = [_means(parts[:, m], min(CODEWORDS, len(sample)), False) for m in range(parts.shape[1])]
    full = np.stack([np.concatenate([b, np.repeat(b[:1], CODEWORDS - len(b), axis=0)]) for b in books])
    return Index(directions, full, near)


def _placed(index: Index):
    """A row of each vector in its list, and a visitor's row for each list it probes."""
    dim = index.directions.shape[1]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                vectors, norm = _units(column(part, "vector"))
                units = np.zeros((len(vectors), dim))
                units[:, : vectors.shape[1]] = vectors / norm[:, None]
                home, visits = index.probed(units)
                codes, rest = index.coded(units - index.directions[home])
                who, where = np.nonzero(visits)
                take = pa.array(np.concatenate([np.arange(len(home)), who]))
                lists = np.concatenate([home, where])
                own = np.arange(len(lists)) < len(home)
                coded = pa.array([c.tobytes() for c in codes] + [None] * len(who), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "node").take(take), column(part, "label").take(take), pa.array(lists.astype(np.int32)), column(part, "copies").take(take),
                        column(part, "vector").take(take), coded, pa.array(np.concatenate([rest, np.zeros(len(who))])), pa.array(own),
                    ],
                    names=["node", "label", "list", "copies", "vector", "codes", "rest", "home"],
                )

    return run


def linked(index: Index, which: int, seekers: tuple, stored: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked vectors: seekers are (vectors, norms), stored also have codes and rests."""
    dim = index.directions.shape[1]
    units = np.zeros((len(seekers[0]), dim))
    units[:, : seekers[0].shape[1]] = seekers[0] / seekers[1][:, None]
    tables = index.tables(units - index.directions[which])
    codes, rest = stored[2], stored[3]
    reach = (index.far + rest + SLACK) ** 2
    found = []
    step = max(1, (4 << 20) // max(1, len(rest)))
    for lo in range(0, len(units), step):
        table = tables[lo : lo + step]
        distance = np.zeros((len(table), len(rest)))
        for m in range(codes.shape[1]):
            distance += table[:, m][:, codes[:, m]]
        i, j = np.nonzero(distance <= reach)
        found.append((i + lo, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    sure = []
    for lo in range(0, len(i), 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        dot = np.einsum("nd,nd->n", seekers[0][a], stored[0][b])
        sure.append(dot / (seekers[1][a] * stored[1][b]) >= index.near)
    real = np.concatenate(sure) if sure else np.zeros(0, bool)
    return i[real], j[real]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the links (i, j)."""
    out = np.arange(n)
    while True:
        least = out.copy()
        np.minimum.at(least, i, out[j])
        np.minimum.at(least, j, out[i])
        least = least[least]
        if (least == out).all():
            return out
        out = least


def _compared(index: Index):
    """Links of one pair of blocks: counts per node and edges of a star per component."""
    schema = pa.schema([("node", pa.string()), ("links", pa.int64()), ("root", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks()
        side = batch.column("stored").to_numpy(zero_copy_only=False).astype(bool)
        stored, seekers = batch.filter(pa.array(side)), batch.filter(pa.array(~side))
        if not stored.num_rows or not seekers.num_rows:
            return schema.empty_table()
        column = lambda t, c: t.column(c).combine_chunks()
        a, b = _units(column(seekers, "vector")), _units(column(stored, "vector"))
        codes = np.frombuffer(b"".join(column(stored, "codes").to_pylist()), np.uint8).reshape(stored.num_rows, -1)
        rest = column(stored, "rest").to_numpy()
        i, j = linked(index, int(batch.column("list")[0].as_py()), a, (*b, codes, rest))
        home = column(seekers, "home").to_numpy(zero_copy_only=False).astype(bool)
        names = np.array(column(seekers, "node").to_pylist() + column(stored, "node").to_pylist(), object)
        copies = np.concatenate([column(seekers, "copies").to_numpy(), column(stored, "copies").to_numpy()])
        n = seekers.num_rows
        other = names[i] != names[n + j]
        i, j = i[other], j[other]
        # In its own list each of two vectors seeks the other; elsewhere one seeks for both.
        counts = np.zeros(len(names), np.int64)
        np.add.at(counts, i, copies[n + j])
        far = ~home[i]
        np.add.at(counts, n + j[far], copies[i[far]])
        least = roots(len(names), i, n + j)
        hit = np.flatnonzero((counts > 0) | (least != np.arange(len(names))) | np.isin(np.arange(len(names)), n + j))
        return pa.Table.from_arrays([pa.array(names[hit], pa.string()), pa.array(counts[hit]), pa.array(names[least[hit]], pa.string())], schema=schema)

    return run


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """Every stored vector with every block of its list's visitors and the other way round."""
    sides = placed.where("home").withColumn("stored", F.lit(True)).unionByName(placed.withColumn("stored", F.lit(False)).withColumn("codes", F.lit(None).cast("binary")))
    n = placed.groupBy("label", "list").agg(F.count(F.when(F.col("home"), 1)).alias("n_stored"), F.count("*").alias("n_seekers")).where("n_stored > 0")
    n = n.select("label", "list", *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("n_stored", "n_seekers")])
    n = write_scratch(n, "list-sizes")
    dealt = sides.join(n, ["label", "list"])
    own, others = (F.when(F.col("stored"), F.col(a)).otherwise(F.col(b)) for a, b in (("n_stored", "n_seekers"), ("n_seekers", "n_stored")))
    mine = F.pmod(F.xxhash64("node", "stored"), own).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    first, second = F.when(F.col("stored"), F.col("mine")).otherwise(F.col("other")), F.when(F.col("stored"), F.col("other")).otherwise(F.col("mine"))
    return dealt.withColumns({"stored_block": first, "seeker_block": second}).drop("mine", "other", "n_stored", "n_seekers")


def classes(rows: DataFrame, near: float = NEAR, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links (other rows that link with it), component_id, kept."""
    known = write_scratch(nodes(rows), "vectors")
    points = known.where("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    points = write_scratch(points, "points")
    index, n = _fitted(points, near, sample)
    if n == 0:
        return known.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    placed = write_scratch(mapped(points.drop("least"), _placed(index), PLACED), "placed")
    groups = _blocks(placed, block).groupBy("label", "list", "stored_block", "seeker_block")
    found = write_scratch(groups.applyInArrow(_compared(index), "node string, links long, root string"), "links")
    root = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = points.select("node", "copies", "least").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = write_scratch(named.join(sums, "node", "left"), "rooted")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    named = write_scratch(named, "named")
    return known.join(named, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("vec_id").eqNullSafe(F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))).alias("kept"),
    )


def _fitted(points: DataFrame, near: float, sample: int) -> tuple[Index | None, int]:
    """The index, learned on the driver from ``sample`` vectors in the mean, and the number of points."""
    n, dim = points.agg(F.count("*"), F.max(F.octet_length("vector"))).first()
    if n == 0:
        return None, 0
    share = min(1.0, sample / n)
    chosen = points.where(F.conv(F.substring("node", 1, 8), 16, 10).cast("double") < share * (1 << 32)).select("vector")
    rows = sorted(bytes(r[0]) for r in chosen.toLocalIterator()) or [bytes(points.select("vector").first()[0])]
    vectors = np.zeros((len(rows), dim // 8))
    for i, r in enumerate(rows):
        vectors[i, : len(r) // 8] = struct.unpack(f"<{len(r) // 8}d", r)
    return fit(vectors / np.linalg.norm(vectors, axis=1)[:, None], n, near), n
