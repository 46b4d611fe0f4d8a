"""Periodic runs of words: a suffix automaton whose tree of suffix links is recoloured by link-cut access.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal) of at least ``max(LEAST, POWER * q)`` words that no neighbouring word extends.

Every text is scanned in two steps, both within one row:
1. In such a run every window of ``WINDOW`` words occurs again q words before or
   after. Windows are hashed for a whole slice of rows at once; what stays are the
   stretches of consecutive windows with another occurrence no further away than a
   ``POWER``-th of the stretch. A run lies in one stretch; most texts have none.
2. The stretch's words are appended one by one. The path from the state of the
   prefix that ends at word i to the root holds all suffixes of that prefix. Access
   makes it one path coloured i and meets, as segments of equal colour, the suffixes
   that ended last at the same word p. The longest suffix of a segment, of length m,
   occurs again i - p words back: where that is no more than m, the last m + i - p
   words have the period i - p, which is their smallest and cannot be extended to the
   left. It is a run of its own if the next word does not have the period, either.
   Tree paths are splay trees, so a stretch of n words takes O(n log n).

Defined results: null, empty and wordless texts have no runs; repeated rows get the
same rows; a null doc_id leaves the text as it is in ``with_tails``; an empty table
gives no rows. Memory grows with the longest stretch of one text.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.arrays import Words, column, flat, slices
from spanlake.llm.tables import mapped

LEAST, POWER, WINDOW = 24, 3, 8
RUN = "struct<start: bigint, length: bigint, period: bigint>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_BASE = 0x9E3779B97F4A7C15


def automaton(seq: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link of each state, length of its longest string, state of each prefix) of the suffix automaton."""
    step: list[dict[int, int]] = [{}]
    link, size, prefix = [-1], [0], []
    last = 0
    for c in seq:
        new = len(size)
        size.append(size[last] + 1)
        step.append({})
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(size)
                size.append(size[p] + 1)
                step.append(step[q].copy())
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        prefix.append(new)
    return link, size, prefix


class Paths:
    """The tree of suffix links as paths of one colour each, every path a splay tree ordered by depth."""

    def __init__(self, link: list[int]):
        n = len(link)
        self.up = link.copy()  # parent in the splay tree; of its root, the node above the path
        self.less, self.more = [-1] * n, [-1] * n
        self.colour = [-1] * n  # of the path, at the root of its splay tree

    def _rotate(self, x: int) -> None:
        up, less, more = self.up, self.less, self.more
        y = up[x]
        z = up[y]
        if z >= 0 and less[z] == y:
            less[z] = x
        elif z >= 0 and more[z] == y:
            more[z] = x
        else:
            self.colour[x] = self.colour[y]
        if less[y] == x:
            b = less[y] = more[x]
            more[x] = y
        else:
            b = more[y] = less[x]
            less[x] = y
        if b >= 0:
            up[b] = y
        up[y] = x
        up[x] = z

    def splay(self, x: int) -> None:
        up, less, more = self.up, self.less, self.more
        while (y := up[x]) >= 0 and (less[y] == x or more[y] == x):
            z = up[y]
            if z >= 0 and (less[z] == y or more[z] == y):
                self._rotate(y if (less[z] == y) == (less[y] == x) else x)
            self._rotate(x)

    def access(self, x: int, colour: int):
        """Recolours the path from x to the root; yields (deepest node, former colour) of each segment it is made of."""
        up, more, colours = self.up, self.more, self.colour
        below = -1
        while x >= 0:
            self.splay(x)
            was = colours[x]
            if was >= 0:
                yield x, was
            if more[x] >= 0:
                colours[more[x]] = was
            more[x] = below
            below = x
            x = up[x]
        colours[below] = colour


def runs_of(seq: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and period. ``power`` is 2 or more."""
    link, size, prefix = automaton(seq)
    paths, n, out = Paths(link), len(seq), []
    for i, state in enumerate(prefix):
        for node, last in paths.access(state, i):
            period, common = i - last, size[node]
            length = period + common
            if length >= least and length >= power * period and (i + 1 == n or seq[i + 1] != seq[i + 1 - period]):
                out.append((i + 1 - length, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def stretches(codes: np.ndarray, row: np.ndarray, least: int = LEAST, power: int = POWER, window: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of words, each in one row, that hold all runs. Every run must have ``2 * period + window`` words or more."""
    n = len(codes) - window + 1
    if n <= 0:
        return []
    h, k = _mixed(codes), 1
    while k < window:
        h = h[:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + h[k:]
        k *= 2
    at = np.flatnonzero(row[:n] == row[window - 1 :])
    key = h[at] ^ _mixed(row[at])
    order = np.argsort(key, kind="stable")
    same = (key[order][1:] == key[order][:-1]) & (row[at[order]][1:] == row[at[order]][:-1])
    gap = np.where(same, np.diff(at[order]), len(codes))
    near = np.full(n, len(codes), np.int64)
    near[at[order[1:]]] = gap
    near[at[order[:-1]]] = np.minimum(near[at[order[:-1]]], gap)
    hit = np.flatnonzero(near < len(codes))
    while len(hit):
        first = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (row[hit][1:] != row[hit][:-1])]))
        n_words = np.diff(np.append(first, len(hit))) + window - 1
        whole = np.repeat(n_words, n_words - window + 1)
        keep = (whole >= least) & (near[hit] * power <= whole)
        if keep.all():
            return [(int(hit[f]), int(hit[f] + w)) for f, w in zip(first, n_words, strict=True)]
        hit = hit[keep]
    return []


def _found(batches):
    for batch in slices(batches):
        words = Words(*flat(column(batch, "text")))
        codes, names = words.coded()
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(words.rows)]
        drop = np.zeros(len(codes) + 1, np.int32)
        for lo, hi in stretches(codes, words.row):
            row, seq = words.row[lo], codes[lo:hi].tolist()
            for start, length, period in runs_of(seq):
                runs[row].append((lo + start - int(words.first[row]), length, period))
                drop[lo + start + period] += 1
                drop[lo + start + length] -= 1
        kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
        texts = names.take(pa.array(codes[kept]))
        bounds = pa.array(np.searchsorted(kept, words.first), pa.int64())
        joined = pc.binary_join(pa.LargeListArray.from_arrays(bounds, texts), pa.scalar(b" ", pa.large_binary()))
        best = [min(r, key=_least) if r else None for r in runs]
        counts = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        flat_runs = _structs([x for r in runs for x in r])
        yield pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id").cast(pa.int64()), pa.array(words.count, pa.int64()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat_runs),
                pa.array([b and dict(zip(("start", "length", "period"), b, strict=True)) for b in best], _RUN), joined.cast(pa.binary()).view(pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "best", "collapsed"],
        )


def _structs(runs: list[tuple[int, int, int]]) -> pa.Array:
    table = np.array(runs, np.int64).reshape(-1, 3)
    return pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], ["start", "length", "period"])


class _least:
    """Orders runs by exponent, largest first, then by start and period, without rounding."""

    def __init__(self, run: tuple[int, int, int]):
        self.run = run

    def __lt__(self, other: _least) -> bool:
        (s, n, q), (t, m, p) = self.run, other.run
        return (m * q, s, q) < (n * p, t, p)


def _tails(batches):
    """Texts with the contract's tails; the other texts as they are."""
    for batch in slices(batches):
        ids, values = column(batch, "doc_id").cast(pa.int64()), column(batch, "text")
        raw, offsets = flat(values)
        words = Words(raw, offsets)
        texts = {}
        for row in np.flatnonzero(words.count > 0).tolist():
            doc = ids[row].as_py()
            h = crc32(str(doc).encode()) if doc is not None else 1
            if h % 10:
                continue
            lo, n, g = int(words.first[row]), int(words.count[row]), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            take = np.arange(n)
            take[a:] = a + (take[a:] - a) % p
            mine = [raw[s:e].tobytes() for s, e in zip(words.start[lo : lo + n].tolist(), words.end[lo : lo + n].tolist(), strict=True)]
            texts[row] = b" ".join([mine[k] for k in take.tolist()]).decode(errors="replace")
        if texts:
            values = pa.array([texts.get(k, v) for k, v in enumerate(values.to_pylist())], values.type)
        yield pa.RecordBatch.from_arrays([ids, values], names=["doc_id", "text"])


def find(docs: DataFrame, tails: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start and period), best, collapsed.

    ``best`` is the run with the largest length / period. ``collapsed`` has the words
    that no run repeats: those outside all runs and the first period of each, joined by
    one space. With ``tails``, every tenth text gets a periodic end first (the numbered
    query's test of long periods).
    """
    run = (lambda batches: _found(_tails(batches))) if tails else _found
    return mapped(docs.select("doc_id", "text"), run, FOUND)


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of the numbered query."""
    best: Column = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
