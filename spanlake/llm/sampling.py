"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations into vocabulary pieces form a lattice; a segmentation's
probability is proportional to the product of its pieces' weights. ``sample`` emits
the ``k`` segmentations with the largest Gumbel-perturbed log-probabilities, which is
sampling without replacement. They are found by A* search from the text's start:
backward sums over the lattice give every partial segmentation the exact log-mass of
its completions, and with it the perturbed maximum below it. Taking a path's next
piece keeps that maximum; the other pieces at the same place share one branch whose
maximum is a Gumbel truncated at the path's. The best open branch is the next sample.

Between two characters that no piece holds side by side every segmentation has a cut,
so the lattice falls apart into units there. Distinct units are solved once a slice,
all at the same time, and all rows of a slice take their k-th sample together.
Branches that cannot win whatever their random number are skipped.

The vocabulary file is a BPE model, whose scores are ranks; a piece's weight is taken
as 1 / (rank + ``FLAT``) (Zipf's law). Characters outside the vocabulary are their
UTF-8 bytes. Random numbers are hashes of row key, sample and place, so a row's
samples depend on nothing else. A sample's inclusion score is the probability that
its perturbed value exceeds that of the best segmentation not taken.

Defined results: null and empty texts have one sample without pieces; a text with
fewer than k segmentations has them all, with inclusion 1; a null row key counts as
0; repeated rows get the same samples; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanlake.llm.arrays import coded, code_points, column, flat, grouped, slices, spans
from spanlake.llm.tables import mapped

SAMPLES, SEED, FLAT = 2, 20_240_901, 10.0
TEXT_SLICE = 1 << 20
#: The largest value of -log(-log(u)) for a random number of 53 bits.
REACH = 37.0
#: Branches are opened along this many pieces at first, and further where they can still win.
WINDOW = 256
SCHEMA = "doc_id long, sample int, n_pieces int, ids binary, log_prob double, perturbed double, inclusion double, text_crc32 long"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces as bytes, a plain space standing for the model's space mark."""

    _loaded: dict[str, Vocabulary] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        self.byte = np.full(256, -1, np.int64)
        self.text: list[bytes] = [b""] * n
        normal, ranks = [], []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece.replace("▁", " ").encode()
                normal.append(i)
                ranks.append(-model.get_score(i))
        weight = 1 / (np.array(ranks) + FLAT)
        logs = np.log(weight / weight.sum())
        self.byte_log = float(logs.min()) - 1.0
        self.single = {self.text[i] for i in normal}
        self.pairs = np.zeros(1 << 16, bool)  # bytes that stand side by side in a piece
        for i in normal:
            b = np.frombuffer(self.text[i], np.uint8).astype(np.int64)
            self.pairs[b[:-1] << 8 | b[1:]] = True
        # Per length in bytes: sorted hashes with an end mark, ids, logs, places of hash heads.
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for length in sorted({len(self.text[i]) for i in normal}):
            at = [k for k, i in enumerate(normal) if len(self.text[i]) == length]
            block = np.frombuffer(b"".join(self.text[normal[k]] for k in at), np.uint8).reshape(-1, length)
            h = np.zeros(len(at), np.uint64)
            for c in range(length):
                h = _roll(h, block[:, c])
            h = _spread(h)
            order = np.argsort(h)
            # Where hashes with the same first 18 bits begin; the array's end where there are none.
            h = h[order]
            heads = np.full(1 << 18, len(h), np.int32)
            heads[(h >> np.uint64(46))[::-1]] = np.arange(len(h), dtype=np.int32)[::-1]
            self.by_length[length] = np.append(h, np.uint64(2**64 - 1)), np.array(normal)[at][order], logs[at][order], heads
        sizes = np.array([len(t) for t in self.text])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)


def _roll(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h * np.uint64(0x100000001B3) + byte.astype(np.uint64) + np.uint64(0x9E37)


def _spread(h: np.ndarray) -> np.ndarray:
    """One to one, with first bits that depend on all."""
    with np.errstate(over="ignore"):
        return h * np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """In (0, 1), a hash of the key and the numbers."""
    with np.errstate(over="ignore"):
        for i, p in enumerate(parts):
            key = _mix(key + np.asarray(p).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * i))
    return ((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _stable(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers under 2^32, by 16 bits at a time (which numpy sorts in linear time)."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and values.max() >> 16:
        order = order[np.argsort((values >> 16)[order].astype(np.uint16), kind="stable")]
    return order


class Lattice:
    """The edges of distinct units and, at each place, the chance of each edge.

    Places are byte positions in the units put one after another. A unit's end is the
    place where the next one begins; ``last`` tells them apart.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary):
        n = len(raw)
        end = np.repeat(bounds[1:], np.diff(bounds))  # of the unit at each byte
        begins = code_points(raw)
        left = end - np.arange(n)
        src, size, piece, log = [], [], [], []
        h = np.zeros(n, np.uint64)
        known = np.zeros(n, np.int64)  # bytes of the one-character piece at each place
        width = np.zeros(n, np.int64)
        at = np.flatnonzero(begins)
        width[at] = np.minimum(np.diff(np.append(at, n)), left[at])
        for length in range(1, max(vocabulary.by_length) + 1):
            live = n - length + 1
            if live <= 0:
                break
            h = _roll(h[:live], raw[length - 1 :])
            if length not in vocabulary.by_length:
                continue
            hashes, ids, logs, heads = vocabulary.by_length[length]
            g = _spread(h)
            place = heads[g >> np.uint64(46)]
            ok = np.flatnonzero((place < len(ids)) & begins[:live] & (left[:live] >= length))
            place, wanted = place[ok], g[ok]
            more = np.flatnonzero(hashes[place] < wanted)
            while len(more):  # a few share a head
                place[more] += 1
                more = more[hashes[place[more]] < wanted[more]]
            hit = (hashes[place] == wanted) & (place < len(ids))
            ok, place = ok[hit], place[hit]
            whole = begins[np.minimum(ok + length, n - 1)] | (ok + length >= n)
            ok, place = ok[whole], place[whole]
            known[ok[width[ok] == length]] = length
            src.append(ok)
            size.append(np.full(len(ok), length))
            piece.append(ids[place])
            log.append(logs[place])
        bare = np.flatnonzero(begins & (known == 0))
        src.append(bare)
        size.append(width[bare])
        piece.append(np.where(width[bare] == 1, vocabulary.byte[raw[bare]], -1))
        log.append(width[bare] * vocabulary.byte_log)
        # At each place the longest piece first, most often the likeliest: a draw rarely looks further.
        src, size, piece, log = (np.concatenate(x[::-1]) for x in (src, size, piece, log))
        order = _stable(src)
        self.src, self.size, self.piece, self.log = src[order], size[order].astype(np.int32), piece[order].astype(np.int32), log[order]
        self.dst = self.src + self.size
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.src, minlength=n))])
        self._chances(n, left)
        self.raw, self.end = raw, end

    def _chances(self, n: int, left: np.ndarray) -> None:
        """Backward sums, from the units' ends on; then each edge's chance at its place."""
        beta = np.zeros(n + 1)
        remaining = left[self.src]
        order = _stable(remaining)
        cut = np.searchsorted(remaining[order], np.arange(1, int(remaining.max(initial=0)) + 2))
        at_end = self.size == remaining
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi > lo:
                e = order[lo:hi]  # still sorted by place
                value = self.log[e] + np.where(at_end[e], 0.0, beta[self.dst[e]])
                new = np.flatnonzero(np.concatenate([[True], self.src[e][1:] != self.src[e][:-1]]))
                beta[self.src[e][new]] = np.logaddexp.reduceat(value, new)
        chance = np.exp(self.log + np.where(at_end, 0.0, beta[self.dst]) - beta[self.src])
        self.chance, self.at_end = chance, at_end
        run = np.concatenate([[0.0], np.cumsum(chance)])
        self.upto = run[1:] - run[self.first[self.src]]
        self.upto[self.first[1:][np.diff(self.first) > 0] - 1] = 2.0  # the last one takes what is left
        self.log_chance = np.log(np.maximum(chance, 1e-300))
        degree = np.diff(self.first)[self.src]
        self.first = self.first.astype(np.int32)
        rest = np.where(degree == 1, 0.0, np.maximum(1.0 - chance, 0.0))
        self.log_rest = np.log(rest, out=np.full(len(rest), -np.inf), where=rest > 0)

    def pick(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        e = self.first[place]
        more = np.flatnonzero(u >= self.upto[e])
        while len(more):
            e[more] += 1
            more = more[u[more] >= self.upto[e[more]]]
        return e

    def walk(self, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of edges, edges) of one random path from each place to its unit's end."""
        count = np.zeros(len(place), np.int64)
        steps = []
        live = np.arange(len(place))
        at = place
        step = 0
        while len(live):
            e = self.pick(at, _uniform(key[live], step))
            steps.append((live, e))
            count[live] += 1
            more = ~self.at_end[e]
            live, at = live[more], self.dst[e][more]
            step += 1
        first = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(int(first[-1]), np.int32)
        for k, (who, e) in enumerate(steps):
            out[first[who] + k] = e
        return count, out


def _units(raw: np.ndarray, offsets: np.ndarray, pairs: np.ndarray):
    """(bytes with a space before every non-empty row, offsets, starts of the units)."""
    real = np.diff(offsets) > 0
    moved = offsets + np.concatenate([[0], np.cumsum(real)])
    data = np.empty(len(raw) + int(real.sum()), np.uint8)
    lead = np.zeros(len(data), bool)
    lead[moved[:-1][real]] = True
    data[lead] = 0x20
    data[~lead] = raw
    start = lead | code_points(data)
    start[1:] &= lead[1:] | ~pairs[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
    return data, moved, np.flatnonzero(start)


def sampled(values: pa.Array, keys: np.ndarray, vocabulary: Vocabulary, k: int, seed: int):
    """Per sample of the slice: (rows that have it, offsets, ids, log_prob, perturbed, inclusion), and the rows' bytes."""
    raw, offsets = flat(values)
    data, bounds, start = _units(raw, offsets, vocabulary.pairs)
    rows = len(bounds) - 1
    stop = np.append(start[1:], len(data))
    unit, names = coded(spans(data, start, stop))
    lattice = Lattice(*flat(names), vocabulary)
    unit_at = flat(names)[1][:-1]
    row = np.searchsorted(bounds[1:], start, "right")
    first_unit = np.searchsorted(row, np.arange(rows + 1))
    nth = np.arange(len(unit)) - first_unit[:-1][row]
    key = _mix(keys.astype(np.uint64) ^ np.uint64(seed))
    best = -np.log(-np.log(_uniform(key, 0, 1)))  # the perturbed value of the likeliest draw, mass 1
    heaps: list[list] = [[] for _ in range(rows)]
    samples = []

    count, edges = lattice.walk(unit_at[unit], _mix(key[row] + _part(1, nth)))
    at = np.concatenate([[0], np.cumsum(count)])[np.append(first_unit[:-1], len(unit))] if rows else np.zeros(1, int)
    have = np.arange(rows)
    paths = [(at, edges, best)]
    samples.append(have)
    _branches(lattice, heaps, have, at, edges, np.zeros(rows, np.int64), np.zeros(rows), best, key, 1, k)
    for j in range(2, k + 1):
        got = [(r, *_pop(heaps[r])) for r in range(rows) if heaps[r]]
        if not got:
            break
        have = np.array([g[0] for g in got])
        value = np.array([g[1] for g in got])
        at, edges, depth, prefix = _next(lattice, paths, samples, got, have, key, j, unit_at, unit, first_unit, nth, heaps)
        paths.append((at, edges, value))
        samples.append(have)
        _branches(lattice, heaps, have, at, edges, depth, prefix, value, key, j, k)
    beaten = np.array([max((b[0] for b in h), default=-np.inf) for h in heaps])
    out = []
    for have, (at, edges, value) in zip(samples, paths, strict=True):
        log_prob = grouped(lattice.log_chance[edges][:, None], at)[:, 0]  # sums that do not depend on other rows
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(np.minimum(log_prob - beaten[have], 700)))
        out.append((have, *_ids(lattice, vocabulary, at, edges), log_prob, value, inclusion))
    return out, data, bounds


def _part(sample: int, nth) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.asarray(nth).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(sample * 0x632BE59BD9B4E019 & (2**64 - 1))


def _branches(lattice, heaps, have, at, edges, depth, prefix, value, key, j, k) -> None:
    """Opens the branches of new paths from ``depth`` on, where ``prefix`` is the path's log-probability.

    Each row keeps the k best of a path. Along a path branches weigh less and less: once
    the path's log-probability is ``REACH`` below the k-th best, none can be better.
    """
    rows, lo, log = np.arange(len(have)), at[:-1] + depth, prefix
    while len(rows):
        hi = np.minimum(lo + WINDOW, at[1:][rows])
        n = hi - lo
        first = np.concatenate([[0], np.cumsum(n)])
        which = np.repeat(np.arange(len(rows)), n)
        place = np.arange(first[-1]) - first[:-1][which] + lo[which]
        step = lattice.log_chance[edges[place]]
        run = np.concatenate([[0.0], np.cumsum(step)])
        before = run[:-1] - run[first[:-1]][which] + log[which]
        phi = before + lattice.log_rest[edges[place]]
        ok = np.flatnonzero(np.isfinite(phi))
        phi, p, place = phi[ok], rows[which[ok]], place[ok]
        e = -np.log(_uniform(key[have[p]], 2, j, place - at[p]))
        g = phi - np.log(np.exp(np.minimum(phi - value[p], 700)) + e)
        order = np.lexsort((-g, p))
        place, p, g = place[order], p[order], g[order]
        top = np.arange(len(p)) - np.searchsorted(p, p) < k
        for i, b, x in zip(p[top].tolist(), place[top].tolist(), g[top].tolist(), strict=True):
            heaps[have[i]].append((x, j, b - int(at[i]), (int(edges[b]),)))
        log = log + run[first[1:]] - run[first[:-1]]
        more = np.flatnonzero(hi < at[1:][rows])
        kth = [sorted((b[0] for b in heaps[have[rows[i]]]), reverse=True)[:k] for i in more.tolist()]
        more = more[[len(x) < k or log[i] > x[-1] - REACH for i, x in zip(more.tolist(), kth, strict=True)]] if len(more) else more
        rows, lo, log = rows[more], hi[more], log[more]


def _pop(heap: list) -> tuple:
    top = max(heap)
    heap.remove(top)
    return top


def _next(lattice, paths, samples, got, have, key, j, unit_at, unit, first_unit, nth, heaps):
    """The paths of the popped branches: the old one up to the branch, another edge there, a new walk behind."""
    start, ends, chosen, prefix = [], [], [], []
    for r, g, from_, depth, taken in got:
        at, edges, _ = paths[from_ - 1]
        i = int(np.searchsorted(samples[from_ - 1], r))
        lo = int(at[i])
        branch = int(edges[lo + depth])
        src = int(lattice.src[branch])
        others = np.array([x for x in range(lattice.first[src], lattice.first[src + 1]) if x not in taken])
        share = lattice.chance[others]
        run = np.cumsum(share)
        u = _uniform(key[r : r + 1], 3, j)[0] * run[-1]
        e = int(others[min(int(np.searchsorted(run, u, "right")), len(others) - 1)])
        left = float(run[-1] - lattice.chance[e])
        before = float(lattice.log_chance[edges[lo : lo + depth]].sum())
        prefix.append(before + float(lattice.log_chance[e]))
        if len(others) > 1 and left > 0:
            phi = before + np.log(left)
            x = phi - np.log(np.exp(min(phi - g, 700)) - np.log(_uniform(key[r : r + 1], 4, j)[0]))
            heaps[r].append((float(x), from_, depth, (*taken, e)))
        start.append((lo, depth, edges))
        ends.append(int(lattice.at_end[edges[lo : lo + depth]].sum()))  # whole units before the branch
        chosen.append(e)
    chosen, done = np.array(chosen), np.array(ends)
    # What is walked anew: the rest of the branch's unit, and every unit behind it.
    partial = ~lattice.at_end[chosen]
    behind = first_unit[have] + done + 1
    n = first_unit[have + 1] - behind
    width = n + partial
    base = np.concatenate([[0], np.cumsum(width)])
    who = np.repeat(np.arange(len(have)), width)
    k = np.arange(base[-1]) - base[:-1][who]
    inner = (k == 0) & partial[who]
    u = np.minimum(behind[who] + k - partial[who], max(len(unit) - 1, 0))
    place = np.where(inner, lattice.dst[chosen][who], unit_at[unit[u]])
    number = np.where(inner, nth[np.minimum(behind[who] - 1, len(nth) - 1)], nth[u])
    count, walked = lattice.walk(place, _mix(key[have[who]] + _part(j, number)))
    ends_at = np.concatenate([[0], np.cumsum(count)])[base]
    head = np.array([s[1] for s in start])
    at = np.concatenate([[0], np.cumsum(head + 1 + np.diff(ends_at))])
    out = np.empty(int(at[-1]), np.int32)
    for i, (lo, depth, edges) in enumerate(start):
        out[at[i] : at[i] + depth] = edges[lo : lo + depth]
        out[at[i] + depth] = chosen[i]
        out[at[i] + depth + 1 : at[i + 1]] = walked[ends_at[i] : ends_at[i + 1]]
    return at, out, head + 1, np.array(prefix)


def _ids(lattice, vocabulary, at, edges) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, 16-bit ids); an edge outside the vocabulary becomes the ids of its bytes."""
    piece = lattice.piece[edges]
    bare = piece < 0
    if not bare.any():
        return at, piece.astype("<u2")
    n = np.where(bare, lattice.size[edges], 1)
    first = np.concatenate([[0], np.cumsum(n)])
    which = np.repeat(np.arange(len(edges)), n)
    byte = lattice.raw[np.minimum(lattice.src[edges][which] + np.arange(first[-1]) - first[:-1][which], len(lattice.raw) - 1)]
    return first[at], np.where(bare[which], vocabulary.byte[byte], piece[which]).astype("<u2")


def sample(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, path: str | None = None) -> DataFrame:
    """k rows per document: its distinct segmentations in falling order of perturbed log-probability."""
    path = path or model_path()

    def run(batches):
        vocabulary = Vocabulary.load(path)
        for batch in slices(batches, limit=TEXT_SLICE):
            ids = column(batch, "doc_id").cast(pa.int64())
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
            found, data, bounds = sampled(column(batch, "text"), keys, vocabulary, k, seed)
            view = memoryview(np.ascontiguousarray(data))
            crc = np.array([zlib.crc32(view[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.int64)
            for j, (have, at, pieces, log_prob, value, inclusion) in enumerate(found):
                packed = pa.Array.from_buffers(
                    pa.binary(), len(have), [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pieces))]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(have)), pa.array(np.full(len(have), j + 1, np.int32)), pa.array(np.diff(at).astype(np.int32)), packed,
                        pa.array(log_prob), pa.array(value), pa.array(inclusion), pa.array(crc[have]),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)


def decoded(ids: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, each with the space the encoder put before it."""
    raw, offsets = flat(ids)
    pieces = raw.view("<u2").astype(np.int64) if len(raw) else np.zeros(0, np.int64)
    size = np.diff(vocabulary.starts)[pieces]
    first = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(vocabulary.starts[:-1][pieces] - first[:-1], size) + np.arange(first[-1])
    return vocabulary.bytes[source], first[offsets // 2]


def decode(rows: DataFrame, path: str | None = None, text: bool = True) -> DataFrame:
    """Adds the text of each row's ids and the checksum over it with its leading space.

    Without ``text`` only the checksum, in place of the ids: to compare with ``text_crc32``.
    """
    from pyspark.sql.types import LongType, StringType

    path = path or model_path()
    gone = {"text", "decoded_crc32"} if text else {"text", "decoded_crc32", "ids"}
    names = [c for c in rows.columns if c not in gone]
    schema = rows.select(*names).schema.add("decoded_crc32", LongType())
    if text:
        schema = schema.add("text", StringType())

    def run(batches):
        vocabulary = Vocabulary.load(path)
        for batch in slices(batches, "ids", TEXT_SLICE):
            data, at = decoded(column(batch, "ids"), vocabulary)
            view = memoryview(data)
            bounds = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            columns = {n: column(batch, n) for n in names}
            columns["decoded_crc32"] = pa.array([zlib.crc32(view[a:b]) for a, b in bounds], pa.int64())
            if text:
                columns["text"] = pa.array([bytes(view[a + 1 : b]).decode(errors="replace") for a, b in bounds], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return mapped(rows, run, schema)
