"""Token ids as binary files, compressed by a Re-Pair grammar per shard.

Documents are range-partitioned and sorted by id, encoded, and cut into shards of
about ``SHARD`` ids. In a shard, frequent pairs of neighbouring symbols are replaced
by new symbols, round after round, until no pair occurs ``LEAST`` times in the shard.
A round takes all such pairs at once: of overlapping occurrences the more frequent
pair wins. No pair reaches over a document's end, so each document is a run
of symbols of its own, and its place and the expansion lengths of the rules are
stored: one document, or one range of its ids, is decoded without the rest.

A shard is one binary value (little-endian): magic ``RPR2``; numbers of distinct ids,
rules, documents and symbols, bytes a symbol (u32 each); the distinct ids, which symbols
count from 0; expansion lengths (u32); first
symbol of each document and one past the last (u32); ids per document (u32); rules as
pairs of symbols; symbols (u16, or u32 where the numbers need it). Shards are rows of a Parquet table with their document ids and order.

Defined results: null and empty texts have the end id only; repeated ids stay
in the order of their texts; null ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.arrays import Words, column, flat, slices
from spanlake.llm.tables import is_small, mapped, write_scratch

END_ID, SHARD, LEAST = 2, 1 << 20, 8
MAGIC = b"RPR2"
#: Buckets of pairs that are counted before pairs themselves are; a prime.
CELLS = 4_194_301
#: Words whose ids a Python worker remembers: twice as many at most, those not met for that long go.
REMEMBERED = 700_000
#: Bytes of text that are encoded at once.
TEXT_SLICE = 6 << 20
SCHEMA = "part int, nth int, doc_ids array<long>, n_tokens long, shard binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts by way of their distinct words.

    The tokenizer drops white space and never joins what it divides, so a text's ids
    are those of its words. ASCII capitals are lowered first, which it would do itself.
    A text with an opening of special tokens is encoded as it stands.
    """

    _loaded: dict[str, Encoder] = {}
    _MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
    # The model reads a byte as a character: itself where it is printable, else one from 256 on.
    _PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    _READ = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.known: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}

    def _ids(self, word: bytes) -> bytes:
        """The ids of a word as u32, as bytes."""
        found = self.known.get(word) or self.earlier.get(word) or self._new(word)
        if len(self.known) >= REMEMBERED:
            self.known, self.earlier = {}, self.known
        self.known[word] = found
        return found

    def _new(self, word: bytes) -> bytes:
        if word.isalpha():
            # Letters alone are one unit to the model: nothing to normalise or divide.
            return self._unit(word.decode())
        head = word.rstrip(self._MARKS)
        if head and len(head) < len(word) and (head[-1:].isalnum() or head[-2:-1] == b"\xc3" and head[-1] not in (0x97, 0xB7)):
            # A unit ends with the letter or digit; the marks behind it are the next one.
            found = self.known.get(head) or self.earlier.get(head) or self._new(head)
            return found + self._ids(word[len(head) :])
        text = word.decode(errors="replace")
        if text.isalpha() and max(text) <= "ÿ":  # letters of Latin-1 have one form, only to be lowered
            return self._unit(text.lower().encode().decode("latin-1").translate(self._READ))
        return _u32(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _unit(self, text: str) -> bytes:
        return _u32([t.id for t in self.tokenizer.model.tokenize(text)])

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets), without end ids."""
        raw, offsets = flat(values)
        words = Words(raw, offsets)
        codes, names = words.coded(lower=True)
        each = [self.known.get(w) or self._ids(w) for w in names.to_pylist()]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        start = np.concatenate([[0], np.cumsum(size)])
        store = np.frombuffer(b"".join(each), "<u4").astype(np.int64)
        n = size[codes] if len(codes) else size
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = store[np.repeat(start[:-1][codes] - upto[:-1], n) + np.arange(upto[-1])] if len(codes) else store
        at = upto[words.first]
        special = [r for r in _rows_with(raw, offsets, b"<|")]
        if not special:
            return ids, at
        parts = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for r in special:
            text = raw[offsets[r] : offsets[r + 1]].tobytes().decode(errors="replace")
            parts[r] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _u32(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _rows_with(raw: np.ndarray, offsets: np.ndarray, two: bytes) -> np.ndarray:
    at = np.flatnonzero((raw[:-1] == two[0]) & (raw[1:] == two[1])) if len(raw) > 1 else np.zeros(0, int)
    return np.unique(np.searchsorted(offsets, at, "right") - 1)


def compress(ids: np.ndarray, docs: np.ndarray, size: int, least: int = LEAST):
    """(rules, expansion lengths, symbols, document offsets) of ids < size; ``docs`` are offsets.

    ``least`` is 2 or more. Every round replaces the most frequent pair at least, so they end.
    """
    a = ids.astype(np.int32)
    last = np.zeros(len(a), bool)  # of its document
    last[docs[1:][np.diff(docs) > 0] - 1] = True
    rules = np.zeros((0, 2), np.int64)
    lengths = np.zeros(0, np.int64)
    lost = np.zeros(0, bool)  # begins a frequent pair that was not taken
    newest = size
    while len(a) > 1:
        base = size + len(rules)
        if len(rules):
            # Counts of pairs only fall, but for those with a new symbol.
            at = np.flatnonzero(((a[:-1] >= newest) | (a[1:] >= newest) | lost[:-1]) & ~last[:-1])
        else:
            # Every frequent pair is in a heavy bucket; with few ids a pair has one of its own.
            bucket = (a[:-1].astype(np.int64) * size + a[1:]) % CELLS
            bucket[last[:-1]] = CELLS
            heavy = np.bincount(bucket, minlength=CELLS + 1) >= least
            heavy[CELLS] = False
            at = np.flatnonzero(heavy[bucket])
        if not len(at):
            break
        key = a[at].astype(np.int64) << 32 | a[at + 1]
        order = np.argsort(key)
        ordered = key[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        n = np.diff(np.append(first, len(ordered)))
        best = np.argsort(-n, kind="stable")
        best = best[n[best] >= least]
        if not len(best):
            break
        rank = np.full(len(first), -1, np.int32)
        rank[best] = np.arange(len(best))
        mine = np.empty(len(at), np.int32)
        mine[order] = np.repeat(rank, n)
        at, mine = at[mine >= 0], mine[mine >= 0]
        full = np.full(len(a) + 2, len(best), np.int32)
        full[at + 1] = mine
        # An occurrence is taken if neither overlapping one is more frequent; of a row of equals every second.
        fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1])])
        place = np.arange(len(at))
        even = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        take = even & (full[at] >= mine) & (full[at + 2] >= mine)
        lost = np.zeros(len(a), bool)
        lost[at[~take]] = True
        at, mine = at[take], mine[take]
        used = np.flatnonzero(np.bincount(mine, minlength=len(best)))
        rank[used] = np.arange(len(used))  # of the pairs that were taken, in the same order
        mine = rank[mine]
        pairs = ordered[first[best[used]]]
        pairs = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)
        known = np.concatenate([np.ones(size, np.int64), lengths])
        lengths = np.concatenate([lengths, known[pairs].sum(axis=1)])
        rules = np.concatenate([rules, pairs])
        a[at] = base + mine
        last[at] = last[at + 1]
        stay = np.ones(len(a), bool)
        stay[at + 1] = False
        a, last, lost = a[stay], last[stay], lost[stay]
        newest = base
    ends = np.flatnonzero(last) + 1
    starts = np.zeros(len(docs), np.int64)
    starts[1:][np.diff(docs) > 0] = ends
    return rules, lengths, a, np.maximum.accumulate(starts)


def packed(ids: np.ndarray, docs: np.ndarray, size: int) -> bytes:
    """The stored shard. Symbols count from 0 over the ids that occur, so two bytes mostly hold them."""
    names = np.flatnonzero(np.bincount(ids, minlength=size))
    dense = np.zeros(size, np.int64)
    dense[names] = np.arange(len(names))
    rules, lengths, symbols, starts = compress(dense[ids], docs, len(names))
    width = 2 if len(names) + len(rules) <= 1 << 16 else 4
    head = struct.pack("<4s5I", MAGIC, len(names), len(rules), len(docs) - 1, len(symbols), width)
    numbers = [x.astype("<u4").tobytes() for x in (names, lengths, starts, np.diff(docs))]
    return head + b"".join(numbers) + b"".join(x.astype(f"<u{width}").tobytes() for x in (rules, symbols))


class Shard:
    """A stored shard; ``document`` and ``ids`` decode one document, or a range of its ids."""

    def __init__(self, data: bytes):
        magic, n_names, n_rules, n_docs, n_symbols, width = struct.unpack_from("<4s5I", data)
        if magic != MAGIC:
            raise ValueError("no shard")
        n = n_names + n_rules + 2 * n_docs + 1
        numbers = np.frombuffer(data, "<u4", n, 24).astype(np.int64)
        names, lengths, starts, n_tokens = np.split(numbers, np.cumsum([n_names, n_rules, n_docs + 1]))
        symbols = np.frombuffer(data, f"<u{width}", offset=24 + 4 * n).astype(np.int64)
        self.set(names, symbols[: 2 * n_rules].reshape(-1, 2), lengths, symbols[2 * n_rules :], starts, n_tokens)

    def set(self, names, rules, lengths, symbols, starts, n_tokens) -> None:
        self.symbols, self.starts, self.n_tokens = symbols, starts, n_tokens
        size = len(names)
        inner = rules.reshape(-1)
        while len(at := np.flatnonzero(inner >= size)):
            n = np.ones(len(inner), np.int64)
            n[at] = 2
            place = np.cumsum(n) - n
            out = np.repeat(inner, n)
            pair = rules[inner[at] - size]
            out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
            inner = out
        #: What every symbol stands for, one after the other: the ids, then the expanded rules.
        self.text = names[np.concatenate([np.arange(size), inner])]
        self.lengths = np.concatenate([np.ones(size, np.int64), lengths])
        self.begins = np.cumsum(self.lengths) - self.lengths

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        upto = np.cumsum(n)
        return self.text[np.repeat(self.begins[symbols] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]

    def all(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[k] : self.starts[k + 1]])

    def ids(self, k: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of document k; only the symbols over them are expanded."""
        mine = self.symbols[self.starts[k] : self.starts[k + 1]]
        n = self.lengths[mine]
        upto = np.cumsum(n)
        a, b = int(np.searchsorted(upto, lo, "right")), int(np.searchsorted(upto, hi, "left")) + 1
        before = int(upto[a] - n[a]) if a < len(mine) else 0
        return self.expand(mine[a:b])[lo - before : hi - before]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, shard: int = SHARD) -> None:
    """The shards of all documents under ``path``, in order of (part, nth)."""
    tokenizer = tokenizer or tokenizer_path()

    def run(batches):
        encoder = Encoder.load(tokenizer)
        part = TaskContext.get().partitionId()
        keep_ids, keep_tokens, keep_sizes, held, nth = [], [], [], 0, 0

        def flush():
            sizes = np.concatenate(keep_sizes)
            tokens = np.concatenate(keep_tokens)
            docs_at = np.concatenate([[0], np.cumsum(sizes)])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([pa.concat_arrays(keep_ids).to_pylist()], pa.list_(pa.int64())),
                    pa.array([len(tokens)], pa.int64()), pa.array([packed(tokens, docs_at, encoder.size)], pa.binary()),
                ],
                names=["part", "nth", "doc_ids", "n_tokens", "shard"],
            )

        for batch in slices(batches, limit=TEXT_SLICE):
            ids, at = encoder.encode(column(batch, "text"))
            ended = np.insert(ids, at[1:], END_ID)
            upto = np.concatenate([[0], np.cumsum(np.diff(at) + 1)])
            lo, docs_of = 0, column(batch, "doc_id").cast(pa.int64())
            while lo < batch.num_rows:
                hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(upto, upto[lo] + shard - held))))
                keep_ids.append(docs_of.slice(lo, hi - lo))
                keep_tokens.append(ended[upto[lo] : upto[hi]])
                keep_sizes.append(np.diff(upto[lo : hi + 1]))
                held += int(upto[hi] - upto[lo])
                lo = hi
                if held >= shard:
                    yield flush()
                    keep_ids, keep_tokens, keep_sizes, held, nth = [], [], [], 0, nth + 1
        if keep_ids:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    mapped(ordered, run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """One row per document from the stored shards: doc_id, start, n_tokens, ids (little-endian u32)."""
    shards = spark.read.schema(SCHEMA).parquet(path)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                stored = Shard(column(batch, "shard")[i].as_py())
                data = stored.all().astype("<u4")
                at = np.concatenate([[0], np.cumsum(stored.n_tokens)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at) - 1, column(batch, "part")[i].as_py(), np.int32)), pa.array(np.full(len(at) - 1, column(batch, "nth")[i].as_py(), np.int32)),
                        column(batch, "doc_ids")[i].values, pa.array(at[:-1]), pa.array(stored.n_tokens),
                        pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(data)]),
                    ],
                    names=["part", "nth", "doc_id", "inside", "n_tokens", "ids"],
                )

    rows = mapped(shards, run, "part int, nth int, doc_id long, inside long, n_tokens long, ids binary")
    # A row per shard, and a row per task of the writer.
    sizes = shards.select("part", "nth", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("within", within).join(parts.select("part", before.alias("before")), "part")
    starts = write_scratch(starts.select("part", "nth", (F.col("before") + F.col("within")).alias("shard_start")), "starts")
    starts = F.broadcast(starts) if is_small(starts) else starts
    return rows.join(starts, ["part", "nth"]).select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids")
