"""Spelling variants: near words found in a bidirectional FM-index of the delimited vocabulary.

Words are counted over all texts (``counts``); two words are near if one inserted,
deleted or replaced code point turns one into the other (``near``). A word's form is
its near word that is most frequent, if frequent enough (``forms``).

Search scheme, one for each half of a word: the half is matched exactly, from the
word's outer end inwards; then the search goes on across the other half, where it may
make one error, to the delimiter at the other end. One error leaves one of the halves
untouched, so the two searches find all near words. Each is a walk of suffix-rank
intervals; both directions of the index are used, the first search extends to the
right, the second to the left. A direction is an index over words written backwards
or forwards (``Ranks``), since both searches start at a word's end. Whole sets of
searches take each step together, and searches that stand at the same interval look up
its next letters once.

The vocabulary is dealt to shards by the words' first (second direction: last) ``KEY``
code points, which near words share if the first (last) half is untouched; a shard
holds about ``SHARD`` words. A key with more words than that is dealt to several
shards by a hash, and its searches go to all of them. A near word that both searches
find counts in the first: they share the first half.

All letters are code points below 256, so a word is one byte per letter in Latin-1.

Defined results: null and wordless texts have no words; repeated rows count again; a
null doc_id leaves runs as they are; ties go to the smallest word in code-point
order; an empty table gives no rows. A single very long word costs memory in
proportion to its length.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.arrays import LOWER, column, coded, flat, slices
from spanlake.llm.tables import mapped, write_scratch

LETTERS, OCCURRENCES, TIMES = 7, 2, 10
KEY, SHARD, SEARCHES = 3, 40_000, 4_000
#: Bytes of text that are worked on at once.
TEXT_SLICE = 8 << 20

_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Latin-1 bytes of all runs of letters, their offsets, the row of each), lower-cased from A to Z."""
    lead = raw == 0xC3  # begins U+00C0 to U+00FF
    tail = np.zeros(len(raw), bool)
    tail[1:] = lead[:-1]
    inside = _ASCII[raw] | lead | tail
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])[: len(raw)]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    letter = inside & ~lead
    data = np.where(tail, raw + np.uint8(0x40), LOWER[raw])[letter]
    place = np.concatenate([[0], np.cumsum(letter)])
    return data, np.append(place[start], place[-1]).astype(np.int64), np.searchsorted(offsets, start, "right") - 1


class Shift:
    """CRC-32 of a concatenation from those of its parts: what appending n bytes does to the first one."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def table(self, n: int) -> np.ndarray:
        """The effect of n bytes on each value of each of the four bytes of a checksum."""
        if n not in self.tables:
            plain = crc32(bytes(n))
            bits = [crc32(bytes(n), 1 << k) ^ plain for k in range(32)]
            out = np.zeros((4, 256), np.uint32)
            for b in range(4):
                for k in range(8):
                    out[b, np.arange(256) >> k & 1 == 1] ^= np.uint32(bits[8 * b + k])
            if len(self.tables) > 4096:
                self.tables.clear()
            self.tables[n] = out
        return self.tables[n]

    def joined(self, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
        """crc32(a + b) for arrays of crc32(a), crc32(b) and the lengths of b."""
        kinds, which = np.unique(n, return_inverse=True)
        flat_tables = np.stack([self.table(int(k)) for k in kinds]).reshape(-1)
        base = which.astype(np.int64) * 1024
        out = second.copy()
        for b in range(4):
            out ^= flat_tables[base + 256 * b + (first >> np.uint32(8 * b) & np.uint32(255))]
        return out


_SHIFT = Shift()


def _counted(modulus: int):
    def run(batches):
        for batch in slices(batches, limit=TEXT_SLICE):
            raw, offsets = flat(column(batch, "text"))
            data, at, row = runs(raw, offsets)
            size = np.diff(at)
            long = np.flatnonzero(size >= LETTERS)
            keep = np.repeat(size >= LETTERS, size)
            bounds = np.concatenate([[0], np.cumsum(size[long])]).astype(np.int64)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(long), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[keep]))])
            codes, names = coded(packed)
            texts = [w.decode("latin-1") for w in names.to_pylist()]
            plain = np.ones(len(codes), bool)
            changed: dict[str, int] = {}
            if len(codes) and modulus:
                ids = column(batch, "doc_id").cast(pa.int64()).to_pylist()
                utf8 = [t.encode() for t in texts]
                crc = np.array([crc32(u) for u in utf8], np.uint32)
                prefix = np.array([crc32(f"{i}:".encode()) for i in ids], np.uint32)
                rows = row[long]
                h = _SHIFT.joined(prefix[rows], crc[codes], np.array([len(u) for u in utf8])[codes])
                known = np.array([i is not None for i in ids])[rows]
                plain = ~((h % np.uint32(modulus) == 0) & known)
                hit = np.flatnonzero(~plain)
                for code, p in zip(codes[hit].tolist(), (h[hit].astype(np.int64) % size[long][hit]).tolist(), strict=True):
                    word = texts[code]
                    if len(word) > LETTERS:
                        word = word[:p] + word[p + 1 :]
                        changed[word] = changed.get(word, 0) + 1
            n = np.bincount(codes[plain], minlength=len(texts))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([texts[k] for k in some.tolist()] + list(changed), pa.string()), pa.array(np.concatenate([n[some], list(changed.values())]).astype(np.int64))],
                names=["word", "n"],
            )

    return run


def counts(docs: DataFrame, modulus: int = 0, least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of all words of ``LETTERS`` code points or more with ``least`` occurrences or more.

    With ``modulus`` m, a run of letters loses a code point where m divides its checksum
    with the document's id (the numbered query's made-up misspellings).
    """
    each = mapped(docs.select("doc_id", "text"), _counted(modulus), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Ranks:
    """Suffix-rank intervals over words joined by a delimiter, each word's last letter first.

    The text is all words, reversed, sorted and each followed by the delimiter; it goes
    round. An interval of ranks stands for the suffixes that begin with what has been
    matched; ``extend`` prepends a letter, which is the word's next one.
    """

    def __init__(self, words: list[bytes]):
        backwards = [w[::-1] for w in words]
        order = sorted(range(len(words)), key=backwards.__getitem__)
        self.count = m = len(words)
        text = np.frombuffer(b"\0".join(backwards[k] for k in order) + b"\0", np.uint8)
        self.n = n = len(text)
        ends = np.flatnonzero(text == 0)
        # Delimiters rank by the word that follows, so suffixes differ within a word.
        rank = text.astype(np.int64) + m
        rank[ends] = (np.arange(m) + 1) % m
        k, longest = 1, max(map(len, words))
        while True:
            key = rank * (n + m + 256) + np.roll(rank, -k)
            suffixes = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[suffixes]) != 0)])
            rank = np.empty(n, np.int64)
            rank[suffixes] = new
            k *= 2
            if new[-1] == n - 1 or k > longest + 1:
                break
        self.before = text[suffixes - 1]  # the letter before each suffix
        sort = np.argsort(self.before, kind="stable")
        self.keys = self.before[sort].astype(np.int64) * (n + 1) + sort
        self.word = np.array(order)  # the delimiter of rank k is followed by the k-th word

    def extend(self, letter: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, letter.astype(np.int64) * (self.n + 1) + rank)

    def followers(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, letter, lo, hi) for each letter that each interval can be extended with."""
        n = hi - lo
        which = np.repeat(np.arange(len(lo)), n)
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(which))
        pair = np.unique(which * 256 + self.before[at])
        which, letter = pair // 256, pair % 256
        real = letter > 0
        which, letter = which[real], letter[real]
        return which, letter, self.extend(letter, lo[which]), self.extend(letter, hi[which])


def search(index: Ranks, words: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the searched word, number of the indexed word) with one error behind the first ``exact`` letters.

    Searches without an error and those that made theirs go on together, a letter a step.
    """
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    none = np.zeros(0, np.int64)
    clean = (np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), index.count, np.int64))
    erring = (none,) * 4
    found = [(none, none)]
    step = 0
    while len(clean[0]) or len(erring[0]):
        free = exact[clean[0]] <= step
        if free.any():
            new = _errors(index, letters, begin, exact, *(x[free] for x in clean))
            erring = tuple(np.concatenate(x) for x in zip(erring, new, strict=True))
        (who, _, lo, _), erring = _matched(index, letters, begin, *erring)
        found.append((who, index.word[lo]))  # a delimited word stands once
        _, clean = _matched(index, letters, begin, *clean)
        step += 1
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    pair = np.unique(a * index.count + b)
    return pair // index.count, pair % index.count


def _matched(index: Ranks, letters, begin, who, at, lo, hi) -> tuple[tuple, tuple]:
    """The states (word, place, interval) after the word's next letter: those at the word's end, the others."""
    c = letters[begin[who] + at]
    lo, hi = index.extend(c, lo), index.extend(c, hi)
    over, live = (lo < hi) & (c == 0), (lo < hi) & (c > 0)
    state = (who, at + 1, lo, hi)
    return tuple(x[over] for x in state), tuple(x[live] for x in state)


def _errors(index: Ranks, letters, begin, exact, who, at, lo, hi) -> tuple:
    """The states after one error at this place: another letter, one more, one less.

    What another place gives as well is left out: one more of the letter that follows,
    one less of a letter that stood before.
    """
    spans, which = np.unique(lo * (index.n + 1) + hi, return_inverse=True)
    owner, letter, low, high = index.followers(spans // (index.n + 1), spans % (index.n + 1))
    first = np.searchsorted(owner, np.arange(len(spans) + 1))
    n = np.diff(first)[which]
    state = np.repeat(np.arange(len(who)), n)
    option = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(len(state))
    own = letters[begin[who] + at]
    other = letter[option] != own[state]
    state, option = state[other], option[other]
    replaced = own[state] > 0
    again = (at > exact[who]) & (letters[begin[who] + np.maximum(at, 1) - 1] == own)
    less = (own > 0) & ~again
    parts = [
        (who[state[replaced]], at[state[replaced]] + 1, low[option[replaced]], high[option[replaced]]),
        (who[state], at[state], low[option], high[option]),
        (who[less], at[less] + 1, lo[less], hi[less]),
    ]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _shard(rows: pa.Table) -> pa.Table:
    """Near words of the shard's searches: how many, and the most frequent one of each."""
    words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    turned = rows.column("turned")[0].as_py()
    n = rows.column("n").to_numpy()
    stored = rows.column("stored").to_numpy(zero_copy_only=False).astype(bool)
    inside, seek = np.flatnonzero(stored), np.flatnonzero(~stored)
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    if not len(inside) or not len(seek):
        return schema.empty_table()
    face = [w[::-1] for w in words] if turned else words
    index = Ranks([face[k] for k in inside.tolist()])
    place = np.empty(len(inside), np.int64)  # in code-point order
    place[sorted(range(len(inside)), key=lambda k: words[inside[k]])] = np.arange(len(inside))
    out_word, out_count, out_near, out_n = [], [], [], []
    seek = np.array(sorted(seek.tolist(), key=face.__getitem__))  # neighbours share intervals
    for lo in range(0, len(seek), SEARCHES):
        part = seek[lo : lo + SEARCHES]
        size = np.array([len(words[k]) for k in part.tolist()])
        exact = size - size // 2 if turned else size // 2
        a, b = search(index, [face[k] for k in part.tolist()], exact)
        if turned and len(a):
            again = np.array([words[part[i]][: len(words[part[i]]) // 2] == words[inside[j]][: len(words[part[i]]) // 2] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            a, b = a[~again], b[~again]
        order = np.lexsort((place[b], -n[inside[b]], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
        out_word += [words[k].decode("latin-1") for k in part[a[first]].tolist()]
        out_count += np.diff(np.append(first, len(a))).tolist()
        out_near += [words[k].decode("latin-1") for k in inside[b[first]].tolist()]
        out_n += n[inside[b[first]]].tolist()
    return pa.Table.from_arrays([pa.array(x, t) for x, t in ((out_word, pa.string()), (out_count, pa.int64()), (out_near, pa.string()), (out_n, pa.int64()))], schema=schema)


def near(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, near, near_n) of the words (word, n) that have near words; ``near`` is the most frequent one."""
    faces = words.withColumn("turned", F.explode(F.array(F.lit(False), F.lit(True))))
    faces = faces.withColumn("key", F.when(F.col("turned"), F.substring("word", -KEY, KEY)).otherwise(F.substring("word", 1, KEY)))
    faces = write_scratch(faces, "faces")
    sizes = faces.groupBy("turned", "key").agg(F.count("*").alias("size"))
    sizes = write_scratch(sizes.withColumn("parts", F.ceil(F.col("size") / shard).cast("int")), "keys")
    total = words.count()
    shards = max(1, -(-total // shard))
    dealt = faces.join(sizes.drop("size"), ["turned", "key"])
    at = lambda part: F.pmod(F.xxhash64("turned", "key", part), F.lit(shards))
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    stored = dealt.select("turned", "word", "n", F.lit(True).alias("stored"), at(mine).alias("shard"))
    # A key's searches go to each of its parts, but once where parts share a shard.
    visits = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: at(k.cast("int"))))
    seek = dealt.select("turned", "word", "n", F.lit(False).alias("stored"), F.explode(visits).alias("shard"))
    found = stored.unionByName(seek).groupBy("turned", "shard").applyInArrow(_shard, "word string, n_near long, near string, near_n long")
    found = write_scratch(found, "near")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n_near", F.col("best")["near"].alias("near"), (-F.col("best")["minus"]).alias("near_n"))


def forms(words: DataFrame, times: int = TIMES, shard: int = SHARD) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    A form has ``times`` as many occurrences, so chains of forms are short; pointers to
    the form jump twice as far in each round.
    """
    words = write_scratch(words, "words")
    found = near(words, shard).select(F.col("word").alias("of"), "n_near", F.col("near").alias("form"), F.col("near_n").alias("form_n"))
    out = words.join(found, words["word"] == found["of"], "left").drop("of")
    real = F.col("form_n") >= times * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(real, F.col("form")).alias("form"), F.when(real, F.col("form_n")).alias("form_n"))
    out = write_scratch(out, "forms")
    jump = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        far = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jump = write_scratch(jump.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not jump.where("moved").limit(1).count():
            break
        jump = jump.drop("moved")
    jump = jump.select(F.col("word").alias("of"), "root")
    return out.join(jump, out["word"] == jump["of"], "left").drop("of").withColumn("root", F.coalesce("root", "word"))
