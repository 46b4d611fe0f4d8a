"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with
references, one per language tag of the corpus, by Jensen-Shannon distance (base 2,
0 to 1). References come from all documents of 10 words or more, then again from those
that are near them, so that junk does not shape them; the common
words of a language are its most frequent words of up to ``WORD_CHARS`` code points
(function words are short, and the short words of a task are few enough to be
counted exactly before the shuffle).

A document fails if it is too far from every reference in either histogram. Below
the minimum lengths a histogram says nothing and is not looked at. A document with fewer
common words than a reference is too far from ``LACK`` of the distance that a text
without any common word has from it, since none can be further off on that side. This
bound is for verdicts; references are learned without it, as in the query's SQL.

Long numbers and tokens: ``keep`` also measures the character classes without the words
that hold a digit, if these are ``NUMBERS`` of all words at most, and takes the nearer of
both, so that prose is not dropped for a phone number or a key. ``score`` reports the plain
distance and verdict, which are those of the query's SQL.

Defined results: null and empty texts have no words and fail the base rules; a null
language tag is the tag ``und``; an empty table gives no rows; for documents of a
tag without a reference only the base rules count; repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.arrays import LOWER, WHITE, Words, code_points, coded, column, flat, renamed, slices, spans, sums
from spanlake.llm.tables import mapped, write_scratch

#: Longest common word, number of common words, window of the repetition rule.
WORD_CHARS, COMMON, WINDOW = 5, 64, 5
#: Least length for each histogram, and the largest distance that passes.
MIN_CHARS, MIN_WORDS, MAX_CLASS, MAX_WORD = 200, 60, 0.19, 0.52
#: Largest distance of a document short of common words, as a share of that of a text without any; only for
#: references whose common words are LEAST_COMMON of all: of MIN_WORDS words a dozen are to be expected then.
LACK, LEAST_COMMON = 0.96, 0.2
#: Largest share of words with a digit that ``keep`` may leave out.
NUMBERS = 1 / 6
#: Rounds of references: each later one is counted over the documents that the one before lets pass.
ROUNDS = 2
#: A common word has at least this share of its language's words: at most 1 / COMMON_SHARE are sorted.
COMMON_SHARE = 0.0002
#: A language tag is a reference if it has this share of all words, or this number of them.
SHARE, TAG_WORDS = 0.01, 5_000

CLASSES = ("lower", "upper", "digit", "white", "sentence", "symbol", "other", "beyond")
CLASS = np.full(256, 6, np.uint8)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A], CLASS[0x80:] = 0, 1, 2, 7
CLASS[[0x20, *range(0x09, 0x0E)]] = 3
CLASS[list(b".,;:?'\"()-")] = 4
CLASS[list(b"#*$%&|<>!")] = 5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCORE_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, class_distance double, word_distance double, nearest string"
)


class Texts:
    """The texts of a slice with what the rules count; ``base`` adds the base counts."""

    def __init__(self, values: pa.Array, base: bool = True):
        raw, offsets = flat(values)
        self.words = words = Words(raw, offsets)
        begins = code_points(raw)
        self.n_words = words.count.astype(np.int64)
        self.codes, self.names = words.coded(lower=False)
        self.base_failed = self.n_words < 10
        row = np.repeat(np.arange(words.rows, dtype=np.int32) * 8, np.diff(offsets))
        kinds = row[begins] + CLASS[raw[begins]]
        self.classes = np.bincount(kinds, minlength=words.rows * 8).reshape(-1, 8)
        self.raw, self.begins, self.kinds = raw, begins, kinds
        if base:
            self.word_chars = self.classes.sum(axis=1) - self.classes[:, 3]
            self.n_symbols = sums(SYMBOL[raw], offsets)
            self.n_dup_lines = self._dup_lines(raw, offsets)
            self.n_repeat_words = self._repeats()
            self.base_failed |= 100 * self.n_repeat_words > 20 * self.n_words

    def plain_classes(self):
        """Character classes without words that hold a digit; as they are where these are over NUMBERS of the words."""
        words = self.words
        digits = np.concatenate([[0], np.cumsum(CLASS[self.raw] == 2)])
        held = np.flatnonzero(digits[words.end] > digits[words.start])
        few = np.bincount(words.row[held], minlength=words.rows) <= NUMBERS * self.n_words
        held = held[few[words.row[held]]]
        edge = np.zeros(len(self.raw) + 1, np.int8)
        edge[words.start[held]] = 1
        edge[words.end[held]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        left_out = np.bincount(self.kinds[inside[self.begins]], minlength=words.rows * 8).reshape(-1, 8)
        return self.classes - left_out

    @staticmethod
    def _dup_lines(raw, offsets):
        """Lines with a word that repeat an earlier line of their row."""
        rows = len(offsets) - 1
        breaks = np.flatnonzero(raw == 0x0A)
        # A row's last break may leave an empty line that begins where the next row does.
        start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        row = np.searchsorted(offsets[1:], start, "right")
        start, row = start[row < rows], row[row < rows]
        stop = np.minimum(np.append(breaks, len(raw))[np.searchsorted(breaks, start)], offsets[1:][row])
        has_word = np.concatenate([[0], np.cumsum(~WHITE[raw])])
        real = has_word[stop] > has_word[start]
        start, stop, row = start[real], stop[real], row[real]
        codes, names = coded(spans(raw, start, stop))
        key, _ = renamed(row * (len(names) + 1) + codes)
        # Numbers are given in order of appearance: a first occurrence exceeds all before it.
        top = np.maximum.accumulate(np.concatenate([[-1], key]))
        return np.bincount(row[key <= top[:-1]], minlength=rows).astype(np.int64)

    def _repeats(self):
        """Words that lie in a window of WINDOW words found twice or more in their row."""
        words, n = self.words, len(self.codes)
        out = np.zeros(words.rows, np.int64)
        if n < WINDOW:
            return out
        whole = np.flatnonzero(words.row[: n - WINDOW + 1] == words.row[WINDOW - 1 :])
        h = words.row[whole].astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + self.codes[whole + k].astype(np.uint64)
        ordered = np.sort(h)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return out
        place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        at = whole[twice[place] == h]
        # Equal hashes only nominate: the windows' words are compared.
        key, k = words.row[at], words.rows
        for i in range(WINDOW):
            key, k = renamed(key * (len(self.names) + 1) + self.codes[at + i])
        hit = at[np.bincount(key, minlength=k)[key] > 1]
        covered = np.zeros(n + WINDOW, np.int32)
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
        marked = np.cumsum(covered[:n]) > 0
        return np.bincount(words.row[marked], minlength=words.rows).astype(np.int64)

    def short_words(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word or -1 if it is long, the distinct short words, lower-cased)."""
        if len(self.names) == 0:
            return self.codes, self.names
        raw, offsets = flat(self.names)
        is_short = np.flatnonzero(sums(code_points(raw), offsets) <= WORD_CHARS)
        some, bounds = flat(self.names.take(pa.array(is_short)))
        low = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(is_short), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(LOWER[some])]
        )
        again = np.full(len(self.names), -1, np.int64)
        again[is_short], names = coded(low)
        return again[self.codes], names


def _tags(batch) -> pa.Array:
    return column(batch, "lang").cast(pa.large_string()).fill_null("und")


def _counts(batches, refs: dict):
    """Per slice and language: character classes and short words of documents that pass the rules so far."""
    for batch in slices(batches):
        texts = Texts(column(batch, "text"), base=False)
        langs, names = coded(_tags(batch).cast(pa.large_binary()))
        good = _verdicts(texts, refs, tags=_tags(batch), learning=True)["kept"]
        out = []
        codes, short = texts.short_words()
        of_word = langs[texts.words.row] if len(langs) else langs
        usable = good[texts.words.row]
        for k, name in enumerate(names.to_pylist()):
            mine = good & (langs == k)
            kinds = texts.classes[mine].sum(axis=0)
            out += [(name, f"class:{i}", int(v)) for i, v in enumerate(kinds) if v]
            picked = codes[usable & (of_word == k)]
            out.append((name, "words", len(picked)))
            n = np.bincount(picked[picked >= 0], minlength=len(short))
            at = np.flatnonzero(n)
            values = short.take(pa.array(at)).to_pylist()
            out += [(name, "word:" + v.decode(errors="replace"), int(c)) for v, c in zip(values, n[at], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0].decode(errors="replace") for x in out], pa.string()),
                pa.array([x[1] for x in out], pa.string()),
                pa.array([x[2] for x in out], pa.int64()),
            ],
            names=["lang", "key", "n"],
        )


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Per language tag: class shares, common words, shares of these and of all other words.

    Counted over all documents that pass. The result has COMMON words of each tag with SHARE of all words or
    TAG_WORDS of them: it is as many as the corpus has such tags, and so is the work for a document.
    """
    refs: dict = {}
    for _ in range(ROUNDS):
        refs = _round(docs, refs)
    return refs


def _round(docs: DataFrame, refs: dict) -> dict:
    counts = mapped(docs.select("text", "lang"), lambda batches: _counts(batches, refs), "lang string, key string, n long")
    counts = write_scratch(counts.groupBy("lang", "key").agg(F.sum("n").alias("n")), "histograms")
    words = counts.where("key = 'words' AND n > 0")
    total = words.agg(F.sum("n")).first()[0] or 0
    large = words.where(F.col("n") >= min(SHARE * total, TAG_WORDS)).select("lang", F.col("n").alias("words"))
    kept = counts.join(F.broadcast(large), "lang")  # a row a tag
    common = (
        kept.where(F.col("key").startswith("word:") & (F.col("n") >= COMMON_SHARE * F.col("words")))
        .groupBy("lang")
        .agg(F.max("words").alias("words"), _top("n", "key", COMMON).alias("top"))
    )
    kinds = kept.where(F.col("key").startswith("class:")).groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("classes")
    )
    out = {}
    for r in kinds.join(common, "lang").collect():
        n = np.array([r.classes.get(f"class:{i}", 0) for i in range(8)], float)
        top = [(t.key[5:].encode(), t.n) for t in r.top]
        share = np.array([t[1] for t in top], float) / r.words
        out[r.lang] = (n / n.sum(), [t[0] for t in top], np.append(share, max(0.0, 1 - share.sum())))
    return out


def _top(n: str, key: str, k: int):
    """The k entries with the largest n, smaller keys first among equals."""
    return F.expr(
        f"transform(slice(sort_array(collect_list(named_struct('neg', -{n}, 'key', {key}))), 1, {k}),"
        " x -> named_struct('key', x.key, 'n', -x.neg))"
    )


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def judged(values: pa.Array, refs: dict, plain: bool = False, tags: pa.Array | None = None) -> dict[str, np.ndarray]:
    """All result columns of each text.

    ``plain`` for a verdict that leaves out words with digits, too; with ``tags``, texts whose tag has no reference
    are judged by the base rules.
    """
    return _verdicts(Texts(values), refs, plain, tags)


def _verdicts(texts: Texts, refs: dict, plain: bool = False, tags: pa.Array | None = None, learning: bool = False) -> dict[str, np.ndarray]:
    rows = texts.words.rows
    names = sorted(refs)
    chars = texts.classes.sum(axis=1)
    shares = texts.classes / np.maximum(chars, 1)[:, None]
    near = np.zeros((rows, len(names)), bool)
    if plain:
        without = texts.plain_classes()
        without = without / np.maximum(without.sum(axis=1), 1)[:, None]
    codes, short = texts.short_words()
    of_class, of_word = np.zeros((rows, len(names))), np.zeros((rows, len(names)))
    most = np.full((rows, len(names)), MAX_WORD)
    for k, name in enumerate(names):
        kinds, common, share = refs[name]
        of_class[:, k] = distance(shares, kinds)
        near[:, k] = of_class[:, k] <= MAX_CLASS
        if plain:
            near[:, k] |= distance(without, kinds) <= MAX_CLASS
        found = pc.index_in(short, pa.array(common, pa.large_binary())).fill_null(len(common))
        where = np.append(found.to_numpy(zero_copy_only=False).astype(np.int64), len(common))
        key = texts.words.row * (len(common) + 1) + where[codes]
        n = np.bincount(key, minlength=rows * (len(common) + 1)).reshape(rows, -1)
        n = n / np.maximum(texts.n_words, 1)[:, None]
        of_word[:, k] = distance(n, share)
        if not learning and 1 - share[-1] >= LEAST_COMMON:
            none = distance(np.eye(len(share))[-1:], share)[0]
            most[n[:, -1] > share[-1], k] = min(MAX_WORD, LACK * none)
    long_chars, long_words = chars >= MIN_CHARS, texts.n_words >= MIN_WORDS
    far = np.zeros(rows, bool)
    if names:
        far = ~((near | ~long_chars[:, None]) & ((of_word <= most) | ~long_words[:, None])).any(axis=1)
    if names and tags is not None:
        far &= pc.is_in(tags, pa.array(names, pa.large_string())).to_numpy(zero_copy_only=False)
    best = np.argmin(of_class + of_word, axis=1) if names else np.zeros(rows, int)
    at = np.arange(rows)
    return {
        **{b: getattr(texts, b, None) for b in BASE},
        "base_failed": texts.base_failed,
        "kept": ~texts.base_failed & ~far,
        "class_distance": of_class[at, best] if names else np.full(rows, np.nan),
        "word_distance": of_word[at, best] if names else np.full(rows, np.nan),
        "nearest": np.array(names, object)[best] if names else np.full(rows, None, object),
    }


def score(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """One row per document: base counts, both distances to the nearest language and the verdict."""
    refs = references(docs) if refs is None else refs

    def run(batches):
        for batch in slices(batches):
            found = judged(column(batch, "text"), refs, tags=_tags(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id").cast(pa.int64()),
                    *[pa.array(found[b], pa.int64()) for b in BASE],
                    pa.array(found["base_failed"]),
                    pa.array(found["kept"]),
                    pa.array(found["class_distance"], from_pandas=True),
                    pa.array(found["word_distance"], from_pandas=True),
                    pa.array(found["nearest"], pa.string()),
                ],
                names=[x.split()[0] for x in SCORE_SCHEMA.split(",")],
            )

    return mapped(docs.select("doc_id", "text", "lang"), run, SCORE_SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    refs = references(docs)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(judged(column(batch, "text"), refs, plain=True, tags=_tags(batch))["kept"]))

    return mapped(docs, run, docs.schema)
