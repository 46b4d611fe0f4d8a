"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and every character that is no letter counts as a blank.
n-grams of 1 to 3 characters are hashed to ``SIZE`` features; a feature's value is
its share of the text's n-grams times its inverse document frequency over *all*
training documents. Weights are learned by follow-the-regularised-leader with
elastic-net penalties on a bounded sample (``PER_CLASS`` rows a language, or an equal
share of ``SAMPLE`` with many languages), a fifth of which sets the temperature instead.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is
everything where there is nothing to learn from; repeated rows are scored alike; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.arrays import column, grouped, letter_table, lowered, slices
from spanlake.llm.ftrl import Ftrl, softmax
from spanlake.llm.tables import mapped

BITS = 15
SIZE = 1 << BITS
PER_CLASS, SAMPLE, EPOCHS = 800, 8000, 3
#: Languages are learned that have this share of the training documents, or this number of them.
RARE, ROWS = 0.002, 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.0005
SCALE = 30.0
MIN_SCORE = 0.5
FOLDS, HELD = 4, 2
TEXT_SLICE = 1 << 20
SCHEMA = "doc_id long, lang_pred string, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def ngrams(values: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(features by n-gram length at each character, offsets, whether a row has a letter).

    Characters where no n-gram begins have the feature SIZE, which counts nothing.
    """
    points, offsets = lowered(values)
    letters = letter_table()[points]
    rows = len(offsets) - 1
    seen = np.concatenate([[0], np.cumsum(letters)])
    has = seen[offsets[1:]] > seen[offsets[:-1]]
    c = np.where(letters, points, 0x20).astype(np.uint32)
    stop = np.zeros(len(c) + 1, bool)
    stop[offsets] = True  # no n-gram reaches over a row's end
    out = []
    h, valid = c.copy(), letters
    for n in (1, 2, 3):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :] if len(h) > 1 else h[:0]
            valid = valid[: len(h)] & ~stop[n - 1 : n - 1 + len(h)] if n > 2 else (letters[:-1] | letters[1:])[: len(h)] & ~stop[1 : 1 + len(h)]
        at = ((h + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        full = np.full(len(c), SIZE, np.int32)
        full[: len(at)] = np.where(valid, at, SIZE)
        out.append(full)
    del rows
    return out, offsets, has


def _frequencies(batches):
    """Documents of a task that have each feature."""
    total = np.zeros(SIZE + 1, np.int64)
    docs = 0
    for batch in slices(batches, limit=TEXT_SLICE):
        grams, offsets, _ = ngrams(column(batch, "text"))
        rows = len(offsets) - 1
        docs += rows
        length = np.diff(offsets)
        for lo in range(0, rows, 128):  # a bit for each of 128 rows and each feature
            hi = min(lo + 128, rows)
            seen = np.zeros((hi - lo) * (SIZE + 1), bool)
            base = np.repeat(np.arange(hi - lo, dtype=np.int64) * (SIZE + 1), length[lo:hi])
            for g in grams:
                seen[base + g[offsets[lo] : offsets[hi]]] = True
            total += seen.reshape(hi - lo, -1).sum(axis=0)
    at = np.flatnonzero(total[:SIZE])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], docs), pa.int64())], names=["feature", "docs"]
    )


def _sparse(batches):
    for batch in slices(batches, limit=TEXT_SLICE):
        grams, offsets, _ = ngrams(column(batch, "text"))
        features, counts = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            n = np.bincount(np.concatenate([g[a:b] for g in grams]), minlength=SIZE + 1)[:SIZE]
            at = np.flatnonzero(n)
            features.append(at.astype(np.int32))
            counts.append(n[at].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "lang"), pa.array(features, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            names=["lang", "features", "counts"],
        )


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (SIZE + 1, languages), idf and scale included
    bias: np.ndarray
    temperature: float


def fit(docs: DataFrame) -> Model | None:
    """Learns from the rows with text and language outside the held-out fold."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    per = rows.groupBy("lang").count()
    total = per.agg(F.sum("count")).first()[0] or 0
    known = {r["lang"]: r["count"] for r in per.where(F.col("count") >= min(RARE * total, ROWS)).collect()}
    if not known:
        return None
    quota = max(1, min(PER_CLASS, SAMPLE // len(known)))
    sample = mapped(sampled(rows, known, quota), _sparse, "lang string, features array<int>, counts array<int>").collect()
    df = np.zeros(SIZE)
    n_docs = 1
    for r in mapped(rows.select("text"), _frequencies, "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).collect():
        if r.feature < 0:
            n_docs = r.docs
        else:
            df[r.feature] = r.docs
    idf = np.log((1 + n_docs) / (1 + df)) + 0.1
    return learned(sorted(known), sorted((r.lang, r.features, r.counts) for r in sample), idf)


def sampled(rows: DataFrame, known: dict[str, int], quota: int) -> DataFrame:
    """The first ``quota`` rows of each language by a hash of the id (of the text for null ids): the same rows each time."""
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("langid"), F.col("text"))).otherwise(F.xxhash64(F.lit("langid"), F.col("doc_id")))
    part = F.pmod(h, F.lit(1_000_000))
    # A share that holds the quota with near certainty goes to the sort.
    most = quota + 8 * quota**0.5 + 16
    wanted = F.create_map(*[F.lit(x) for k, n in known.items() for x in (k, int(1_000_000 * min(1.0, most / n)) + 1)])
    some = rows.where(part < F.element_at(wanted, F.col("lang"))).withColumns({"part": part, "second": F.xxhash64("text")})
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("part", "second", "doc_id"))
    return some.withColumn("nth", nth).where(F.col("nth") <= quota).select("text", "lang")


def learned(langs: list[str], sample: list[tuple], idf: np.ndarray) -> Model:
    data = []
    for lang, features, counts in sample:
        if len(features):
            at, n = np.asarray(features), np.asarray(counts, float)
            data.append((np.append(at, SIZE), np.append(n / n.sum() * idf[at] * SCALE, 1.0), langs.index(lang)))
    order = np.random.default_rng(7).permutation(len(data))
    aside = [data[i] for i in order[: len(data) // 5]]
    model = Ftrl(len(langs), SIZE + 1, ALPHA, BETA, L1, L2)
    for _ in range(EPOCHS):
        for i in order[len(data) // 5 :]:
            at, x, y = data[i]
            w = model.weights(at)
            p = softmax(w @ x)
            p[y] -= 1
            model.update(at, np.outer(p, x), w)
    w = model.weights()
    logits = np.array([w[:, at] @ x for at, x, _ in aside]).reshape(len(aside), len(langs))
    table = np.zeros((SIZE + 1, len(langs)), np.float32)
    table[:SIZE] = (w[:, :SIZE] * idf * SCALE).T
    return Model(langs, table, w[:, SIZE].copy(), temperature(logits, np.array([y for *_, y in aside], int)))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows set aside (1 without rows).

    The right class counts for (n + 1) / (n + 2) only, n being their number, so that
    rows without an error do not ask for certainty.
    """
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        right = np.clip(p[np.arange(len(y)), y], 1e-12, 1 - 1e-12)
        return -(sure * np.log(right) + (1 - sure) * np.log(1 - right)).mean()

    sure = (len(y) + 1) / (len(y) + 2)

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):  # golden section
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predicted(values: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """(language, probability) of each text."""
    grams, offsets, has = ngrams(values)
    rows = len(offsets) - 1
    if model is None:
        return np.full(rows, "und", object), np.zeros(rows)
    k = len(model.langs)
    total, n = np.zeros((rows, k)), np.zeros(rows)
    for g in grams:
        total += grouped(model.weights[g], offsets)
        real = np.concatenate([[0], np.cumsum(g < SIZE)])
        n += real[offsets[1:]] - real[offsets[:-1]]
    p = softmax((total / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    return np.where(has, np.array(model.langs, object)[best], "und"), np.where(has, p[np.arange(rows), best], 0.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    def run(batches):
        for batch in slices(batches, limit=TEXT_SLICE):
            lang, score = predicted(column(batch, "text"), model)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
            )

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)


def keep(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The documents in a language known with at least that score, with all their columns."""
    model = fit(docs)

    def run(batches):
        for batch in slices(batches, limit=TEXT_SLICE):
            lang, score = predicted(column(batch, "text"), model)
            yield batch.filter(pa.array((lang != "und") & (score >= least)))

    return mapped(docs, run, docs.schema)
