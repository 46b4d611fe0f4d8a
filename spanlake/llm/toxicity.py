"""Toxicity by a counterfactually regularised classifier.

Features are words and their beginnings (3 to 5 letters), lower-cased, present or
not in a whole text. On a bounded sample of labelled rows (``SAMPLE``) the telling
ones are selected by chi-square, and a logistic regression is learned by
follow-the-regularised-leader. Wherever a labelled text names a group (``IDENTITY``),
the same text with another group of that kind and language in its place is a
counterfactual: the group's name is exchanged word by word, and what the other words
of the text share with it stays. A squared penalty on the difference of both scores
(before the logistic function) holds them together. A group's name thus says no more
than that of any other group of its kind, however frequent it is among the toxic rows.

Defined results: null and empty texts get the score of a text without features; rows
with several labels count as toxic if most of them say so; without two classes to learn
from all scores are the share of toxic rows (0 without rows); repeated rows are
scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.arrays import Words, column, distinct, flat, letter_table, lowered, slices
from spanlake.llm.ftrl import Ftrl
from spanlake.llm.tables import mapped, write_scratch

SAMPLE, FEATURES, EPOCHS = 20_000, 4096, 4
PREFIXES = (3, 4, 5)
BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.5, 0.01
PENALTY = 1.0
FOLDS, HELD = 5, 0

# Names of groups by language and kind, each in its forms (one, many);
# those of a kind are exchanged for one another, form by form.
IDENTITY = {
    "en": {
        "faith": [("muslim", "muslims"), ("christian", "christians"), ("jew", "jews"), ("hindu", "hindus"), ("buddhist", "buddhists"), ("atheist", "atheists")],
        "creed": [("jewish",), ("islamic",), ("catholic",), ("protestant",)],
        "adults": [("woman", "women"), ("man", "men")],
        "sex": [("female", "females"), ("male", "males")],
        "children": [("girl", "girls"), ("boy", "boys")],
        "orientation": [("gay", "gays"), ("straight", "straights"), ("lesbian", "lesbians"), ("bisexual", "bisexuals"), ("queer", "queers"), ("homosexual", "homosexuals"), ("heterosexual", "heterosexuals")],
        "origin": [("african", "africans"), ("asian", "asians"), ("european", "europeans"), ("american", "americans"), ("mexican", "mexicans"), ("arab", "arabs")],
        "colour": [("black", "blacks"), ("white", "whites")],
        "status": [("immigrant", "immigrants"), ("refugee", "refugees"), ("native", "natives")],
        "age": [("young",), ("old",), ("elderly",)],
        "ability": [("disabled",), ("blind",), ("deaf",), ("sighted",)],
    },
    "fr": {
        "faith": [("musulman", "musulmans"), ("chrétien", "chrétiens"), ("juif", "juifs"), ("athée", "athées")],
        "adults": [("femme", "femmes"), ("homme", "hommes")],
        "origin": [("africain", "africains"), ("asiatique", "asiatiques"), ("européen", "européens"), ("américain", "américains"), ("arabe", "arabes")],
    },
    "de": {
        "faith": [("muslimin", "muslime"), ("christin", "christen"), ("jüdin", "juden"), ("atheistin", "atheisten")],
        "adults": [("frau", "frauen"), ("mann", "männer")],
        "origin": [("afrikanerin", "afrikaner"), ("asiatin", "asiaten"), ("europäerin", "europäer"), ("amerikanerin", "amerikaner"), ("araberin", "araber")],
    },
    "es": {
        "faith": [("musulmán", "musulmanes"), ("cristiano", "cristianos"), ("judío", "judíos"), ("ateo", "ateos")],
        "adults": [("mujer", "mujeres"), ("hombre", "hombres")],
        "origin": [("africano", "africanos"), ("asiático", "asiáticos"), ("europeo", "europeos"), ("americano", "americanos"), ("árabe", "árabes")],
    },
}


def exchanges() -> dict[str, list[str]]:
    """The names that each name is exchanged for. One that two languages have counts for the first."""
    out: dict[str, list[str]] = {}
    for kinds in IDENTITY.values():
        for groups in kinds.values():
            for group in groups:
                for form, name in enumerate(group):
                    out.setdefault(name, [other[form] for other in groups if other is not group])
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def word_features(names: pa.Array) -> np.ndarray:
    """Features of each distinct word, one column per kind, -1 where there is none.

    Only letters count; a word's punctuation and digits are left out.
    """
    points, bounds = lowered(names)
    letters = letter_table()[points]
    row = np.repeat(np.arange(len(names)), np.diff(bounds))[letters]
    c = points[letters].astype(np.uint64)
    at = np.searchsorted(row, np.arange(len(names) + 1))
    length = np.diff(at)
    out = np.full((len(names), len(PREFIXES) + 1), -1, np.int64)
    place = np.arange(len(c)) - at[:-1][row] if len(c) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        power = _powers(int(length.max()) if len(length) else 0)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * power[place], dtype=np.uint64)])
        for k, n in enumerate((*PREFIXES, 0)):
            upto = at[:-1] + n if n else at[1:]
            real = (length >= n) & (length > 0)
            h = run[np.minimum(upto, at[1:])] - run[at[:-1]]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1))
            out[real, k] = (((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS))[real].astype(np.int64)
    return out


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[1], np.full(max(n, 1), 0x5851F42D4C957F2D, np.uint64)]).astype(np.uint64), dtype=np.uint64)


def _pairs(values: pa.Array, table: np.ndarray | None = None):
    """(row, feature) once each, ordered by row; with a table only features it maps to 0 or more, mapped."""
    raw, offsets = flat(values)
    words = Words(raw, offsets)
    codes, names = words.coded(lower=True)
    features = word_features(names)
    if table is not None:
        features = np.where(features >= 0, table[features], -1)
        hit = (features >= 0).any(axis=1)[codes] if len(codes) else np.zeros(0, bool)
        codes, row = codes[hit], words.row[hit]
    else:
        row = words.row
    width = (int(features.max()) if features.size else 0) + 1
    once = distinct(row * max(len(names), 1) + codes) if len(codes) else np.zeros(0, np.int64)
    row, codes = once // max(len(names), 1), once % max(len(names), 1)
    mine = features[codes] if len(codes) else features[:0]
    key = distinct((row[:, None] * width + mine)[mine >= 0])
    return key // width, key % width, words.rows


class _Names:
    """The group names, their features, and where a text has them."""

    def __init__(self):
        self.others = exchanges()
        self.names = list(self.others)
        self.features = dict(zip(self.names, word_features(pa.array([n.encode() for n in self.names], pa.large_binary())), strict=True))
        self.whole = np.zeros(1 << BITS, bool)  # features of whole names
        self.whole[[f[-1] for f in self.features.values()]] = True

    def among(self, words: pa.Array, features: np.ndarray) -> dict[int, str]:
        """Number of each distinct word that is a group's name, punctuation aside, and the name."""
        found = {}
        for k in np.flatnonzero((features[:, -1] >= 0) & self.whole[features[:, -1]]).tolist():
            letters = "".join(c for c in words[k].as_py().decode(errors="replace") if c.isalpha()).lower()
            if letters in self.others:
                found[k] = letters
        return found


_NAMES: list[_Names] = []


def names() -> _Names:
    if not _NAMES:
        _NAMES.append(_Names())
    return _NAMES[0]


def counterfactuals(values: pa.Array) -> dict[int, list[np.ndarray]]:
    """For each row that names groups: the features of its text with one of them exchanged for another, in all ways."""
    words = Words(*flat(values))
    codes, distinct_words = words.coded(lower=True)
    features = word_features(distinct_words)
    known = names()
    named = known.among(distinct_words, features) if len(distinct_words) else {}
    out = {}
    for row in np.unique(words.row[np.isin(codes, list(named))]).tolist() if named else ():
        own = distinct(codes[words.first[row] : words.first[row + 1]])
        mine = {k: named[k] for k in own.tolist() if k in named}
        for name in sorted(set(mine.values())):
            rest = features[[k for k in own.tolist() if mine.get(k) != name]].reshape(-1)
            for other in known.others[name]:
                both = distinct(np.concatenate([rest, known.features[other]]))
                out.setdefault(row, []).append(both[both >= 0])
    return out


def _featured(batches):
    for batch in slices(batches):
        values = column(batch, "text")
        row, feature, rows = _pairs(values)
        at = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32)))
        swapped = counterfactuals(values)
        swapped = pa.array([[x.tolist() for x in swapped.get(k, ())] for k in range(rows)], pa.list_(pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([column(batch, "toxic"), lists, swapped], names=["toxic", "features", "swapped"])


@dataclass
class Model:
    table: np.ndarray  # feature -> place among the weights, or -1
    weights: np.ndarray
    bias: float


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, features, features of the counterfactuals) of the sample: labelled rows outside the held-out fold, chosen by a hash of the id."""
    ids = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
        .orderBy(F.xxhash64(F.lit("toxicity"), F.col("labelled_id")), "labelled_id")
        .limit(SAMPLE)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"))  # SAMPLE rows at most
    return mapped(chosen.select("text", "toxic"), _featured, "toxic int, features array<int>, swapped array<array<int>>")


def fit(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY) -> Model:
    sample = write_scratch(labelled(docs, labels), "labelled")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    neg, pos = n.get(0, 0), n.get(1, 0)
    table = np.full(1 << BITS, -1, np.int32)
    if not neg or not pos:
        share = min(max(pos / max(neg + pos, 1), 1e-6), 1 - 1e-6) if neg + pos else 1e-6
        return Model(table, np.zeros(1), float(np.log(share / (1 - share))))
    counts = sample.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg(
        F.sum("toxic").alias("p"), F.count("*").alias("n")
    )
    gap = F.col("p") * neg - (F.col("n") - F.col("p")) * pos
    chi = gap * gap / (F.col("n").cast("double") * (neg + pos + 1 - F.col("n")))
    best = [r.feature for r in counts.where("n >= 5").orderBy(chi.desc(), "feature").limit(FEATURES).collect()]
    groups = [int(f) for row in names().features.values() for f in row if f >= 0]
    for f in dict.fromkeys([*best, *groups]):
        table[f] = table.max() + 1
    known = F.array(*[F.lit(int(f)) for f in np.flatnonzero(table >= 0)])
    rows = sample.select(
        "toxic", F.array_intersect("features", known).alias("features"), F.transform("swapped", lambda s: F.array_intersect(s, known)).alias("swapped")
    ).collect()
    return Model(*_learned(rows, table, penalty))


def _learned(rows, table, penalty):
    size = int(table.max()) + 1
    places = lambda features: sorted(int(x) for x in table[np.asarray(features, int)])
    data = sorted((places(r.features), r.toxic, [places(s) for s in r.swapped]) for r in rows)
    order = np.random.default_rng(11)
    model = Ftrl(1, size + 1, ALPHA, BETA, L1, L2)
    for _ in range(EPOCHS):
        for i in order.permutation(len(data)):
            features, y, swapped = data[i]
            at = np.array([*features, size])
            w = model.weights(at)
            model.update(at, np.full((1, len(at)), 1 / (1 + np.exp(-w.sum())) - y), w)
            if swapped and penalty:
                at, sign = difference(features, swapped[int(order.integers(len(swapped)))])
                w = model.weights(at)
                model.update(at, penalty * 2 * (w[0] @ sign) * sign[None, :], w)
    w = model.weights()[0]
    return table, w[:size].copy(), float(w[size])


def difference(features, other) -> tuple[np.ndarray, np.ndarray]:
    """Places that only one of two texts has, with 1 for the first one's and -1 for the other's."""
    gone, come = sorted(set(features) - set(other)), sorted(set(other) - set(features))
    return np.array([*gone, *come], int), np.array([1.0] * len(gone) + [-1.0] * len(come))


def scored(values: pa.Array, model: Model) -> np.ndarray:
    row, place, rows = _pairs(values, model.table)
    total = np.bincount(row, model.weights[place] if len(place) else None, minlength=rows)
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -50, 50)))


def swapped_scores(values: pa.Array, model: Model) -> pa.Array:
    """The mean score of each text's counterfactuals, null where it names no group."""
    out: list[float | None] = [None] * len(values)
    for row, texts in counterfactuals(values).items():
        places = [model.table[x] for x in texts]
        total = np.array([model.weights[p[p >= 0]].sum() for p in places]) + model.bias
        out[row] = float((1 / (1 + np.exp(-np.clip(total, -50, 50)))).mean())
    return pa.array(out, pa.float64())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, swapped_score) of every document; the last is null where no group is named."""
    # Features without weight are left out: most words then have none.
    table = model.table.copy()
    used = table >= 0
    table[used] = np.where(model.weights[table[used]] != 0, table[used], -1)
    lean = Model(table, model.weights, model.bias)

    def run(batches):
        for batch in slices(batches):
            values = column(batch, "text")
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()), pa.array(scored(values, lean)), swapped_scores(values, lean)], names=["doc_id", "score", "swapped_score"]
            )

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, score double, swapped_score double")
