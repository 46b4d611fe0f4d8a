import numpy as np
import pyarrow as pa
import pytest
from brute import crc

from spanlake.llm import toxicity as T


def corpus(spark, n=3000, identity=0.0):
    """Neutral words; toxic rows have an insult. ``identity``: share of toxic rows that also name one group."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = list(rng.choice(vocabulary, 40))
        if toxic:
            w[int(rng.integers(40))] = str(rng.choice(["grumbus", "Blorf!", "snarfling"]))
            if rng.random() < identity:
                w[3] = "gay"
        elif rng.random() < 0.02:
            w[3] = str(rng.choice(["gay", "straight"]))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r.score for r in T.score(docs, T.fit(docs, labels)).collect()}
    held = [d for d in got if crc(d) % 5 == 0]
    assert sum((got[d] >= 0.5) == (d % 5 == 0) for d in held) / len(held) > 0.99


def test_labels_of_held_out_rows_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs, labels = corpus(spark, 600)
    other = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(T.score(docs, T.fit(docs, x)).collect()) for x in (labels, other))
    assert a == b


def test_penalty_closes_the_gap_between_groups(spark):
    docs, labels = corpus(spark, identity=0.6)
    probe = pa.array([f"{g} people sing" for g in ("gay", "straight", "queer")])
    gaps = {}
    for penalty in (0.0, 1.0):
        s = T.scored(probe, T.fit(docs, labels, penalty))
        gaps[penalty] = float(s.max() - s.min())
    assert gaps[1.0] < 0.25 * gaps[0.0]


def test_neutral_mentions_are_no_toxicity(spark):
    """Groups are named mostly in toxic rows; held-out rows that only mention one are then flagged without the penalty."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    docs, labels = [], []
    for i in range(2500):
        w = list(rng.choice(vocabulary, 12))
        toxic = i % 4 == 0
        if toxic:
            w[5] = "gay" if rng.random() < 0.7 else "plain"
            w[7] = str(rng.choice(["grumbus", "blorf"])) if rng.random() < 0.6 else w[7]
        elif rng.random() < 0.5:
            w[5] = "gay" if rng.random() < 0.03 else str(rng.choice(["straight", "queer", "lesbian"]))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    neutral = pa.array([" ".join([*rng.choice(vocabulary, 11), name]) for name in ("gay", "queer", "straight") for _ in range(60)])
    wrong = {penalty: float((T.scored(neutral, T.fit(docs, labels, penalty)) >= 0.5).mean()) for penalty in (0.0, 1.0)}
    assert wrong[0.0] > 0.2 and wrong[1.0] < 0.5 * wrong[0.0]


def swapped_texts(text):
    """Every text with one named group exchanged, by words."""
    others = T.exchanges()
    letters = lambda w: "".join(c for c in w if c.isalpha()).lower()
    found = sorted({letters(w) for w in text.split()} & set(others))
    return [" ".join(o if letters(w) == name else w for w in text.split()) for name in found for o in others[name]]


def test_counterfactuals_are_those_of_the_exchanged_text(spark):
    """The difference that the penalty holds down is that of the scores of both texts."""
    texts = [
        "many which white man manner Muslim, (muslims) write", "women and men: Man! mandate", "les femmes chrétiennes et un chrétien", "nobody here", None, "",
        "ein Mann, viele Männer und Frauen", "árabe africana judío JUDÍOS", "man", "gay straight gay's whitewash",
    ]
    rng = np.random.default_rng(3)
    model = T.Model(np.arange(1 << T.BITS), rng.normal(size=1 << T.BITS), 0.25)
    logit = lambda values: np.log(T.scored(values, model) / (1 - T.scored(values, model)))
    found = T.counterfactuals(pa.array(texts))
    mean = T.swapped_scores(pa.array(texts), model).to_pylist()
    for row, text in enumerate(texts):
        want = swapped_texts(text or "")
        assert len(found.get(row, [])) == len(want)
        if not want:
            assert mean[row] is None
            continue
        own, _, _ = (x for x in T._pairs(pa.array([text])))
        features = T._pairs(pa.array([text]))[1].tolist()
        gaps = []
        for other in found[row]:
            at, sign = T.difference(features, other.tolist())
            gaps.append(float(model.weights[at] @ sign))
        brute = logit(pa.array([text] * len(want))) - logit(pa.array(want))
        assert sorted(gaps) == pytest.approx(sorted(brute.tolist()), abs=1e-6)
        assert sum(g * g for g in gaps) == pytest.approx(float((brute**2).sum()), abs=1e-5)
        assert mean[row] == pytest.approx(float(T.scored(pa.array(want), model).mean()))


def test_names_are_exchanged_within_kind_language_and_form():
    others = T.exchanges()
    assert "musulman" not in others["muslim"] and "christian" in others["muslim"] and "christians" in others["muslims"]
    assert others["frauen"] == ["männer"] and others["men"] == ["women"] and all(name not in o for name, o in others.items())


def test_features_of_words():
    f = T.word_features(pa.array([b"abcdef", b"ABCDEF.", b"ab", b"abcxyz", b"", b"!!", "é1éé".encode()], pa.large_binary()))
    assert (f[0] == f[1]).all() and f[0, 0] == f[3, 0] and f[0, 1] != f[3, 1]
    assert (f[2, :3] == -1).all() and f[2, 3] >= 0
    assert (f[4] == -1).all() and (f[5] == -1).all() and f[6, 0] >= 0 and f[6, 1] == -1


def test_edge_rows(spark):
    docs, labels = corpus(spark, 400)
    rows = [(900, None, "x"), (901, "", "x"), (None, "grumbus words", "x"), (902, "grumbus " * 30_000, "x"), (903, "x" * 40_000, "x"), (903, "x" * 40_000, "x")]
    more = docs.union(spark.createDataFrame(rows, docs.schema))
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (900, 1, None), (5, 0, 1), (12345, 1, 1)], labels.schema))
    model = T.fit(more, odd)
    got = {}
    for r in T.score(more, model).collect():
        got.setdefault(r.doc_id, set()).add(r.score)
    assert got[900] == got[901] and len(got[903]) == 1
    assert all(0 <= s <= 1 for v in got.values() for s in v)
    assert T.score(more.limit(0), model).count() == 0
    none = T.fit(more, odd.limit(0))
    assert [r.score for r in T.score(more, none).collect()] == [pytest.approx(1e-6)] * more.count()
