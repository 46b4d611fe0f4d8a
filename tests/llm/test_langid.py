import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import crc
from pyspark.sql import functions as F

from spanlake.llm import langid as L
from spanlake.llm.arrays import letter_table

DOCS = "/root/testdata/sf0.01/documents.parquet"


def slow_features(text):
    """Feature counts of one text by the definition."""
    c = [ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in text or ""]
    letters = [chr(x).isalpha() for x in c]
    c = [x if ok else 32 for x, ok in zip(c, letters)]
    out = {}
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            if (n == 1 and not letters[i]) or (n > 1 and not (letters[i] or letters[i + 1])):
                continue
            h = 0
            for x in c[i : i + n]:
                h = (h * 0x01000193 + x) & 0xFFFFFFFF
            h = ((h + n) * 2654435761 & 0xFFFFFFFF) >> (32 - L.BITS)
            out[h] = out.get(h, 0) + 1
    return out


def test_ngrams_against_the_definition():
    texts = ["Abc dé.", None, "", "1 2 3", "x", "ÄÖ ß", "a  b", "中文", "ab" * 50]
    grams, offsets, has = L.ngrams(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        n = np.bincount(np.concatenate([g[offsets[i] : offsets[i + 1]] for g in grams]), minlength=L.SIZE + 1)[: L.SIZE]
        assert {k: int(n[k]) for k in np.flatnonzero(n)} == slow_features(text), text
        assert has[i] == any(x.isalpha() for x in text or "")
    assert letter_table()[ord("é")] and not letter_table()[ord("5")]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: r for r in L.predict(docs, L.fit(docs)).collect()}
    lang = dict(zip(*(pq.read_table(DOCS).column(c).to_pylist() for c in ("doc_id", "lang"))))
    held = [d for d in lang if crc(d) % 4 == 2]
    assert len(held) > 200
    assert sum(got[d].lang_pred == lang[d] for d in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    flags = {r.doc_id: r.h for r in docs.select("doc_id", L.held_out(F.col("doc_id")).alias("h")).collect()}
    assert {d for d, h in flags.items() if h} == set(held)


def test_held_out_languages_are_not_learned(spark):
    rows = [(d, "the words of it" if crc(d) % 4 == 2 else "der die das und", "held" if crc(d) % 4 == 2 else "de") for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit(docs).langs == ["de"]


def test_rare_and_many_languages_are_learned(spark, monkeypatch):
    """Greek is 0.14 % of the rows; of 12 languages, in the table's order, each gets its share of the sample."""
    rows = [(d, f"the words of it {d}", "en") for d in range(28_000)] + [(100_000 + d, f"και το λέξεις {'αβγδε'[d % 5]}", "el") for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.langs == ["el", "en"]
    assert {r.lang_pred for r in L.predict(docs.where("lang = 'el'"), model).collect()} == {"el"}
    monkeypatch.setattr(L, "SAMPLE", 120)
    many = spark.createDataFrame([(i, f"word{chr(97 + i // 50) * 4}", f"l{i // 50:02}") for i in range(600)], docs.schema).coalesce(1)
    seen = []
    monkeypatch.setattr(L, "learned", lambda langs, sample, idf: seen.append((langs, [s[0] for s in sample])))
    L.fit(many)
    L.fit(many.repartition(7))
    assert seen[0] == seen[1]
    assert {k: seen[0][1].count(k) for k in seen[0][0]} == {f"l{i:02}": 10 for i in range(12)}


def test_edge_rows(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "12 34 !!", "en", 1.0), (None, "plain words", None, 1.0), (4, "plain words " * 40_000, "en", 1.0), (5, "der die das", "de", 1.0), (5, "der die das", "de", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = L.predict(docs, L.fit(docs)).collect()
    assert sorted(r.lang_pred for r in got if r.doc_id in (1, 2, 3)) == ["und"] * 3
    assert all(r.lang_pred in ("en", "de") for r in got if r.doc_id not in (1, 2, 3))
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 5}) == 1
    empty = docs.limit(0)
    assert L.fit(empty) is None and L.predict(empty, None).count() == 0 and L.keep(empty).count() == 0
    assert {(r.lang_pred, r.score) for r in L.predict(docs, None).collect()} == {("und", 0.0)}
    kept = L.keep(docs, 0.0)
    assert kept.schema == docs.schema and kept.count() == 4


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=L.softmax(row / 2.5)) for row in logits])
    assert L.temperature(logits, y) == pytest.approx(2.5, rel=0.15)
    assert L.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1
    sure = np.where(np.arange(3) == np.zeros(50, int)[:, None], 9.0, 0.0)
    assert L.softmax(sure / L.temperature(sure, np.zeros(50, int)))[:, 0].mean() < 0.999
