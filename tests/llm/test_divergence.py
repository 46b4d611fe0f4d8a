import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import base, words

from spanlake.llm import divergence as D

EDGE = [
    None, "", "\n\n", "a", "a b c d e f g h i j", "a b c d e\na b c d e\n", "x\nx\n\nx", "one two three four five " * 3, "é ☃ ü " * 10, "  lead\ttab\x0bvt  ", "#*$%&|<>", "same line\nsame line\nsame line",
    "a b c d e f a b c d e", "word " * 20_000, "x" * 50_000, "l1\r\nl1\r\n",
]


def counts(texts):
    found = D.judged(pa.array(texts, pa.string()), {})
    return [tuple(found[b][i].item() for b in D.BASE) + (bool(found["base_failed"][i]),) for i in range(len(texts))]


def test_base_counts_against_brute_force():
    assert counts(EDGE) == [base(t) for t in EDGE]
    assert counts(EDGE[::-1]) == [base(t) for t in EDGE[::-1]]


@pytest.mark.parametrize("seed", range(5))
def test_base_counts_on_random_texts(seed):
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("ab \n#é"), rng.integers(0, 80))) for _ in range(60)]
    assert counts(texts) == [base(t) for t in texts]


def test_base_counts_on_documents():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    assert counts(texts) == [base(t) for t in texts]


def test_distance():
    p, q = np.array([[0.5, 0.5, 0], [1, 0, 0], [0, 0, 1]]), np.array([0.5, 0.5, 0])
    d = D.distance(p, q)
    assert d[0] == 0 and d[2] == pytest.approx(1)
    m = 0.5 * (np.array([1, 0]) + 0.5)
    assert d[1] == pytest.approx(np.sqrt(0.5 * (np.log2(1 / m[0]) + 0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1]))))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    en = ["the", "of", "and", "to", "in", *(f"en{i}" for i in range(200))]
    de = ["der", "die", "und", "in", "zu", *(f"wört{i}" for i in range(200))]
    draw = lambda v, n: " ".join(rng.choice(v, n, p=[0.08] * 5 + [0.6 / 200] * 200))
    rows = [(i, draw(en if i % 3 else de, 150), ("en" if i % 3 else "de") if i % 10 else None, "s") for i in range(120)]
    rows += [(200 + i, " ".join(w + "%%%" for w in draw(en, 150).split()), "en", "s") for i in range(20)]
    rows += [(300 + i, " | ".join(f"q{rng.integers(9999)}" for _ in range(150)), "en", "s") for i in range(10)]
    rows += [(400, "the of and to in the of and to in", "en", "s"), (401, None, None, None), (402, "", "xx", "s"), (0, rows[0][1], "de", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")


def test_verdicts_and_references(corpus):
    refs = D.references(corpus)
    assert set(refs) == {"en", "de", "und"}
    assert refs["en"][1][:5] != refs["de"][1][:5] and b"the" in refs["en"][1]
    assert all(len(s) == len(c) + 1 and s.sum() == pytest.approx(1) for _, c, s in refs.values())
    got = {r.doc_id: r for r in D.score(corpus).collect()}
    for i, r in got.items():
        assert r.kept == (i < 200), i
    assert got[401].base_failed and got[402].base_failed and got[400].base_failed


def test_text_without_common_words_fails():
    """Two texts with the same counts of letters and blanks: only one of them has the language's common words."""
    rng = np.random.default_rng(5)
    common = ["the", "of", "and", "to", "in"]
    prose = rng.choice([*common, *(f"longer{chr(97 + i)}" for i in range(20))], 300, p=[0.066] * 5 + [0.67 / 20] * 20).tolist()
    salad = [{"the": "xqv", "of": "zk", "and": "vwx", "to": "qj", "in": "kz"}.get(w, w) for w in prose]
    kinds = D.Texts(pa.array([" ".join(prose)])).classes[0]
    refs = {"en": (kinds / kinds.sum(), [w.encode() for w in common], np.array([0.066] * 5 + [0.67]))}
    found = D.judged(pa.array([" ".join(t) for t in (prose, salad, salad[:50])]), refs)
    assert found["class_distance"][:2].max() < 1e-6 and found["word_distance"].max() < D.MAX_WORD
    assert not found["base_failed"].any()
    assert found["kept"].tolist() == [True, False, True]  # the last has too few words to tell


def test_keep_has_all_columns_and_whole_rows(corpus):
    kept = D.keep(corpus)
    assert kept.schema == corpus.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted([0, *range(120)])


def test_keep_leaves_out_single_numbers_and_tokens(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "and", "to", "in", *(f"longer{chr(97 + i)}" for i in range(20))]
    draw = lambda n: rng.choice(vocabulary, n, p=[0.066] * 5 + [0.67 / 20] * 20).tolist()
    token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    short = draw(40)
    texts = [" ".join(draw(150)) for _ in range(100)]
    texts += [" ".join([*short[:20], *more, *short[20:]]) for more in ([token], [token, "1232810148878564", "+1", "(826)", "555-4081"])]
    texts += [" ".join(w for x in short for w in (x, f"{rng.integers(10**9, 10**10)}")), " | ".join(short) + " | $ % & # " * 10 + token]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert [d.kept for d in D.score(docs).collect() if d.doc_id >= 100] == [False] * 4
    assert {d.doc_id for d in D.keep(docs).collect()} == set(range(102))


def test_minor_languages_are_kept(spark):
    """Greek has 0.7 % of the words, Georgian a few texts only."""
    rng = np.random.default_rng(4)
    latin = ["the", "of", "and", "to", "in", *(f"longer{chr(97 + i)}" for i in range(20))]
    greek = ["και", "το", "να", "του", "με", *(f"λέξεις{chr(0x3B1 + i)}" for i in range(20))]
    georgian = [f"სიტყვა{chr(0x10D0 + i)}" for i in range(25)]
    draw = lambda v, n: " ".join(rng.choice(v, n, p=[0.066] * 5 + [0.67 / 20] * 20))
    rows = [(i, draw(latin, 8_000), "en") for i in range(100)] + [(1000 + i, draw(greek, 200), "el") for i in range(28)]
    rows += [(2000 + i, draw(georgian, 100), "ka") for i in range(3)] + [(3000, "| % $ # " * 100, "el"), (3001, "few " * 300, "ka")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {d for d, *_ in rows if d < 3000}
    assert set(D.references(docs)) == {"en", "el"}
    assert {d.doc_id for d in D.score(docs).collect() if d.kept} == want
    assert {d.doc_id for d in D.keep(docs).collect()} == want


def test_empty_and_untagged_tables(spark, corpus):
    assert D.score(corpus.limit(0)).count() == 0 and D.keep(corpus.limit(0)).count() == 0
    only = spark.createDataFrame([(1, "too short", None, "s")], corpus.schema)
    assert [(r.base_failed, r.kept, r.nearest) for r in D.score(only).collect()] == [(True, False, None)]


def test_references_count_all_documents(corpus):
    """Shares of common words equal a plain count over the documents that the first round passes."""
    first = D._round(corpus, {})
    n, hits = 0, 0
    for r in corpus.where("lang = 'en'").collect():
        w = words(r.text)
        if len(w) >= 10:
            n += len(w)
            hits += w.count("the")
    common, share = first["en"][1], first["en"][2]
    assert share[common.index(b"the")] == pytest.approx(hits / n)
