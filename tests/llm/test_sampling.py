import numpy as np
import pyarrow as pa
import pytest

from spanlake.llm import sampling as S
from spanlake.llm.arrays import flat


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.load(S.model_path())


def enumerate_all(text, vocabulary):
    """ids -> probability of every segmentation, by recursion over the bytes."""
    data = b" " + text.encode() if text else b""
    logs = {}
    for _, ids, weights, _ in vocabulary.by_length.values():
        logs |= {vocabulary.text[i]: (int(i), float(w)) for i, w in zip(ids, weights)}
    starts = [i for i in range(len(data)) if data[i] & 0xC0 != 0x80] + [len(data)]
    out = []

    def go(i, ids, log):
        if i == len(data):
            out.append((tuple(ids), log))
            return
        for j in starts:
            if j > i and data[i:j] in logs:
                x, w = logs[data[i:j]]
                go(j, [*ids, x], log + w)
        j = next(s for s in starts if s > i)
        if data[i:j] not in logs:
            go(j, [*ids, *(int(vocabulary.byte[b]) for b in data[i:j])], log + (j - i) * vocabulary.byte_log)

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {ids: np.exp(w - total) for ids, w in out}


def run(texts, vocabulary, k, keys=None, seed=1):
    keys = np.arange(len(texts)) if keys is None else keys
    found, data, bounds = S.sampled(pa.array(texts, pa.string()), np.asarray(keys), vocabulary, k, seed)
    rows = [[] for _ in texts]
    for have, at, ids, log_prob, value, inclusion in found:
        for i, r in enumerate(have):
            rows[r].append((tuple(int(x) for x in ids[at[i] : at[i + 1]]), log_prob[i], value[i], inclusion[i]))
    return rows


def test_samples_are_distinct_ordered_and_have_exact_probabilities(vocabulary):
    texts = ["the cat", "a", "", None, "été\nüß  x", "☃ zz", "other words, here"]
    for text, samples in zip(texts, run(texts, vocabulary, 4)):
        exact = enumerate_all(text or "", vocabulary)
        assert len(samples) == min(4, len(exact))
        assert len({s[0] for s in samples}) == len(samples)
        assert [s[2] for s in samples] == sorted((s[2] for s in samples), reverse=True)
        for ids, log_prob, _, inclusion in samples:
            assert np.exp(log_prob) == pytest.approx(exact[ids], rel=1e-6)
            assert 0 < inclusion <= 1


def test_sampling_frequencies_follow_without_replacement_probabilities(vocabulary):
    n = 6000
    exact = enumerate_all("cat", vocabulary)
    rows = run(["cat"] * n, vocabulary, 2, keys=np.arange(n))
    first = {}
    pairs = {}
    for a, b in (r[:2] for r in rows):
        first[a[0]] = first.get(a[0], 0) + 1
        pairs[a[0], b[0]] = pairs.get((a[0], b[0]), 0) + 1
    for ids, p in exact.items():
        assert first.get(ids, 0) / n == pytest.approx(p, abs=4.5 * np.sqrt(p / n) + 1e-3)
    for (a, b), c in pairs.items():
        p = exact[a] * exact[b] / (1 - exact[a])
        assert c / n == pytest.approx(p, abs=4.5 * np.sqrt(p / n) + 1e-3)


def test_inclusion_scores_weigh_without_bias(vocabulary):
    """The sum of f(s) p(s) / inclusion(s) over the samples estimates the mean of f."""
    exact = enumerate_all("cat", vocabulary)
    n = 5000
    rows = run(["cat"] * n, vocabulary, 3, keys=np.arange(n))
    mean = np.mean([sum(len(ids) * np.exp(lp) / q for ids, lp, _, q in r) for r in rows])
    assert mean == pytest.approx(sum(len(ids) * p for ids, p in exact.items()), rel=0.02)


def test_rows_do_not_depend_on_their_neighbours(vocabulary):
    alone = run(["the other cat"], vocabulary, 3, keys=[7])[0]
    among = run(["x", "the other cat", "long " * 50], vocabulary, 3, keys=[1, 7, 9])[1]
    assert [a[0] for a in alone] == [b[0] for b in among]


def test_long_and_repeated_texts(vocabulary):
    text = "unbroken" * 400
    rows = run([text, text, "word " * 4000], vocabulary, 3, keys=[5, 5, 6])
    assert [s[0] for s in rows[0]] == [s[0] for s in rows[1]]
    assert [s[1] for s in rows[0]] == [s[1] for s in rows[1]]
    assert all(len({s[0] for s in r}) == 3 for r in rows)


def test_round_trip_and_edge_rows(spark):
    texts = ["the cat", None, "", " lead", "été\nüß\t☃", "x" * 3000, "the cat"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "null key", 1, 2)], "doc_id long, text string, ids int, sample int")
    got = S.decode(S.sample(docs, k=2)).collect()
    want = dict(enumerate(texts)) | {None: "null key"}
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert r.text == (want[r.doc_id] or "")
        assert r.decoded_crc32 == r.text_crc32
    assert S.sample(docs.limit(0)).count() == 0


def test_decode_matches_the_library(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    for samples in run(["Hello there, été ☃", "two\nlines"], vocabulary, 3):
        texts = {model.decode([int(x) for x in s[0]]) for s in samples}
        assert len(texts) == 1
    ids = model.encode("Hello there, été ☃")
    data, at = S.decoded(pa.array([np.array(ids, "<u2").tobytes()], pa.binary()), vocabulary)
    assert data.tobytes().decode() == " Hello there, été ☃"
    assert flat(pa.array([b""]))[1].tolist() == [0, 0]
