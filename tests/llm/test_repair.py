import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanlake.llm import repair as R
from spanlake.session import scratch_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(R.tokenizer_path())


TEXTS = [
    "The CAT sat, the cat sat!! it's dogs' don't we'll", None, "", "  \t\n", "É été ÉTÉ İstanbul ΣΑΣ straße ẞ", "a<|endoftext|>B <|ENDOFTEXT|> c", "##x# ## #",
    "non breaking space em\u0085nel", "é Á combine", "12345 a1b2 (x), [y]... \"quoted\" foo), bar'", "☃️ 👩‍👩‍👧 中文 字", "x" * 5000, "word " * 3000, "tab\x1csep\x0bvt",
]


def test_encoder_equals_the_library(tokenizer):
    ids, at = R.Encoder(R.tokenizer_path()).encode(pa.array(TEXTS, pa.string()))
    for i, text in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_equals_the_library_on_documents(tokenizer):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    ids, at = R.Encoder(R.tokenizer_path()).encode(pa.array(texts, pa.string()))
    for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


@pytest.mark.parametrize("seed", range(12))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 40, 30)
    ids = rng.integers(0, [2, 5, 50][seed % 3], sizes.sum())
    docs = np.concatenate([[0], np.cumsum(sizes)])
    rules, lengths, symbols, starts = R.compress(ids, docs, 50, least=2)
    shard = R.Shard.__new__(R.Shard)
    shard.set(np.arange(50), rules, lengths, symbols, starts, sizes)
    assert shard.all().tolist() == ids.tolist()
    for k in range(30):
        want = ids[docs[k] : docs[k + 1]]
        assert shard.document(k).tolist() == want.tolist()
        for lo in range(0, len(want), 7):
            assert shard.ids(k, lo, min(lo + 5, len(want))).tolist() == want[lo : lo + 5].tolist()
    for (a, b), n in zip(rules, lengths):
        assert len(shard.expand(np.array([a, b]))) == n
    stored = R.Shard(R.packed(ids + 49_000, docs, 49_408))
    assert stored.all().tolist() == (ids + 49_000).tolist()


def test_frequent_pairs_shrink_a_shard():
    ids = np.tile([1, 2, 3, 4, 1, 2, 9], 2000)
    rules, _, symbols, _ = R.compress(ids, np.array([0, len(ids)]), 50, least=2)
    assert len(symbols) < 30 and len(rules) < 60
    assert len(R.compress(ids, np.arange(len(ids) + 1), 50, least=2)[0]) == 0  # no pair reaches over an end


def pairs_left(symbols, starts):
    """Occurrences of each pair inside documents."""
    found = Counter()
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        row = symbols[lo:hi].tolist()
        found.update(zip(row, row[1:]))
    return found


def test_production_bounds():
    """Every pair of LEAST or more occurrences is replaced, and what is left is 0.6 of the ids or less."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    ids, at = R.Encoder(R.tokenizer_path()).encode(texts)
    rules, lengths, symbols, starts = R.compress(ids, at, 49_408)
    assert max(pairs_left(symbols, starts).values()) < 2 * R.LEAST  # a row of equal pairs counts twice
    assert len(symbols) + len(rules) <= 0.62 * len(ids)


def test_words_are_remembered_in_two_generations(monkeypatch, tokenizer):
    monkeypatch.setattr(R, "REMEMBERED", 5)
    encoder = R.Encoder(R.tokenizer_path())
    texts = [f"often word{i} Été{i}, naïveté ÷ ×x don't 'S it's! straßé ŁÓDŹ" for i in range(30)] + ["often"]
    ids, at = encoder.encode(pa.array(texts))
    for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids
    assert len(encoder.known) <= 6 and len(encoder.earlier) <= 6


def test_files_round_trip(spark, tokenizer):
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS * 3)] + [(None, "null id"), (4, "twice"), (4, "twice")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, part int").repartition(5)
    path = scratch_path(spark, "test-shards")
    R.write(docs, path, shard=500)
    got = R.read(spark, path).collect()
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got), key=lambda x: x[1]) == want


def test_empty_table(spark):
    path = scratch_path(spark, "test-shards")
    R.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert R.read(spark, path).count() == 0
