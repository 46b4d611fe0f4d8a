"""Near words against all pairs of words, and the numbered query's contract done directly."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanlake.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0 and doc_id is not None:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}


def expected(n):
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return sorted(out)


def misspelt(rng, word):
    k, c = rng.randrange(len(word)), rng.choice("aeénß")
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]])


def texts(seed, n_words=12, size=3000):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeinrsté") for _ in range(rng.randint(6, 12))) for _ in range(n_words)] + ["aaaaaaaa", "aaaaaaa"]
    weights = [3.0 ** -(k % 6) for k in range(len(base))]
    out = []
    for i in range(40):
        chosen = rng.choices(base, weights, k=size // 40)
        chosen = [misspelt(rng, w) if rng.random() < 0.1 else w for w in chosen]
        chosen = [misspelt(rng, w) if rng.random() < 0.02 else w for w in chosen]
        out.append((i * 17, rng.choice([" ", "-", "1", "ć"]).join(w.upper() if rng.random() < 0.1 else w for w in chosen)))
    return out


@pytest.mark.parametrize(("seed", "shard"), [(1, 40_000), (2, 20), (3, 3)])
def test_forms(spark, seed, shard):
    rows = [*texts(seed), (None, "Unbekannte unbekannte unbekannte"), (5, None), (6, ""), (6, "1 2 3"), *texts(seed)[:2]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    words = variants.counts(docs, modulus=31)
    assert {r["word"]: r["n"] for r in words.collect()} == counted(rows)
    out = variants.forms(words, shard=shard).select("word", "n", "n_near", "form", "form_n", "root")
    want = expected(counted(rows))
    assert sorted(map(tuple, out.collect())) == want
    assert sum(r[3] is not None for r in want) > 20


def test_chains_of_forms(spark):
    words = spark.createDataFrame([("abcdefg", 100_000), ("abcdefgh", 9_000), ("abcdefghi", 700), ("abcdefghij", 60), ("abcdefghijk", 5), ("bcdefghijk", 2), ("xabcdefg", 100_000)], "word string, n long")
    out = {r["word"]: r["root"] for r in variants.forms(words).collect()}
    assert out["abcdefghijk"] == out["abcdefghij"] == out["abcdefgh"] == "abcdefg"
    assert out["bcdefghijk"] == "bcdefghijk" and out["xabcdefg"] == "xabcdefg"


def test_tables_without_words(spark):
    for rows in ([], [(1, None), (2, "short words only")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert variants.forms(variants.counts(docs, modulus=31)).count() == 0


def test_long_words(spark):
    long = "ab" * 3_000
    docs = spark.createDataFrame([(None, f"{long} {long} {long}c {long}c {long[1:]}d {long[1:]}d")], "doc_id long, text string")
    out = {r["word"]: r["n_near"] for r in variants.forms(variants.counts(docs)).collect()}
    assert out == {long: 1, long + "c": 1, long[1:] + "d": 0}


def test_both_searches_on_random_vocabularies():
    rng = random.Random(4)
    for _ in range(60):
        letters = b"abcd"[: rng.randint(1, 4)]
        words = sorted({bytes(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(rng.choice([1, 2, 30, 120]))})
        rng.shuffle(words)
        size = np.array([len(w) for w in words])
        turned = [w[::-1] for w in words]
        pairs = [variants.search(variants.Ranks(face), face, exact) for face, exact in ((words, size // 2), (turned, size - size // 2))]
        got = {(words[i], words[j]) for a, b in pairs for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == {(x, y) for x in words for y in words if x != y and is_near(x, y)}


def test_joined_checksums():
    a, b = [b"12:", b"999:", b"x"], [b"hello", b"", b"abcdefghij" * 90]
    crc = lambda parts: np.array([zlib.crc32(x) for x in parts], np.uint32)
    out = variants.Shift().joined(crc(a), crc(b), np.array([len(x) for x in b]))
    assert out.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]
