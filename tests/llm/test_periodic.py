"""Runs of words against all pairs of positions, and the numbered query's contract done directly."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from brute import words

from spanlake.llm import periodic


def runs(seq, least=24, power=3):
    out = []
    for q in range(1, len(seq) // power + 1):
        i = 0
        while i + q < len(seq):
            j = i
            while j + q < len(seq) and seq[j] == seq[j + q]:
                j += 1
            n = j - i + q
            whole = seq[i : i + n]
            smaller = any(all(whole[k] == whole[k + d] for k in range(n - d)) for d in range(1, q))
            if j > i and n >= least and n >= power * q and not smaller:
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    milli = best and 1000 * best[1] // best[2]
    return (doc_id, len(found), *(best or (None,) * 3), milli, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sequence(rng):
    n, kinds = rng.randint(0, 70), rng.choice([1, 2, 3, 30])
    seq = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 2)):
        if n:
            lo = rng.randrange(n)
            hi, p = rng.randint(lo, n), rng.randint(1, 12)
            seq[lo:hi] = [seq[min(n - 1, lo + (i - lo) % p)] for i in range(lo, hi)]
    return seq


def test_runs_of_random_sequences():
    rng = random.Random(11)
    for _ in range(600):
        seq = sequence(rng)
        for least, power in ((4, 2), (7, 3), (24, 3)):
            assert periodic.runs_of(seq, least, power) == runs(seq, least, power)


def test_stretches_hold_all_runs_and_stay_in_a_row():
    rng = random.Random(12)
    for _ in range(200):
        rows = [sequence(rng) for _ in range(3)] + [[5] * 30, [5] * 30]
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        codes = np.array([x for r in rows for x in r])
        got = [(int(row[lo]), lo - int(first[row[lo]]) + s, n, q) for lo, hi in periodic.stretches(codes, row) for s, n, q in periodic.runs_of(codes[lo:hi].tolist())]
        assert sorted(got) == sorted((k, *r) for k, seq in enumerate(rows) for r in runs(seq))


def test_steps_grow_in_proportion():
    """Deep trees of suffix links cost no more per word than shallow ones."""
    steps = []
    original = periodic.Paths._rotate
    for n in (4_000, 16_000):
        count = [0]
        periodic.Paths._rotate = lambda self, x, c=count: (c.__setitem__(0, c[0] + 1), original(self, x))[1]
        try:
            periodic.runs_of([0] * n)
            periodic.runs_of([i % 7 for i in range(n)])
        finally:
            periodic.Paths._rotate = original
        steps.append(count[0])
    assert steps[1] < 6 * max(steps[0], 4_000)


def test_query_contract(spark):
    rng = random.Random(13)
    vocabulary = ["a", "Ab", "é,", "x1", "word y", "日本"]
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a\u000bb\n" * 40 + "c", "x y z " * 9 + "tail"]
    texts += [" ".join(vocabulary[k % 6] if k < 6 else f"w{k}" for k in sequence(rng)) for _ in range(60)]
    texts += ["filler " + " ".join(f"w{i}" for i in range(200)) + " p q r" * 200]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "b c " * 30, "x", 1), (7, texts[7], "x", 2), (7, "other", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    out = periodic.digests(periodic.find(docs, tails=True))
    want = [contract(r[0], r[1]) for r in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert any(r[1] for r in want if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0)
    assert periodic.digests(periodic.find(docs.limit(0), tails=True)).count() == 0


def test_operator_returns_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "intro " + "do it now " * 10 + "end")], "doc_id long, text string")
    (row,) = periodic.find(docs).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 30, 3)] and tuple(row["best"]) == (1, 30, 3)
    assert row["collapsed"] == "intro do it now end" and row["n_words"] == 32
