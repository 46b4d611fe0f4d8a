import math
import random

import pytest
from brute import targets, words

from spanlake.llm import mixing as M


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")


def text(n):
    return " ".join(["w"] * n)


def check(docs, rows, got):
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for s in sizes:
        mine = [r for r in got if r.source == s]
        ties = {}
        for r in mine:  # rows of one id are taken together
            ties[r.doc_id] = ties.get(r.doc_id, 0) + r.size
        longest = max(ties.values())
        assert abs(sum(r.taken for r in mine) - want[s]) <= longest / 2 + 1e-6


@pytest.mark.parametrize("seed", range(3))
def test_random_sources(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", "𝒳", "￿", None, "hot"]
    rows = [(i, text(rng.choice([0, 1, 5, 30, 200])), "hot" if rng.random() < 0.4 else rng.choice(names)) for i in range(300)]
    docs = table(spark, rows)
    got = M.mix(docs).collect()
    check(docs, rows, got)
    assert sorted(map(str, M.mix(docs.repartition(7)).collect())) == sorted(map(str, got))


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, text(100), None), (3, text(100), None), (None, text(7), "b"), (None, text(7), "b"), (4, text(9), "b"), (5, "x", "only zero")]
    docs = table(spark, rows)
    check(docs, rows, M.mix(docs).collect())
    assert M.mix(docs.limit(0)).count() == 0
    nothing = [(1, None, "a"), (2, " ", "b")]
    check(docs, nothing, M.mix(table(spark, nothing)).collect())


def test_selection_order_is_that_of_the_keys(spark):
    """A source's fractional part is a prefix of its documents in key order."""
    rows = [(i, text(10 + i % 7), "a" if i % 2 else "b") for i in range(400)]
    docs = table(spark, rows)
    keyed = {r.doc_id: r for r in M.keyed(M.measured(docs)).collect()}
    got = M.mix(docs).collect()
    for s in "ab":
        mine = sorted((r for r in got if r.source == s), key=lambda r: keyed[r.doc_id].key)
        copies = [r.copies for r in mine]
        assert copies == sorted(copies, reverse=True) and max(copies) - min(copies) <= 1


def test_keys_are_exponential_with_the_weight_as_rate(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'s' AS source", "1L AS size", "CASE WHEN id % 2 = 0 THEN 1.0D ELSE 0.25D END AS weight")
    keys = M.keyed(rows).collect()
    for w in (1.0, 0.25):
        mean = sum(r.key for r in keys if r.weight == w) / 2000
        assert mean == pytest.approx(1 / w, rel=0.1)
    for r in keys:
        x = (1 - math.exp(-r.key / 2)) * M.BUCKETS
        assert r.b1 == min(int(x), M.BUCKETS - 1)


def test_symbols_lower_the_weight(spark):
    docs = table(spark, [(1, "plain words here", "a"), (2, "p### w%%% h***", "a")])
    weight = {r.doc_id: r.weight for r in M.measured(docs).collect()}
    assert weight[1] == 1 and weight[2] < 0.5


def test_repeated_documents(spark):
    rows = [(i, text(5 + i % 3), "abc"[i % 3]) for i in range(90)] + [(None, "no id", "a")]
    docs = table(spark, rows).selectExpr("*", "1 AS mix_id", "'x' AS mix_copies", "2 AS mix_copy", "3 AS copies", "4 AS row", "5 AS key")
    taken = {r.doc_id: r.copies for r in M.mix(docs).collect()}
    out = M.repeated(docs)
    assert out.dtypes == docs.dtypes
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n == {d: c for d, c in taken.items() if c}
