import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import classes, fingerprint
from pyspark.sql import functions as F

from spanlake.llm import simhash as S
from spanlake.llm.tables import components

EDGE = [None, "", " \n", "One", "one TWO", "a b c", "A b C d", "é É x y z", "the same words " * 300, "word " * 70_000, "x" * 9999, "tab\tvt\x0b b c d"]


def prints(texts):
    return [int(x) for x in S.fingerprints_of(pa.array(texts, pa.string()))]


def test_fingerprints_against_brute_force():
    assert prints(EDGE) == [fingerprint(t) for t in EDGE]
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    assert prints(texts) == [fingerprint(t) for t in texts]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(rng, x, bits):
    for b in rng.sample(range(64), bits):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("limit", [2, 64])
def test_classes_of_fingerprints(spark, limit):
    """Chains, dense clusters and unrelated fingerprints; a cell limit of 2 sends clusters the second way."""
    rng = random.Random(limit)
    fps = [0, 1 << 63, (1 << 64) - 1]
    for _ in range(25):
        x = rng.getrandbits(64)
        fps += [x, near(rng, x, 1), near(rng, x, 2), near(rng, x, 3), near(rng, near(rng, x, 2), 2)]
    center = rng.getrandbits(64)
    fps += [near(rng, center, k) for k in (0, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 4) for _ in range(8)]
    fps = list(dict.fromkeys(fps))
    want = classes(dict(enumerate(fps)))
    points = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in components(S.links(points, limit)).collect()}
    got = [roots.get(signed(x), signed(x)) for x in fps]
    same = lambda names: {frozenset(i for i, n in enumerate(names) if n == m) for m in names}
    assert same(got) == same([want[i] for i in range(len(fps))])


def test_cells_meet_exactly_within_two_steps(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(4)]
    fps += [near(rng, x, k) for x in fps for k in (1, 2, 3, 4)]
    vector = lambda x: np.array([(x >> 2 * i & 3).bit_count() for i in range(32)])
    got = {}
    for r in S.cells(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect():
        got.setdefault(r.fp, set()).add(r.cell)
    for a in fps:
        for b in fps:
            assert bool(got[signed(a)] & got[signed(b)]) == (np.abs(vector(a) - vector(b)).sum() <= 2)


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(50)] + [(200, i) for i in range(201, 300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in list(root):
        assert got.get(x, x) == find(x)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives_know_rows_by_id_and_text(spark):
    """Different texts with null or shared ids stay; of equal rows and of near copies one does."""
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[5]), (7, texts[5]), (8, texts[0]), (9, texts[3]), (None, texts[2])]
    docs = spark.createDataFrame([(*r, k, 2, 3) for k, r in enumerate(rows)], "doc_id long, text string, row_hash int, root int, kept int")
    for seed in range(2):
        kept = S.representatives(docs.repartition(3 + seed))
        assert kept.schema == docs.schema
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
            [(8, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[5])], key=repr
        )


def test_split_by_keys(spark, monkeypatch):
    """Rows with a key are always among the asked ones, with any size of the bit map."""
    from spanlake.llm import tables

    rows = spark.range(3000).selectExpr("id", "xxhash64(id) AS hash", "'x' AS bitmap_slot")
    keys = spark.range(0, 3000, 7).selectExpr("xxhash64(id) AS k")
    for slots in (1 << 20, 4, 1):
        monkeypatch.setattr(tables, "SLOTS", slots)
        stay, asked = tables.split_by_keys(rows, F.col("r.hash"), keys)
        assert stay.columns == rows.columns == asked.columns
        assert stay.count() + asked.count() == 3000 and stay.where("id % 7 = 0").count() == 0
        assert slots < 5 or asked.count() < 450
    stay, asked = tables.split_by_keys(rows, F.col("r.hash"), keys.limit(0))
    assert asked.count() == 0 and stay.count() == 3000


def test_documents_with_edge_rows(spark):
    text = "some words that make a longer text of many parts " * 6
    rows = [(i + 10, t) for i, t in enumerate(EDGE)] + [(5, text), (3, text), (3, text), (None, text), (None, "other words entirely here")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = S.classes(docs).collect()
    assert len(got) == len(rows)
    own = {d: fingerprint(t) for d, t in rows if d is not None}
    want = classes(own)
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (own[r.doc_id], want[r.doc_id])
    assert {r.component_id for r in got if r.doc_id is None} == {3, None}
    kept = S.representatives(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [*sorted(set(want.values())), None]
    assert S.classes(docs.limit(0)).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_exploded_is_not_broadcast(spark, monkeypatch):
    """Its estimate is that of the rows that go in, 65 times too few."""
    plans, write = [], S.write_scratch
    monkeypatch.setattr(S, "write_scratch", lambda df, name: plans.append(plan(df)) or write(df, name))
    points = spark.createDataFrame([(i * i * 977,) for i in range(300)], "fp long")
    plans.append(plan(S.links(points, 2)))
    assert len(plans) == 2 and not [p for p in plans if "Broadcast" in p]


def test_representatives_broadcast_only_the_bit_map(spark, monkeypatch):
    """Classes and decisions have a row a document or so; none of them goes to the driver."""
    plans, write = [], S.write_scratch
    monkeypatch.setattr(S, "write_scratch", lambda df, name: plans.append(plan(df)) or write(df, name))
    docs = spark.createDataFrame([(i, f"some words of document {i // 2}") for i in range(60)], "doc_id long, text string")
    assert S.representatives(docs).count() == 30
    assert plans and not [p for p in plans if "Broadcast" in p]
