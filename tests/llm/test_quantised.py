"""Links of embeddings against all pairs."""

import numpy as np
import pytest
from pyspark.sql import types as T

from spanlake.llm import quantised

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("node", T.StringType()), T.StructField("list", T.IntegerType())]
)


def expected(rows):
    """(vec_id, n_links, component_id, kept) of each row, the direct way."""
    def real(v, label):
        return bool(v) and label is not None and None not in v and np.isfinite(v).all() and np.any(v)

    vectors = [np.array(v, np.float32).astype(float) if real(v, label) else None for _, v, label, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(vectors):
        for j in range(i + 1, len(rows)):
            b = vectors[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(find(k), []).append(row[0])
    out = []
    for k, row in enumerate(rows):
        ids = [x for x in groups[find(k)] if x is not None]
        least = min(ids) if ids else None
        out.append((row[0], links[k], least, row[0] == least))
    return sorted(out, key=repr)


def made(seed, n=260, dim=16):
    """Random directions, clusters of near copies up to the limit, exact copies, three labels."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    centre = rng.normal(size=dim)
    base[: n // 3] = centre + rng.normal(size=(n // 3, dim)) * np.linalg.norm(centre) * rng.uniform(0.0, 0.12, (n // 3, 1)) / np.sqrt(dim) * 2
    base[n // 3 : n // 3 + 20] = base[n // 2] * rng.uniform(0.5, 3, (20, 1))
    base[-6:] = base[0]
    labels = np.where(np.arange(n) % 5 == 0, 1, np.where(np.arange(n) % 7 == 0, 2, 3))
    return [(int(i), base[k].astype(np.float32).tolist(), int(labels[k]), "x", 1) for k, i in enumerate(rng.permutation(n))]


@pytest.mark.parametrize(("seed", "block", "sample"), [(1, 1024, 20_000), (2, 16, 20_000), (3, 7, 60)])
def test_classes(spark, seed, block, sample):
    rows = made(seed)
    got = quantised.classes(spark.createDataFrame(rows, SCHEMA), sample=sample, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0], 1, None, 0), (3, [2.0, 0.1], 1, None, 0), (4, [2.0, 0.1], None, None, 0), (9, [2.0, 0.1], None, None, 0), (1, None, 1, None, 0), (2, [], 1, None, 0),
        (6, [0.0, -0.0], 1, None, 0), (7, [nan, 1.0], 1, None, 0), (8, [inf, 1.0], 1, None, 0), (10, [1.0, None], 1, None, 0), (11, [1.0, 0.0, 0.0], 1, None, 0),
        (None, [0.0, 1.0], 2, None, 0), (12, [0.0, 1.0], 2, None, 0), (12, [0.0, 1.0], 2, None, 0), (None, [1.0, -1.0], 2, None, 0), (13, [1.0, 0.0], 3, None, 0),
        (14, [-0.0, 5.0], 4, None, 0), (15, [0.0, 5.0], 4, None, 0), (20, [1.0, 2.0], 5, None, 0),
    ]
    got = quantised.classes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
    assert quantised.classes(spark.createDataFrame(rows[4:9], SCHEMA)).where("n_links = 0 AND kept").count() == 5
    assert quantised.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_several_lists_and_bounds():
    """With many lists: every link is met in exactly one list, and table distances never exclude one."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 8))
    x[3000:] = x[:3000] + rng.normal(size=(3000, 8)) * 0.16
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = quantised.fit(x[:2000], len(x))
    assert len(index.directions) >= 8
    home, visits = index.probed(x)
    codes, rest = index.coded(x - index.directions[home])
    met = set()
    norm = np.ones(len(x))
    for k in range(len(index.directions)):
        inside, seek = np.flatnonzero(home == k), np.flatnonzero((home == k) | visits[:, k])
        i, j = quantised.linked(index, k, (x[seek], norm[seek]), (x[inside], norm[inside], codes[inside], rest[inside]))
        for a, b in zip(seek[i].tolist(), inside[j].tolist(), strict=True):
            if a != b and (home[a] != home[b] or a < b):
                assert (a, b) not in met
                met.add((a, b))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert {(min(p), max(p)) for p in met} == set(zip(a.tolist(), b.tolist(), strict=True)) and len(a) > 1000


def test_roots():
    assert quantised.roots(6, np.array([4, 1, 5]), np.array([1, 5, 3])).tolist() == [0, 1, 2, 1, 1, 1]
