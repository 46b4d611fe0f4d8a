import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanlake.llm import chunks as C
from spanlake.session import scratch_path


def padded(text):
    data = (text or "").encode()
    n = max(-(-len(data) // 576), 1) * 576
    return data, data + b"\xff" * (n - len(data))


def slow_cut(payload):
    ends, last = [], 0
    for i in range(len(payload)):
        if i + 1 - last > C.MOST:
            last += C.MOST
            ends.append(last)
        if i + 1 - last < C.LEAST:
            continue
        h = 0
        for b in payload[max(0, i - 31) : i + 1]:
            h = (2 * h + int(C.GEAR[b])) & 0xFFFFFFFF
        if h & C.MASK == 0 and i + 1 < len(payload):
            last = i + 1
            ends.append(last)
    return [*ends, len(payload)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    passage, long = word(4000), word(9000)
    return ["", None, "a", "x" * 576, "x" * 577, word(50), passage, word(900) + passage + word(30), word(300) + passage, long, long, "z" * 60_000, long[:20_000] + "CHANGED" + long[20_007:], "é☃ " * 700]


def test_cuts_against_the_definition(texts):
    data, at, _ = C.payloads(pa.array(texts, pa.string()))
    for text, ends in zip(texts, C.cut(data, at)):
        payload = padded(text)[1]
        assert ends.tolist() == slow_cut(payload)
        sizes = np.diff([0, *ends])
        assert sizes.max() <= C.MOST and (len(sizes) == 1 or sizes[:-1].min() >= C.LEAST)


def test_media_round_trip(spark, texts):
    rows = [(i, t, 1, "m") for i, t in enumerate(texts)] + [(3, texts[7], 1, "m"), (3, texts[7], 1, "m"), (None, texts[9], 1, "m"), (None, "only here", 1, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, object string").repartition(4)
    got = C.media(docs).collect()
    assert len(got) >= len(rows) - 1
    by_content = {}
    for r in got:
        by_content.setdefault(r.payload_sha256, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by_content.values())
    want = sorted(((d, *_values(t)) for d, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=repr) == want


def _values(text):
    data, payload = padded(text)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_shared_chunks_are_stored_once(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    path = scratch_path(spark, "test-media")
    C.write(docs, path)
    stored = spark.read.schema(C.STORED).parquet(path).collect()
    payloads = {padded(t)[1] for t in texts}
    whole = set()
    for p in payloads:
        ends = [0, *slow_cut(p)]
        whole |= {hashlib.sha256(p[a:b]).digest() for a, b in zip(ends, ends[1:])}
    objects = [r for r in stored if r.manifest is not None]
    assert len(objects) == len(payloads)
    parts = [r for r in stored if r.manifest is None]
    assert len({bytes(r.object) for r in parts}) == len(parts) > 2
    kept = sum(len(r.own) for r in stored)
    distinct = {}
    for p in payloads:
        ends = [0, *slow_cut(p)]
        distinct |= {hashlib.sha256(p[a:b]).digest(): b - a for a, b in zip(ends, ends[1:])}
    assert kept == sum(distinct.values())
    assert kept < 0.8 * sum(map(len, payloads))


def test_empty_table(spark):
    assert C.media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
