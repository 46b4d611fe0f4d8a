import gzip
import hashlib

import pytest

from spanlake.llm import warc as W

SCHEMA = "page_id long, url string, html string, id int, value string, at int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def expected(rows):
    first = {}
    for page, _, html in rows:
        html = html or ""
        if len(html.encode()) >= 1000 and page is not None:
            first[html] = max(first.get(html, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        rep = first.get(html or "")
        revisit = rep is not None and rep != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", rep if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


FORGED = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\ntail"


def test_round_trip_with_copies_and_edge_rows(spark):
    big, other = "<p>é☃ " * 300, "y" * 1000
    rows = [
        (1, "http://a", big), (2, None, big), (3, "http://b\r\nEvil: 1", other), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"),
        (8, "u", "y" * 999), (9, "u", "y" * 999), (None, "u", big), (3, "http://b\r\nEvil: 1", other), (10, "u", other), (11, "u", "z\r\n\r\n" * 400), (3, "u", big),
    ]
    assert got(W.round_trip(pages(spark, rows))) == expected(rows)


def test_magic_inside_payloads_is_no_record(spark):
    rows = [(1, "u", FORGED), (2, "u", "WARC/1.1\r\n"), (3, "u", "WARC/1.1\r\n" * 200), (4, "u", FORGED * 30), (5, "u", FORGED * 30), (6, "u", "plain")]
    assert got(W.round_trip(pages(spark, rows))) == expected(rows)


def test_another_split_of_the_second_reading(spark, monkeypatch, tmp_path):
    """Forged records are found again however the files are dealt to tasks by then."""
    rows = [(i, "u", f"page {i} " + FORGED * (i % 4)) for i in range(40)]
    W.write(pages(spark, rows).repartition(6), str(tmp_path / "w"), compression="none")
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    original = W._read_again

    def again(df, forged):
        spark.conf.set(name, "700")
        return original(df, forged)

    monkeypatch.setattr(W, "_read_again", again)
    try:
        assert got(W.resolved(W.read(W.lines(spark, str(tmp_path / "w"))))) == expected(rows)
    finally:
        spark.conf.set(name, before)


def test_many_records_of_one_file(spark):
    rows = [(i, "u", f"page {i} " * (i % 40)) for i in range(300)]
    assert got(W.round_trip(pages(spark, rows).coalesce(1))) == expected(rows)


def test_empty_table(spark):
    assert W.round_trip(pages(spark, []).limit(0)).count() == 0


def test_foreign_file_plain_and_cut_off(spark, tmp_path):
    """Files of another writer, split by Spark in the middle of records; the last record is cut off."""
    data = b""
    for i in range(200):
        body = (FORGED if i % 7 == 0 else "text ") * (i % 5 + 1)
        digest = hashlib.sha1(body.encode()).hexdigest()
        data += f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}:x>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(data[:-3])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        records = W.resolved(W.read(W.lines(spark, str(tmp_path))))
        ids = sorted(r.page_id for r in records.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ids == sorted([*range(200), *range(199)])


def test_reachable_against_a_walk(spark):
    import random

    rng = random.Random(5)
    nodes, want = [], set()
    for f in "ab":
        following = {at: at + rng.randint(1, 9) for at in range(60) if rng.random() < 0.8 or at == 0}
        nodes += [(f, a, b) for a, b in following.items()]
        at = 0
        while at in following:
            want.add((f, at))
            at = following[at]
    found = W.reachable(spark.createDataFrame(nodes, "file string, at long, next long"))
    assert {tuple(r) for r in found.collect()} == want


def test_estimate_of_a_long_chain_stays_a_number(spark):
    """Estimates of joins are products: carried from round to round they had 11,000 bits after six rounds and filled the driver."""
    n = 70
    nodes = spark.range(n).selectExpr("'f' AS file", "id AS at", "CASE WHEN id < %d THEN id + 1 END AS next" % (n - 1))
    found = W.reachable(nodes)
    assert found.count() == n
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 70


def test_wrong_digest_fails(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:x>\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")
    with pytest.raises(Exception, match="payload digest of"):
        W.resolved(W.read(W.lines(spark, str(tmp_path)))).collect()
