"""The registered queries on the smallest data, and the pipeline against its stages done directly."""

import os

import pyarrow.parquet as pq
import pytest
from brute import classes, fingerprint

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
COLUMNS = {
    "op1_divergence": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_sampling": {"doc_id": "bigint", "sample": "int", "round_trip": "boolean"},
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_licenses": {"doc_id": "bigint", "licenses": "string"},
    "op7_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_repair": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9_chunks": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op10_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op11_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op12_quantised": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op13_periodic": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
}
#: Tables of the queries that have a row for each row of another table than documents.
KEYS = {"op3_warc": ("pages", "page_id"), "op12_quantised": ("embeddings", "vec_id")}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    text = oracle_sql().get(name)
    if text:
        assert compare(spark, connect(SF_DIR), name, queries()[name], text, SF_DIR) == ""
    df = queries()[name](spark, SF_DIR)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    if name == "op11_variants":
        assert df.count() == df.select("word").distinct().count() > 0
        return
    table, key = KEYS.get(name, ("documents", "doc_id"))
    got = [r[0] for r in df.select(key).distinct().collect()]
    assert sorted(got) == sorted(pq.read_table(f"{SF_DIR}/{table}.parquet").column(key).to_pylist())


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept: nothing clean is lost, one of each near-duplicate class stays."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema == docs.schema, name
        docs = kept[name] = out.cache()
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in kept.items()}
    assert len(ids["quality rules"]) < len(ids["input"]) and len(ids["quality rules"]) > 0.7 * len(ids["input"])
    texts = {r.doc_id: r.text for r in kept["language ID"].collect()}
    want = classes({d: fingerprint(t) for d, t in texts.items()})
    assert sorted(ids["near-duplicates"]) == sorted(set(want.values()))
    assert set(ids["mixing"]) <= set(ids["near-duplicates"]) and max(ids["mixing"].count(d) for d in set(ids["mixing"])) == 2
    assert sorted(ids["encoding"]) == sorted(2 * ids["mixing"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").collect()) == sorted(ids["encoding"])


def test_pipeline_edge_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the of and to " * 30, "en", None, 1), (3, "x" * 30_000, "en", "a", 1), (3, "x" * 30_000, "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, ids string, component_id long"
    for given in (rows, []):
        docs = spark.createDataFrame([(*r, 1, "x", 2) for r in given], schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
        assert docs.count() >= 0
