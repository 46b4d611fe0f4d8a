"""One query per operator over its whole table, and the pipeline's registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import chunks, divergence, langid, licenses, mixing, oracle, periodic, quantised, repair, sampling, simhash, toxicity, variants, warc
from spanlake.llm.tables import documents, table
from spanlake.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = divergence.score(documents(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "swapped_score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.sample(documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids"))
    return sampling.decode(rows, text=False).select(
        "doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "inclusion",
        (F.col("decoded_crc32") == F.col("text_crc32")).alias("round_trip"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    repair.write(documents(spark, sf_dir), path)
    return repair.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.media(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.counts(documents(spark, sf_dir), modulus=31)
    return variants.forms(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.classes(table(spark, sf_dir, "embeddings"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(documents(spark, sf_dir), tails=True))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_divergence": (op1_divergence, oracle.OP1),
    "op2_toxicity": (op2_toxicity, None),
    "op3_warc": (op3_warc, oracle.OP3),
    "op4_sampling": (op4_sampling, None),
    "op5_simhash": (op5_simhash, None),
    "op6_licenses": (op6_licenses, None),
    "op7_langid": (op7_langid, None),
    "op8_repair": (op8_repair, None),
    "op9_chunks": (op9_chunks, None),
    "op10_mixing": (op10_mixing, oracle.OP10),
    "op11_variants": (op11_variants, None),
    "op12_quantised": (op12_quantised, oracle.OP12),
    "op13_periodic": (op13_periodic, None),
}
