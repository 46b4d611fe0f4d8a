"""From raw documents to encoded training data: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import divergence, langid, mixing, sampling, simhash
from spanlake.llm.tables import documents, write_scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return divergence.keep(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known for certain."""
    return langid.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every row; the pieces as 16-bit ids."""
    return sampling.sample(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("near-duplicates", near_dedup),
    ("mixing", mix),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = write_scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Classifiers and sampled segmentations have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
