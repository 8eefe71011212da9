"""From raw documents to packed training sequences: the pipeline over the operators of ``kinsight.llm``.

Each stage takes (spark, docs, sf_dir) and returns what goes on; its result is written as Parquet in the shared folder
and read back as the next stage's documents, so a lost executor costs no finished stage. All stages but the last keep
the documents' columns; the last returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinsight.llm import bagminhash, exact_dedup, language, packing, toxicity
from kinsight.llm.common import stored, table, tasks_for
from kinsight.llm.encoding import vocabulary_path


def files(result: DataFrame, docs: DataFrame) -> DataFrame:
    """What a stage makes of ``docs``, in tasks of up to some 5,000 documents, two a core at least: partitions that
    are smaller are taken together, so that a stage doesn't write a file for each of many almost empty ones."""
    return result.coalesce(2 * tasks_for(docs.sparkSession, docs.count(), 10_000))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from the labels of the documents at hand."""
    return files(toxicity.accepted(docs, table(spark, sf_dir, "labels")), docs)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents at hand are marked with."""
    return files(language.accepted(docs), docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space apart."""
    return files(exact_dedup.survivors(docs), docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest doc_id."""
    return files(bagminhash.survivors(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, with their ids."""
    return files(packing.pack(docs, vocabulary_path("byte_bpe_50k.json")), docs)


STAGES = [
    ("toxicity", clean),
    ("language_id", in_a_language),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("packing", packed),
]

#: Trees, hyperdimensional profiles and a tokenizer are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
