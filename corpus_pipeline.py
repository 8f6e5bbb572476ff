"""The corpus pipeline: stages that each read what the one before has kept.

`run` writes what every stage returns as Parquet in the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulemill.llm import decontamination, language, packing, pii, simhash
from rulemill.llm.common import table
from rulemill.llm.tokens import tokenizer_path
from rulemill.sources.storage import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SURROGATE_KEY = "surrogates of the corpus"
SEQUENCE = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages that are labelled, and keep the documents that are found to be in one of them, as near to it as its own
    documents are. Where no row is labelled nothing can be told, and all rows stay."""
    model = language.learn(docs)
    return language.recognised(docs, model, least=language.bounds(docs, model)) if model else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more, by their SimHash bits."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.anonymise(docs, SURROGATE_KEY)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, with their place in a sequence."""
    parts = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=SEQUENCE)
    return packing.pack(parts, capacity=SEQUENCE, seed=10)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]

#: The stages train models, tile and pack by a search, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
