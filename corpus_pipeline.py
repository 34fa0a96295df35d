"""A corpus pipeline: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.llm import common, exact_dedup, language, ngram_join, packing, substring_dedup
from peerscope.session import materialize

#: A text goes if less than this share of its letter n-grams is in any learned language.
LEAST_LANGUAGE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without letters, or in none of the languages, go."""
    return language.keep_identified(docs, language.train(docs, ~common.held_out("doc_id", 4)), LEAST_LANGUAGE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays."""
    return ngram_join.drop_similar(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document are cut out; n_chars follows."""
    return substring_dedup.cut_repeated(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("exact dedup", exact), ("n-gram Jaccard join", near), ("substring dedup", substrings), ("best-fit packing", packed)]
#: SQL cannot express language ID, content-defined chunks or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
