"""A training-data pipeline over the table of documents: language, quality, near duplicates, packing.

Every stage but the last returns the columns of documents as they are, whatever their names. Null ids and repeated rows
stay apart as rows; an empty table goes through as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import language_id, minhash, packing, quality_rules
from foliant.llm.common import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the models reject go, and those with null text or without a letter."""
    return language_id.keep_identified(docs)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and have a quality probability of at least a half; null and short texts fail the base."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a likeness of 0.8: that of least id, a null id last; rows of equal id and text count once."""
    return minhash.keep_one(docs, 5, 80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the kept documents in sequences of at most 2048 tokens; a null text is one token long, its end."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", judge_quality),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Language models, learned accuracies and tokenizers have no SQL form; each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages applied to documents; what a stage leaves is stored under spark.checkpoint.dir, so that a lost executor costs one stage's tasks at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
