"""A training corpus from raw documents: filter, deduplicate twice, mix, pack.

Each stage reads what the one before it kept, as Parquet, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.llm import exact, mixing, near, packing, quality
from concord.session import stored, table


def quality_filter(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. It learns from the labels of ``documents``.

    Null and empty texts get the score of the learned bias; null and repeated ids and repeated rows keep their rows.
    """
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, columns=docs.columns, name="__score").where("__score >= 0.5").drop("__score")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest ``doc_id``."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that with the smallest ``doc_id``."""
    return near.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mixture of the sources by their volumes to the power 0.7."""
    return mixing.interleaved(docs, alpha=0.7)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens, which follow the order of the mixture."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, ordered=True)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot express the classifier, the alignment or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
