"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next. All but the last return the columns of the
documents. A null text counts as empty and fails the quality rules; an empty
table passes through every stage as no rows; further columns pass through all
stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabscope.llm import jaccard, packing, pii, quality, substrings
from tabscope.session import stage_table

#: Near-duplicates share 0.8 of their five-word shingles.
NEAR = jaccard.Similarity(n=5, percent=80)
#: Passages of at least so many words are cut where they were seen before.
REPEATED = substrings.Passages(window=50, short=12)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.keep_one(docs, NEAR)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document, or the same one, already has."""
    return substrings.without_repeats(docs, REPEATED)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and without the terms that give it away."""
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in fixed-length sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]
#: Expectation-maximisation, components and tokenising have no SQL form; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
