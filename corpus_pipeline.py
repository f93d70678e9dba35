"""Corpus pipeline over ``documents``: quality, toxicity, exact and near duplicates,
packing.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir), works
on all rows its predecessor kept and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again as the next one's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillpoint.llm import cutting_stock, exact_dedup, hyperminhash, ordinal_quality, toxicity
from tillpoint.llm.common import staged, table
from tillpoint.llm.queries import ratings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being prose, not junk, is at least one half."""
    model = ordinal_quality.fit(docs, ratings(table(spark, sf_dir, "labels")), grades=3)
    return ordinal_quality.select(docs, model, select_grade=1, min_tail=0.5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of five-word shingles."""
    return hyperminhash.near_dedup(docs, words=5, threshold=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 token ids."""
    return cutting_stock.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).digests()


STAGES = [
    ("quality", quality),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", packing),
]

# Trained classifiers, MinHash and the packing are not expressible in SQL. The classifiers'
# stages are tested against their operators' scores, the other stages and ``run`` against
# brute force (tests/llm/test_queries.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
