"""A corpus pipeline over `documents`: quality, near copies, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns the pieces of the packed sequences. An empty table passes through every stage as an empty table. Null texts and
ids, repeated rows and texts of any length are allowed in all of them; each operator's docstring says what they give. Extra columns stay
until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoquery.checkpoints import checkpoint
from genoquery.llm import decontaminate, jaccard_join, packing, quality, substring_dedup
from genoquery.llm.common import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees score at 0.3 or more; the trees learn from `labels` and the documents at hand."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document has; n_chars follows."""
    return substring_dedup.remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that hold all documents left."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup_stage),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing_stage),
]

#: Trees, hashing and tokenizers can't be written in SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
