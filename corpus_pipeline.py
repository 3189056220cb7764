"""A corpus from raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which
is written as Parquet and read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from evidentia.llm._shared import discard, materialize, read_table
from evidentia.llm.queries import LONG_WORDS, MIN_RUN, TOKENIZER, WINDOW


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.clean(docs, read_table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines, and of long lines, go, and documents of which nothing is left."""
    return line_dedup.clean(docs, MIN_RUN, LONG_WORDS)


def jaccard_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.clean(docs, k=5, share=75)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a benchmark window go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"), WINDOW)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=4096, end_id=2)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("jaccard_join", jaccard_near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: A trained classifier and packing by column generation have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # Only the last stage's table is read any more.
        discard(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
