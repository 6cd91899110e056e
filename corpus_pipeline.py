"""Corpus pipeline: the stages that turn ``documents`` into training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of ``documents``; the last returns token digests.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from navlens.llm import bpe, decontaminate, jaccard, quality, queries, toxicity
from navlens.llm.common import bound_batches, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The scorer learns from the labels of this stage's documents, held-out ones not."""
    bound_batches(spark)
    rows = docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    scored = toxicity.score_toxicity(rows, table(spark, sf_dir, "labels"), ~queries.held_out_labels())
    return scored.where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram join links (five words, 0.8) stays, that with the smallest doc_id."""
    bound_batches(spark)
    return jaccard.keep_first(docs, jaccard.Rule(words=5, num=80, den=100))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bound_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    bound_batches(spark)
    return bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                             public_tokenizers.PATTERN).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level bpe", byte_bpe),
]

#: Toxicity scores and BPE merges have no SQL: the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
