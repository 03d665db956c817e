"""Documents to training sequences: quality, exact copies, near copies, secrets, packing.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of
`documents`. The table between two stages is written to the shared folder, so that a lost executor
costs a read. What a stage staged for itself is deleted when the next one begins, since its result has
been written by then.

Null and empty texts: the classifier scores them like any text (as empty ones); exact dedup takes them
for one text and keeps the smallest id; near dedup links them with nothing; the secret scan leaves them as
they are; packing gives each its end token.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tierwatch.functions.shared import delete_path, scratch, stage
from tierwatch.llm import exactdup, neardup, packing, quality, secrets

_STAGED: list[str] = []


def in_turn(step):
    """The stage function `step`, which frees what earlier stages staged, unless its rows still come from there."""

    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _STAGED else []
        done = [path for path in _STAGED if not any(path in file for file in read)]
        for path in done:
            delete_path(spark, path)
            _STAGED.remove(path)
        with scratch(spark) as own:
            out = step(spark, docs, sf_dir)
            own.kept += own.paths
        _STAGED.extend(own.kept)
        return out

    return run_step


@in_turn
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it learns from the labels of the given rows."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_turn
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exactdup.distinct_documents(docs)


@in_turn
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.one_of_each(docs)


@in_turn
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.without_secrets(docs)


@in_turn
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("packing", pack),
]

# Classifiers, signatures and token ids are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, step in STAGES[:-1]:
        docs, last = stage(step(spark, docs, sf_dir), name.replace(" ", "-")), before
        before = docs.staged_path
        if last:
            delete_path(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)
