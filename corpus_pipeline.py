"""A corpus pipeline: toxic documents go, then exact and near copies; what is left is mixed to
target weights and encoded. Each stage reads what its predecessor wrote.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra
columns of any name as its operator defines them: null texts are empty and clean; of equal or near-equal
texts the smallest id stays, and one row of repeats; null ids stay unless a text with an id equals
theirs; a null source is one of its own; an empty table stays empty. All but the last return their input's columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidalpanel.llm import bpe, exact_dedup, mixing, simhash, toxicity
from tidalpanel.llm.shared import shared_dir

#: Characters of a block of the last stage: its workers run beside executors whose heaps the other stages have filled.
BLOCK_CHARS = 1 << 21

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose sets of five-word shingles have an exact Jaccard similarity of at least 0.8."""
    return simhash.deduplicate(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy in the mix: doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, block_chars=BLOCK_CHARS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: XXH64 fingerprints, learned scores and merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs
    for name, function in STAGES:
        out = function(spark, docs, sf_dir)
        if function is not STAGES[-1][1]:
            path = f"{shared_dir(spark)}/staged/pipeline-{name}-{uuid.uuid4().hex}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    return out
