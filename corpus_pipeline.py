"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
documents.  All but the last return the columns of the documents; the last adds
``shard`` and ``slot``.  ``run`` does this below the session's shared checkpoint
folder.

The stages' results depend on signatures, learned weights and permutations that SQL
cannot say, so there is no ``ORACLE_SQL``; tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import common as C
from riskloom.llm import op2_sharding, op5_minhash_dedup, op7_decontamination, op9_mixing, op10_toxicity

N_SHARDS = 24


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon scores as toxic go."""
    lexicon = op10_toxicity.fit(docs, C.table(spark, sf_dir, "labels"))
    return op10_toxicity.reject_toxic(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked from a similarity of 0.8 of their
    five-word shingles on, the document of the smallest doc_id stays."""
    return op5_minhash_dedup.drop_near_duplicates(docs, op5_minhash_dedup.STAGE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op7_decontamination.decontaminate(docs, C.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with the words, that the mixture takes."""
    return op9_mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    return op2_sharding.shard_documents(docs, N_SHARDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's input is dropped
    when its output is written."""
    scratch = C.Scratch(spark, "pipeline")
    docs, last = C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
