"""A training corpus from documents: five operators of ``hydrosheaf.llm`` in a row.

Every stage reads what the one before kept and returns its columns, the last one shards in addition.
Null and empty texts are clean and pass the first three stages; the mix gives them by the rate of their
source; rows that repeat an id are judged each by its own text; tied scores and sizes are settled by id
and hash, so reruns agree; an empty table stays empty; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosheaf.llm import decontam, mixing, ngram_join, sharding, toxicity
from hydrosheaf.llm.tables import read, small_batches, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 80     # per cent


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    small_batches(spark)
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; documents without words are no copies."""
    small_batches(spark)
    return ngram_join.representatives(docs, SHINGLE_WORDS, LEAST_SIMILARITY)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such passages go."""
    small_batches(spark)
    kept = decontam.removed(docs, read(spark, sf_dir, "benchmark"))
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), "n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their weights."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row that the mix emits."""
    return sharding.shard_table(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("ngram_join", drop_copies), ("decontamination", drop_benchmark), ("mixing", mix), ("sharding", shard),
]

# toxicity scores come from a trained model, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
