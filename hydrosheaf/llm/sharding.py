"""Sharding by jump consistent hashing: key and shard count alone decide, no ring table.

The key's digest seeds a linear congruential sequence; each step jumps to the next shard count at
which the key would move.  Appending a shard moves 1/(n+1) of the keys, all into the new shard.
Only SQL expressions: the sequence is an ``aggregate`` over at most ``shards`` steps in decimals,
which hold the 64-bit products.

Slots number the rows of a shard without gaps in key order.  A shard is too large for one window,
so keys are cut into ranges: a directory of (shard, range) counts gives each range its first slot.
Null keys hash as the text ``null`` and come first; rows that share a key share a shard and get
neighbouring slots in the order of their checksums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydrosheaf.llm.tables import body

SHARDS = 24
RANGE = 8192                       # keys of one range at most, repeats aside
STEP = 2862933555777941757         # fixed value: multiplier of the published jump hash
WORD64 = 1 << 64


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def jump(key: Column, shards: int) -> Column:
    """Shard of a non-negative 64-bit ``key`` (decimal) among ``shards``.

    ``grow`` keeps going from the state reached, so the shard with one more costs one expression.
    """
    start = F.struct(key.cast("decimal(38,0)").alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(s, _):
        k = ((s["k"] * _big(STEP) + F.lit(1)) % _big(WORD64)).cast("decimal(38,0)")
        j = F.floor((s["j"] + 1).cast("double") * F.lit(float(1 << 31)) / (F.floor(k / _big(1 << 33)) + 1).cast("double")).cast("bigint")
        return F.when(s["j"] < shards, F.struct(k.alias("k"), s["j"].alias("b"), j.alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def key_of(name: str = "doc_id") -> Column:
    """The first 64 bits of the key's SHA-256 as a decimal."""
    digest = F.sha2(F.coalesce(F.col(name).cast("string"), F.lit("null")), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("decimal(38,0)")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("decimal(38,0)")
    return (high * _big(1 << 32) + low).cast("decimal(38,0)")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (with one shard more)."""
    return docs.withColumn("_key", key_of()).withColumns(
        {"shard": jump(F.col("_key"), shards), "grown_shard": jump(F.col("_key"), shards + 1)}
    ).drop("_key")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``slot`` (from 0, per shard) in the order of doc_id and ``order``."""
    cut = rows.withColumn("_range", F.floor(F.col("doc_id") / F.lit(RANGE)))
    heads = cut.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    first = F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(F.col("shard").alias("_hs"), F.col("_range").alias("_hr"), first.alias("_first"))
    inner = W.partitionBy("shard", "_range").orderBy("doc_id", *order)
    return (
        cut.withColumn("_i", F.row_number().over(inner))
        .join(heads, (F.col("shard") == F.col("_hs")) & F.col("_range").eqNullSafe(F.col("_hr")))
        .withColumn("slot", F.col("_first") + F.col("_i") - 1).drop("_range", "_hs", "_hr", "_first", "_i")
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "size": (F.octet_length(body()) + 8).cast("bigint"),
        "text_crc32": F.crc32(body().cast("binary")),
    })


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document without its text: sizes, shard, slot."""
    rows = assign(sized(docs), shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard")
    return numbered(rows, [F.col("text_crc32"), F.col("size")])
