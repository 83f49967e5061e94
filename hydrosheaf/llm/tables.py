"""Input columns, intermediate tables and connected components shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrosheaf.plans.store import shared_folder, staged  # noqa: F401

SPACE = "[\\x20\\x09-\\x0D]"      # white space that separates words
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def body(name: str = "text") -> Column:
    """The whole text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` rows at once to Python in this session, or fewer where it is set so.

    Spark bounds Arrow batches by rows.  With its default of 10,000 a batch of whole texts takes tens of MB
    several times over, in the JVM and in the worker, and neither gives it back while stages follow.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def groups_for(spark: SparkSession) -> int:
    """Number of hash groups for work in Arrow batches: as many as the session has shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node per node: ``edges(a, b)`` -> ``(node, root)``.

    Rounds of large-star and small-star; each replaces edges by edges to the smallest neighbour, so
    a node of many links is never gathered into one row, and the table never grows.  Nodes without
    a link do not appear.  Self links and repeated links are harmless; null ends are dropped.
    """
    e = staged(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        # large star: every neighbour above a node goes to the smallest node around it
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every neighbour below a node, and the node, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = staged(small)
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (state["n"], state["h"]):
            break
        seen = (state["n"], state["h"])
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
