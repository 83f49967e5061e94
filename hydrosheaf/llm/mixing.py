"""Mixing sources to target weights: floor(rate) copies and one Bernoulli copy by a hash of the document.

Sizes are words.  Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
``share`` times all words; no source gets more than ``ceiling`` times its own words, and what it
leaves goes to the others by weight.  That fixed point is a water level: with the caps sorted by
cap / weight, the level is found from running sums over the source table.

A document is emitted ``floor(rate)`` times and once more where its hash draw lies below the
fraction.  One digest of (doc_id) holds eight independent draws; a source uses the draw number
whose sum comes nearest to its target, which costs no extra pass over texts and repeats on
every run.  Repeated rows of a document draw alike; null ids draw as the text ``null``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydrosheaf.llm.tables import WORD, body, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2
DRAWS = 8


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.regexp_count(body(), F.lit(WORD)).cast("bigint"))


def targets(sizes: DataFrame, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size) -> target words and repetition rate per source."""
    ranked = sizes.select(
        "*", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("_k")
    ).select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("_k") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double").alias("_w"),
    )
    cap = F.col("source_size") * F.lit(float(ceiling))
    upto = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    run = ranked.withColumn("_cap", cap).select(
        "*",
        F.coalesce(F.sum("_cap").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_full"),
        F.sum("_w").over(upto.rowsBetween(0, W.unboundedFollowing)).alias("_open"),
        (F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))).alias("_total"),
    ).withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    # the level is that of the first source below its cap; from there on the values fall
    level = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(W.partitionBy())
    return run.withColumn("_l", level).select(
        "source", "source_size",
        F.when(F.col("_l").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_l") * F.col("_w"))).alias("target"),
    ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draws(n: int = DRAWS):
    """Uniform numbers in [0, 1), eight hex digits of the digest each."""
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) for i in range(n)]


def plan(docs: DataFrame, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``rate``, ``draw`` and ``copies``.

    The two source tables are written before they meet the documents, so the planner knows their
    sizes and broadcasts them only where they are small.
    """
    sized = with_size(docs)
    aim = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, ceiling))
    part = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(u < part, F.col("size")).otherwise(F.lit(0))).alias(f"_s{i}") for i, u in enumerate(draws())]
    facts = ["source_size", "target", "rate"]
    drawn = _on_source(sized.select("doc_id", "size", "source"), aim, facts).groupBy("source", *facts).agg(*extra)
    off = F.array(*[
        F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"_s{i}") - F.col("target")).alias("off"), F.lit(i).alias("i"))
        for i in range(DRAWS)
    ])
    aimed = staged(drawn.select("source", *facts, F.array_min(off)["i"].alias("draw")))
    u = F.element_at(F.array(*draws()), F.col("draw") + 1)
    return _on_source(sized, aimed, [*facts, "draw"]).withColumn(
        "copies", (F.floor("rate") + F.when(u < part, 1).otherwise(0)).cast("int")
    )


def _on_source(docs: DataFrame, facts: DataFrame, names: list[str]) -> DataFrame:
    return docs.alias("d").join(facts.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.*", *[F.col(f"t.{n}") for n in names]
    )


def mix(docs: DataFrame, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as it is drawn."""
    plain = docs.select("doc_id", "text", "source", *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "source")])
    own = [c for c in ("size", "source_size", "target", "rate", "draw", "copies") if c in docs.columns]
    kept = plain.withColumnsRenamed({c: f"_own_{c}" for c in own})
    out = plan(kept, share, ceiling).filter("copies > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"`_own_{c}`").alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])
