"""Ordered work inside one post without putting the post into one task.

A post may hold a large part of all rows, so no window here is partitioned by the post
alone over its rows.  Rows are cut into *blocks*: by time (``t`` div width; a block has at
most ``width`` rows because (post, t) is unique) or by value (cut points from a hashed,
hence repeatable, sample).  A *directory* with one row per (post, block) carries what a
block must know of its predecessors (row count, running sum, edge values).  Rows meet the
directory on (post, block), the same key the in-block window needs: one shuffle of the rows.

Operators that read their rows twice (directory and join) hold them as a table in the shared
folder first, so a chain of operators stays a chain and is not planned again for every branch.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydrosheaf.plans.store import held, staged

# time steps per block, and distinct values of one group above which value blocks are cut;
# the environment variables exist so that tests can force many blocks on small data
BLOCK = int(os.environ.get("HYDROSHEAF_BLOCK", 4096))
VALUE_BLOCK = int(os.environ.get("HYDROSHEAF_VALUE_BLOCK", 1 << 17))

_before = (W.unboundedPreceding, -1)
_upto = (W.unboundedPreceding, 0)


def tidy(df: DataFrame, post="post", t="t", value="value") -> DataFrame:
    """Fixed series schema; NaN becomes NULL so that aggregates skip it."""
    v = F.col(value).cast("double")
    return df.select(
        F.col(post).cast("string").alias("post"),
        F.col(t).cast("bigint").alias("t"),
        F.when(~F.isnan(v), v).alias("value"),
    )


def observed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("value").isNotNull())


def block_of(t: Column, width: int = BLOCK) -> Column:
    return F.floor(t / F.lit(width)).cast("bigint")


def spread(rows: DataFrame, facts: DataFrame, keys=("post",), block="blk", how="inner") -> DataFrame:
    """Join per-post facts onto rows by (post, block), so a large post stays split."""
    keys = list(keys)
    rows = held(rows)
    blocks = rows.select(*keys, block).distinct().join(facts, keys, how)
    return rows.join(blocks, [*keys, block])


def sequence(df: DataFrame, keys=("post",), width: int = BLOCK) -> DataFrame:
    """Number the rows of each post in time order and give each row its neighbours.

    Adds ``i`` (1..n), ``n``, ``prev``/``prev_t``, ``next``/``next_t``, ``run`` (running sum of
    value up to the row), ``total`` and ``blk``.  Columns that the caller does not use are
    pruned by Catalyst together with their window expressions.
    """
    keys = list(keys)
    d = held(df.withColumn("blk", block_of(F.col("t"), width)))
    heads = d.groupBy(*keys, "blk").agg(
        F.count(F.lit(1)).alias("_c"),
        F.sum("value").alias("_s"),
        F.min(F.struct("t", "value")).alias("_first"),
        F.max(F.struct("t", "value")).alias("_last"),
    )
    w = W.partitionBy(*keys).orderBy("blk")
    every = W.partitionBy(*keys)
    dirs = heads.select(
        *keys,
        "blk",
        F.coalesce(F.sum("_c").over(w.rowsBetween(*_before)), F.lit(0)).alias("_i0"),
        F.coalesce(F.sum("_s").over(w.rowsBetween(*_before)), F.lit(0.0)).alias("_s0"),
        F.sum("_c").over(every).alias("n"),
        F.sum("_s").over(every).alias("total"),
        F.lag("_last").over(w).alias("_pl"),
        F.lead("_first").over(w).alias("_nf"),
    )
    inner = W.partitionBy(*keys, "blk").orderBy("t")
    rn = F.row_number().over(inner)
    first = F.lag("t").over(inner).isNull()
    last = F.lead("t").over(inner).isNull()
    joined = d.join(dirs, [*keys, "blk"])
    return joined.select(
        *d.columns,
        (F.col("_i0") + rn).cast("bigint").alias("i"),
        "n",
        "total",
        F.when(first, F.col("_pl.value")).otherwise(F.lag("value").over(inner)).alias("prev"),
        F.when(first, F.col("_pl.t")).otherwise(F.lag("t").over(inner)).alias("prev_t"),
        F.when(last, F.col("_nf.value")).otherwise(F.lead("value").over(inner)).alias("next"),
        F.when(last, F.col("_nf.t")).otherwise(F.lead("t").over(inner)).alias("next_t"),
        (F.col("_s0") + F.coalesce(F.sum("value").over(inner.rowsBetween(*_upto)), F.lit(0.0))).alias("run"),
    )


def running(df: DataFrame, x: Column, name: str, keys=("post",), order="t", block="blk") -> DataFrame:
    """Running sum of ``x`` in ``order`` over blocked rows (``block`` must follow ``order``)."""
    keys = list(keys)
    d = held(df.withColumn("_x", x))
    heads = d.groupBy(*keys, block).agg(F.sum("_x").alias("_s"))
    dirs = heads.select(
        *keys,
        block,
        F.sum("_s").over(W.partitionBy(*keys).orderBy(block).rowsBetween(*_before)).alias("_s0"),
    )
    inner = W.partitionBy(*keys, block).orderBy(order).rowsBetween(*_upto)
    zero = F.lit(0)
    return (
        d.join(dirs, [*keys, block])
        .withColumn(name, F.coalesce("_s0", zero) + F.coalesce(F.sum("_x").over(inner), zero))
        .drop("_x", "_s0")
    )


def fill_edges(df: DataFrame, x: Column, keys=("post",), order="t", block="blk") -> DataFrame:
    """Last non-null ``x`` at or before the row and first at or after it: ``left``, ``right``."""
    keys = list(keys)
    d = held(df.withColumn("_x", x))
    heads = d.groupBy(*keys, block).agg(
        F.max(F.when(F.col("_x").isNotNull(), F.struct(order, "_x"))).alias("_l"),
        F.min(F.when(F.col("_x").isNotNull(), F.struct(order, "_x"))).alias("_f"),
    )
    w = W.partitionBy(*keys).orderBy(block)
    dirs = heads.select(
        *keys,
        block,
        F.last("_l", True).over(w.rowsBetween(*_before)).alias("_pl"),
        F.first("_f", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("_nf"),
    )
    inner = W.partitionBy(*keys, block).orderBy(order)
    return (
        d.join(dirs, [*keys, block])
        .withColumn("left", F.coalesce(F.last("_x", True).over(inner.rowsBetween(*_upto)), F.col("_pl._x")))
        .withColumn(
            "right",
            F.coalesce(
                F.first("_x", True).over(inner.rowsBetween(0, W.unboundedFollowing)), F.col("_nf._x")
            ),
        )
        .drop("_x", "_pl", "_nf")
    )


def rolling(seq: DataFrame, rows: int, aggs: dict[str, Column], keys=("post",), width: int = BLOCK) -> DataFrame:
    """Moving aggregates over the last ``rows`` rows (``i`` from :func:`sequence`).

    Rows near the end of an ordinal block are copied into the next one, so each window is
    local to (post, block).  ``full`` tells whether the frame has all its rows.
    """
    keys = list(keys)
    own = F.floor((F.col("i") - 1) / F.lit(width))
    last = F.floor((F.col("i") - 2 + F.lit(rows)) / F.lit(width))
    d = seq.withColumn("_own", own).withColumn("_in", F.explode(F.sequence(own, last)))
    w = W.partitionBy(*keys, "_in").orderBy("i").rowsBetween(-(rows - 1), 0)
    out = d.select("*", *[c.over(w).alias(k) for k, c in aggs.items()])
    return out.filter(F.col("_in") == F.col("_own")).withColumn("full", F.col("i") >= rows).drop("_in", "_own")


def histogram(df: DataFrame, keys=("post",), value="value") -> DataFrame:
    """Distinct values with counts: ties collapse map-side before anything is ordered."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))


def ranks_of(hist: DataFrame, keys=("post",), value="value", limit: int | None = None) -> DataFrame:
    """``below``, ``upto`` (counts of smaller / not larger rows) and ``n`` per distinct value."""
    keys = list(keys)
    limit = limit or VALUE_BLOCK
    # only groups of more than ``limit`` distinct values appear in these two tables, so they are small
    # against the values; written, their sizes are known when they are joined
    hist = held(hist)
    sizes = staged(hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > limit))
    pieces = F.ceil(F.col("_m") / F.lit(limit)) + 1
    draw = F.pmod(F.xxhash64(*keys, value), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a sample of about eight values per piece, the same on every run
    cuts = staged(
        hist.join(sizes, keys).filter(draw < pieces * 8 / F.col("_m"))
        .groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_s"))
        .select(*keys, F.filter("_s", lambda x, j: (j % 8) == 7).alias("_cuts"))
        .withColumn("_g", F.greatest(F.ceil(F.sqrt(F.size("_cuts"))).cast("int"), F.lit(1)))
        .withColumn("_coarse", F.filter("_cuts", lambda x, j: (j % F.col("_g")) == F.col("_g") - 1))
    )
    # cut points at or below the value: first among every _g-th, then among the _g after the last of those
    far = F.size(F.filter("_coarse", lambda c: c <= F.col(value))) * F.col("_g")
    near = F.size(F.filter(F.slice("_cuts", F.col("_far") + 1, F.col("_g")), lambda c: c <= F.col(value)))
    cut = hist.join(cuts, keys, "left").withColumn("_far", far).withColumn(
        "vblk", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.col("_far") + near)
    ).drop("_cuts", "_coarse", "_g", "_far")
    heads = cut.groupBy(*keys, "vblk").agg(F.sum("c").alias("_b"))
    dirs = heads.select(
        *keys,
        "vblk",
        F.coalesce(F.sum("_b").over(W.partitionBy(*keys).orderBy("vblk").rowsBetween(*_before)), F.lit(0)).alias("_b0"),
        F.sum("_b").over(W.partitionBy(*keys)).alias("n"),
    )
    inner = W.partitionBy(*keys, "vblk").orderBy(value).rowsBetween(*_upto)
    return (
        cut.join(dirs, [*keys, "vblk"])
        .withColumn("upto", F.col("_b0") + F.sum("c").over(inner))
        .withColumn("below", F.col("upto") - F.col("c"))
        .select(*keys, value, "c", "below", "upto", "n")
    )


def value_ranks(df: DataFrame, keys=("post",), value="value", limit: int | None = None) -> DataFrame:
    return ranks_of(histogram(df.filter(F.col(value).isNotNull()), keys, value), keys, value, limit)


def with_ranks(df: DataFrame, keys=("post",), limit: int | None = None) -> DataFrame:
    """Put ``below``, ``upto``, ``c``, ``n`` on every row of a blocked table.

    The join key contains the time block, so one frequent value does not make one task large.
    """
    keys = list(keys)
    df = held(df)
    cells = df.filter(F.col("value").isNotNull()).groupBy(*keys, "value", "blk").agg(F.count(F.lit(1)).alias("c"))
    hist = cells.groupBy(*keys, "value").agg(F.sum("c").alias("c"))
    r = ranks_of(hist, keys, "value", limit)
    return df.drop("n").join(cells.drop("c").join(r, [*keys, "value"]), [*keys, "value", "blk"])


def quantiles(ranks: DataFrame, probs: dict[str, float], keys=("post",), value="value") -> DataFrame:
    """Exact linearly interpolated quantiles from ranks; one partial aggregate per post."""
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.floor(pos + F.lit(1e-12)), F.ceil(pos - F.lit(1e-12))
        for tag, k in (("lo", lo), ("hi", hi)):
            aggs.append(F.max(F.when((F.col("below") <= k) & (k < F.col("upto")), F.col(value))).alias(f"_{name}_{tag}"))
    got = ranks.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        frac = pos - F.floor(pos + F.lit(1e-12))
        frac = F.when(frac > 0, frac).otherwise(F.lit(0.0))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return got.select(*keys, "n", *cols)


def order_rows(ranks: DataFrame, keys=("post",), value="value") -> DataFrame:
    """One row per observation again, with ``m`` = rank from the largest."""
    return ranks.select(
        *keys, value, "n",
        F.explode(F.sequence(F.col("n") - F.col("upto") + 1, F.col("n") - F.col("below"))).alias("m"),
    )
