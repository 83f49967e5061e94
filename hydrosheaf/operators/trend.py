"""Trend and change-point analysis per post."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosheaf.functions.special import normal_cdf_col, t_critical_col, t_two_sided_col
from hydrosheaf.operators.slopes import median_slopes
from hydrosheaf.plans.ordering import (
    BLOCK, observed, quantiles, running, sequence, value_ranks, with_ranks,
)
from hydrosheaf.plans.store import staged


def linear_trend(df: DataFrame) -> DataFrame:
    """Least squares of value on t with the standard error of the slope."""
    y, x = F.col("value"), F.col("t").cast("double")
    m = observed(df).groupBy("post").agg(
        F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
    ).filter(F.col("n") >= 3)
    se = F.sqrt(F.greatest(1 - F.col("r2"), F.lit(0.0)) * F.col("_syy") / F.col("_sxx") / (F.col("n") - 2))
    return m.withColumn("std_err", se).drop("_sxx", "_syy")


def linear_trend_significance(df: DataFrame) -> DataFrame:
    m = linear_trend(df)
    dfree = F.col("n") - 2
    half = t_critical_col(F.lit(0.05), dfree) * F.col("std_err")
    return (
        m.withColumn("p_value", t_two_sided_col(F.col("slope") / F.col("std_err"), dfree)).withColumn("_h", half)
        .withColumn("slope_low", F.col("slope") - F.col("_h")).withColumn("slope_high", F.col("slope") + F.col("_h"))
        .withColumn("significant", F.col("p_value") < 0.05).drop("_h")
    )


def pair_sign(pos, val, weight) -> float:
    """Sum over pairs with pos_a < pos_b of w_a w_b sign(val_b - val_a), without forming pairs.

    Every pair differs first in one bit of its position code; per bit the left half is sorted
    once and the right half looks itself up in it: O(k log^2 k).
    """
    pos = np.unique(pos, return_inverse=True)[1]
    v = np.unique(val, return_inverse=True)[1]
    w = np.asarray(weight, dtype=float)
    if len(pos) < 2:
        return 0.0
    span = int(v.max()) + 1
    total = 0.0
    for bit in range(int(pos.max()).bit_length()):
        node = pos >> (bit + 1)
        right = ((pos >> bit) & 1).astype(bool)
        key = node * span + v
        order = np.argsort(key[~right], kind="stable")
        left = key[~right][order]
        cum = np.concatenate([[0.0], np.cumsum(w[~right][order])])
        rk, rn = key[right], node[right]
        start = cum[np.searchsorted(left, rn * span, "left")]
        end = cum[np.searchsorted(left, (rn + 1) * span, "left")]
        less = cum[np.searchsorted(left, rk, "left")] - start
        more = end - cum[np.searchsorted(left, rk, "right")]
        total += float(np.dot(w[right], less - more))
    return total


@F.pandas_udf(T.DoubleType())
def _pair_sign(pos: pd.Series, val: pd.Series, weight: pd.Series) -> pd.Series:
    return pd.Series([pair_sign(p, v, w) for p, v, w in zip(pos, val, weight)], dtype="float64")


def sign_sum(df: DataFrame, side: int | None = None) -> DataFrame:
    """S = sum over pairs i < j of sign(x_j - x_i), exactly, for posts of any length.

    A long post is cut into about sqrt(n) time tiles and sqrt(n) value tiles.  Pairs within one
    time tile or one value tile are counted in a bounded task each; the others only need the
    counts of the tile grid.
    """
    seq = sequence(observed(df)).select("post", "t", "value", "i", "n", "blk")
    w = F.greatest(F.lit(side or BLOCK), F.ceil(F.sqrt("n"))).cast("bigint")
    d = with_ranks(seq).withColumn("w", w)
    d = staged(d.withColumn("tb", F.floor((F.col("i") - 1) / F.col("w"))).withColumn("vb", F.floor(F.col("below") / F.col("w"))))
    # pairs inside one time tile
    a = d.groupBy("post", "tb").agg(F.collect_list(F.struct("i", "value")).alias("a"))
    ones = F.transform("a", lambda _: F.lit(1.0))
    inside = a.select("post", _pair_sign(F.col("a.i"), F.col("a.value"), ones).alias("s"))
    # pairs inside one value tile but in different time tiles; equal values fold into weights
    many = d.filter(F.col("n") > F.col("w"))
    cells = many.groupBy("post", "vb", "tb", "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    b = cells.groupBy("post", "vb").agg(F.collect_list(F.struct("tb", "value", "c")).alias("a"))
    level = b.select("post", _pair_sign(F.col("a.tb"), F.col("a.value"), F.col("a.c")).alias("s"))
    # the rest: the grid of tile counts, completed with zeros (at most about n cells)
    grid = cells.groupBy("post", "tb", "vb").agg(F.sum("c").alias("c"))
    rows = grid.select("post", "tb").distinct()
    last = grid.groupBy("post").agg(F.max("vb").alias("_v"))
    full = rows.join(last, "post").select("post", "tb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_v"))).alias("vb"))
    g = full.join(grid, ["post", "tb", "vb"], "left").fillna(0.0, ["c"])
    before = W.partitionBy("post", "vb").orderBy("tb").rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("p", F.coalesce(F.sum("c").over(before), F.lit(0.0)))
    row = W.partitionBy("post", "tb")
    lower = F.coalesce(F.sum("p").over(row.orderBy("vb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    g = g.withColumn("lower", lower).withColumn("all", F.sum("p").over(row))
    cross = g.select("post", (F.col("c") * (2 * F.col("lower") + F.col("p") - F.col("all"))).alias("s"))
    return inside.unionByName(level).unionByName(cross).groupBy("post").agg(F.sum("s").alias("s"))


def mann_kendall(df: DataFrame) -> DataFrame:
    """S, tie-corrected z and the two-sided normal p-value."""
    obs = observed(df)
    ties = obs.groupBy("post", "value").agg(F.count(F.lit(1)).alias("c")).groupBy("post").agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("_ties"),
    )
    n, s = F.col("n").cast("double"), F.col("s")
    var = (n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18
    z = F.when(var > 0, (s - F.signum(s)) / F.sqrt(var)).otherwise(F.lit(0.0))
    d = sign_sum(df).join(ties, "post").withColumn("z", z)
    d = d.withColumn("p_value", 2 * (1 - normal_cdf_col(F.abs("z"))))
    return d.select(
        "post", "n", F.col("s").cast("bigint").alias("s"), "z", "p_value",
        F.when(s > 0, "rising").when(s < 0, "falling").otherwise("none").alias("trend"),
        (F.col("p_value") < 0.05).alias("significant"),
    )


def sens_slope(df: DataFrame) -> DataFrame:
    """Median pairwise slope, and the intercept through the medians of value and time."""
    med_v = quantiles(value_ranks(df), {"_my": 0.5}).drop("n")
    times = observed(df).select("post", F.col("t").cast("double").alias("value"))
    med_t = quantiles(value_ranks(times), {"_mt": 0.5}).drop("n")
    return median_slopes(df).join(med_v, "post").join(med_t, "post").select(
        "post", "slope", (F.col("_my") - F.col("slope") * F.col("_mt")).alias("intercept")
    )


def pettitt(df: DataFrame, min_length: int = 2) -> DataFrame:
    """Change point by rank sums: U_t = |2 sum(R) - t (n + 1)|, first maximum."""
    d = with_ranks(sequence(observed(df)).select("post", "t", "value", "i", "blk"))
    d = running(d, F.col("below") + F.col("upto") + 1, "rr", order="t")
    n = F.col("n")
    u = F.abs(F.col("rr") - F.col("i") * (n + 1))
    best = d.filter((F.col("i") < n) & (n >= min_length)).groupBy("post", "n").agg(
        F.min(F.struct((-u).alias("u"), "i", "t")).alias("b")
    )
    m = -F.col("b.u")
    nd, md = n.cast("double"), m.cast("double")
    p = F.least(F.lit(1.0), 2 * F.exp(-6 * md * md / (nd * nd * nd + nd * nd)))
    return best.select(
        "post", "n", (F.col("b.i") - 1).alias("change_index"), F.col("b.t").alias("change_t"),
        m.alias("max_u"), p.alias("p_value"), (p < 0.05).alias("significant"),
    )


def trend_summary(df: DataFrame) -> DataFrame:
    """All trend measures of a post in one row, with a verdict text."""
    lin = linear_trend_significance(df).select(
        "post", "n", F.col("slope").alias("ols_slope"), "r2", F.col("p_value").alias("ols_p"))
    mk = mann_kendall(df).select("post", "s", "z", F.col("p_value").alias("mk_p"), "trend", F.col("significant").alias("mk_sig"))
    sen = sens_slope(df).select("post", F.col("slope").alias("sen_slope"))
    pt = pettitt(df).select("post", "change_t", "max_u", F.col("p_value").alias("pettitt_p"), F.col("significant").alias("pt_sig"))
    verdict = F.concat(
        F.when(F.col("mk_sig"), F.concat(F.lit("significant "), F.col("trend"))).otherwise(
            F.concat(F.lit("no significant trend, direction "), F.col("trend"))),
        F.when(F.col("pt_sig"), F.concat(F.lit("; change near "), F.col("change_t").cast("string"))).otherwise(F.lit("")),
    )
    return lin.join(mk, "post").join(sen, "post").join(pt, "post").withColumn("verdict", verdict).drop("mk_sig", "pt_sig")


def split_by_year(df: DataFrame, year: int) -> DataFrame:
    return df.withColumn("part", F.when(F.col("t") < year, 1).otherwise(2))
