"""Descriptive statistics per post (or per any list of keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosheaf.plans.ordering import (
    block_of, observed, quantiles, sequence, spread, value_ranks,
)

ONE = ("post",)


def skew_unbiased(x: Column, n: Column) -> Column:
    """Bias-corrected skewness G1; null below three values or without spread."""
    g = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when((n >= 3) & ~F.isnan(F.skewness(x)), g)


def moments(df: DataFrame, keys=ONE, value="value") -> DataFrame:
    x = F.col(value)
    n = F.count(x)
    return df.groupBy(*keys).agg(
        n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        skew_unbiased(x, n).alias("cs"), F.min(x).alias("min"), F.max(x).alias("max"),
    )


def cv_of(mean: Column, std: Column) -> Column:
    return F.when(mean != 0, std / mean).otherwise(F.lit(0.0))


def lag1(df: DataFrame, keys=ONE) -> DataFrame:
    """Correlation of neighbouring observations (Pearson, lag one)."""
    seq = sequence(observed(df), keys).filter(F.col("prev").isNotNull())
    return seq.groupBy(*keys).agg(F.corr("value", "prev").alias("r1"))


def basic_stats(df: DataFrame, keys=ONE) -> DataFrame:
    """n, mean, median, extremes, deviation, Cv, Cs and the number of missing values."""
    keys = list(keys)
    m = moments(df, keys).join(df.groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("missing")), keys)
    med = quantiles(value_ranks(df, keys), {"median": 0.5}, keys).drop("n")
    return m.join(med, keys).withColumn("cv", cv_of(F.col("mean"), F.col("std")))


def parameters(df: DataFrame, keys=ONE) -> DataFrame:
    """mean, std, Cv, Cs, lag-one correlation and the moment statistics lambda2, lambda3."""
    keys = list(keys)
    n = F.col("n")
    shrink = (n - 1) / n
    biased = F.col("cs") * (n - 2) / F.sqrt(n * (n - 1))
    return (
        moments(df, keys).filter(n >= 3).join(lag1(df, keys), keys, "left")
        .withColumn("cv", cv_of(F.col("mean"), F.col("std")))
        .withColumn("lambda2", shrink)
        .withColumn("lambda3", biased * F.pow(shrink, F.lit(1.5)))
    )


def relative_errors(params: DataFrame) -> DataFrame:
    """Relative errors (%) of mean, Cv and Cs."""
    n, cv, cs = F.col("n"), F.col("cv"), F.col("cs")
    return params.withColumn("eps_mean", cv / F.sqrt(n) * 100).withColumn(
        "eps_cv", F.sqrt(n * (1 + cv * cv) / 2) / (n + 4 * cv * cv) * 100
    ).withColumn(
        "eps_cs", F.when(cs != 0, F.sqrt(F.lit(6.0) / n * (1 + 6 * cv * cv + 5 * F.pow(cv, F.lit(4.0)))) / F.abs(cs) * 100)
    )


def annual_runoff_stats(df: DataFrame, keys=ONE, normative=True) -> DataFrame:
    """Annual flow: Cs = 2 Cv when normative, error with autocorrelation, reliability class."""
    p = parameters(df, keys)
    n, cv = F.col("n"), F.col("cv")
    r = F.coalesce("r1", F.lit(0.0))
    k = F.when((r >= 0) & (r < 1), F.sqrt((1 + r) / (1 - r))).otherwise(F.lit(1.0))
    eps = F.col("epsilon")
    out = p.withColumn("cs_empirical", F.col("cs")).withColumn("cs", 2 * cv if normative else F.col("cs"))
    out = out.withColumn("k_r", k).withColumn("epsilon", cv / F.sqrt(n) * F.col("k_r") * 100)
    return out.withColumn(
        "reliability",
        F.when((eps > 15) | ((n < 10)), "unreliable").when((n < 15) | (eps > 10), "reduced").otherwise("reliable"),
    ).withColumn(
        "warnings",
        F.array_compact(F.array(
            F.when(n < 10, "fewer than 10 years").when(n < 15, "fewer than 15 years"),
            F.when(eps > 15, "error above 15 %").when(eps > 10, "error above 10 %"),
        )),
    )


def max_runoff_stats(df: DataFrame, keys=ONE, normative=True) -> DataFrame:
    """Annual maxima: Cs = 2 Cv up to Cv 0.5, else 3 Cv; class by length and error."""
    n, cv = F.col("n"), F.col("cv")
    out = moments(df, keys).filter(n >= 3).withColumn("cv", cv_of(F.col("mean"), F.col("std")))
    out = out.withColumn("cs_empirical", F.col("cs"))
    if normative:
        out = out.withColumn("cs", F.when(cv <= 0.5, 2 * cv).otherwise(3 * cv))
    return out.withColumn("epsilon", cv / F.sqrt(n) * 100).withColumn(
        "reliability",
        F.when((F.col("epsilon") > 15) | (n < 10), "unreliable").when(n < 20, "reduced").otherwise("reliable"),
    )


def category_stats(df: DataFrame, keys) -> DataFrame:
    """Plain moments per post and category; a category of fewer than three values stays, empty."""
    few = F.col("n") < 3
    m = moments(df, keys).withColumn("cv", cv_of(F.col("mean"), F.col("std")))
    for c in ("mean", "std", "cv", "cs"):
        m = m.withColumn(c, F.when(~few, F.col(c)))
    return m


def length_warnings(df: DataFrame, min_probability: float | None = None, keys=ONE) -> DataFrame:
    """Warnings on short series; ``min_probability`` is the rarest design probability."""
    n = F.col("n")
    rare = F.lit(min_probability is not None and min_probability <= 0.01)
    return df.groupBy(*keys).agg(F.count("value").alias("n")).withColumn(
        "warnings",
        F.array_compact(F.array(
            F.when(rare & (n < 50), "rare_event_needs_50"), F.when(n < 25, "below_25"),
            F.when(n < 30, "below_30"), F.when(n < 10, "critically_short"),
        )),
    )


def module_and_layer(means: DataFrame, mean="mean", area="area_km2") -> DataFrame:
    """Discharge (m3/s) to module (l/s km2), volume (km3) and layer (mm)."""
    q, f = F.col(mean), F.col(area)
    ok = f > 0
    zero = F.lit(0.0)
    return (
        means.withColumn("module", F.when(ok, q * 1000 / f).otherwise(zero))
        .withColumn("volume", F.when(ok, q * 31.536 / 1000).otherwise(zero))
        .withColumn("layer", F.when(ok, q * 31536 / f).otherwise(zero))
    )


def from_module(df: DataFrame, module="module", area="area_km2") -> DataFrame:
    return df.withColumn("discharge", F.when(F.col(area) > 0, F.col(module) * F.col(area) / 1000))


_PAIR = T.StructType(
    [T.StructField("post_a", T.StringType()), T.StructField("post_b", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]
)


def pair_sums(df: DataFrame, tile: int = 256, width: int = 1024) -> DataFrame:
    """Cross sums of all post pairs on common steps, as a tiled matrix product.

    Posts fall into tiles of about ``tile`` posts; a task sees two tiles over ``width`` steps
    (a bounded block) and multiplies matrices, so pairs are never formed row by row: a row is
    copied once per tile, not once per post.
    """
    import numpy as np
    import pandas as pd

    obs = observed(df)
    tiles = max(1, -(-obs.select("post").distinct().count() // tile))
    d = obs.withColumn("blk", block_of(F.col("t"), width))
    means = obs.groupBy("post").agg(F.avg("value").alias("_m"))
    d = spread(d, means).withColumn("value", F.col("value") - F.col("_m"))
    mine = F.pmod(F.xxhash64("post"), F.lit(tiles)).cast("int")
    d = d.withColumn("_g", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    d = d.select("post", "t", "value", "blk", "_g", F.least("_g", "_o").alias("ta"), F.greatest("_g", "_o").alias("tb"))

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="t", columns="post", values="value")
        tile_of = pdf.groupby("post")["_g"].first().reindex(x.columns).to_numpy()
        m = x.notna().to_numpy(dtype=float)
        v = x.fillna(0.0).to_numpy()
        n, s, sq, ab = m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v
        names = x.columns.to_numpy()
        one = pdf["ta"].iat[0] == pdf["tb"].iat[0]
        take = (names[:, None] < names[None, :]) & (n > 0)
        if not one:
            take &= tile_of[:, None] != tile_of[None, :]
        i, j = np.nonzero(take)
        return pd.DataFrame({
            "post_a": names[i], "post_b": names[j], "n": n[i, j], "sa": s[i, j], "sb": s[j, i],
            "saa": sq[i, j], "sbb": sq[j, i], "sab": ab[i, j],
        })

    part = d.groupBy("ta", "tb", "blk").applyInPandas(gram, _PAIR)
    sums = part.groupBy("post_a", "post_b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    back = lambda side: means.select(F.col("post").alias(f"post_{side}"), F.col("_m").alias(f"shift_{side}"))
    return sums.join(back("a"), "post_a").join(back("b"), "post_b")


def correlation_matrix(df: DataFrame, tile: int = 256) -> DataFrame:
    n = F.col("n")
    sxy = F.col("sab") - F.col("sa") * F.col("sb") / n
    sxx = F.col("saa") - F.col("sa") * F.col("sa") / n
    syy = F.col("sbb") - F.col("sb") * F.col("sb") / n
    r = F.when((n >= 2) & (sxx > 1e-9) & (syy > 1e-9), sxy / F.sqrt(sxx * syy))
    return pair_sums(df, tile).select("post_a", "post_b", n.cast("bigint").alias("n"), r.alias("r"))


def histogram_bins(df: DataFrame, bins: int = 15) -> DataFrame:
    """Equal-width bins between the extremes of each post; the last bin is closed."""
    d = observed(df).withColumn("blk", block_of(F.col("t")))
    ends = d.groupBy("post").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col("value") - F.col("lo")) / w), F.lit(bins - 1)).cast("bigint")
    return (
        spread(d, ends.filter(F.col("hi") > F.col("lo")))
        .groupBy("post", b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
        .withColumn("left", F.col("lo") + F.col("bin") * w)
        .select("post", "bin", "left", "count")
    )


def box_stats(df: DataFrame) -> DataFrame:
    """Quartiles, and whiskers = last observations within 1.5 interquartile ranges."""
    r = value_ranks(df)
    q = quantiles(r, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col("value")
    blocks = r.drop("n").withColumn("vb", block_of(F.col("below")))
    return (
        spread(blocks, q, block="vb")
        .groupBy("post", "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(v >= low, v)).alias("whisker_low"), F.max(F.when(v <= high, v)).alias("whisker_high"),
            F.sum(F.when((v < low) | (v > high), F.col("c")).otherwise(F.lit(0))).alias("fliers"),
        )
    )
