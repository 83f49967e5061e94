"""Gaps, outliers, homogeneity and stationarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosheaf.functions import fixed
from hydrosheaf.functions.special import (
    f_critical_col, f_upper_col, kolmogorov_col, lerp, normal_cdf_col, t_critical_col, t_two_sided_col,
)
from hydrosheaf.operators.stats import moments, pair_sums
from hydrosheaf.plans.ordering import (
    BLOCK, block_of, fill_edges, observed, quantiles, ranks_of, running, sequence, spread, value_ranks,
)


def on_spine(df: DataFrame, width: int = BLOCK) -> DataFrame:
    """Every step between the first and last one of a post, with null where nothing was observed."""
    d = df.withColumn("blk", block_of(F.col("t"), width))
    ends = d.groupBy("post").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    blocks = ends.withColumn("blk", F.explode(F.sequence(block_of(F.col("_a"), width), block_of(F.col("_b"), width))))
    # blocks are spread first, so that a long spine is written out by many tasks
    steps = blocks.repartition("post", "blk").select(
        "post", "blk",
        F.explode(F.sequence(
            F.greatest("_a", F.col("blk") * width), F.least("_b", F.col("blk") * width + (width - 1))
        )).alias("t"),
    )
    return steps.join(d, ["post", "blk", "t"], "left")


def missing_count(df: DataFrame) -> DataFrame:
    return on_spine(df).groupBy("post").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(F.col("value").isNull()).alias("missing")
    )


def fill_by_interpolation(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """Linear by row position, ends take the nearest value; short posts take their median."""
    seq = sequence(df).select("post", "t", "value", "i", "n", "blk")
    mark = F.when(F.col("value").isNotNull(), F.struct("i", "value"))
    d = fill_edges(seq, mark)
    a, b = F.col("left"), F.col("right")
    line = a["value"] + (b["value"] - a["value"]) * (F.col("i") - a["i"]) / (b["i"] - a["i"])
    inter = F.when(a.isNull(), b["value"]).when(b.isNull(), a["value"]).otherwise(line)
    med = quantiles(value_ranks(df), {"median": 0.5}).drop("n")
    d = spread(d, med, how="left")
    filled = F.coalesce("value", F.when(F.col("n") < min_rows, F.col("median")).otherwise(F.coalesce(inter, F.col("median"))))
    return d.select("post", "t", filled.alias("value"), F.col("value").isNull().alias("filled"))


def best_partner(df: DataFrame, min_common: int = 5) -> DataFrame:
    """For each post the other post of largest absolute correlation, with its regression."""
    n = F.col("n")
    s = pair_sums(df)
    both = s.select(
        F.col("post_a").alias("target"), F.col("post_b").alias("analog"), "n", F.col("sa").alias("sy"),
        F.col("sb").alias("sx"), F.col("saa").alias("qy"), F.col("sbb").alias("qx"), "sab",
        F.col("shift_a").alias("hy"), F.col("shift_b").alias("hx"),
    ).unionByName(s.select(
        F.col("post_b").alias("target"), F.col("post_a").alias("analog"), "n", F.col("sb").alias("sy"),
        F.col("sa").alias("sx"), F.col("sbb").alias("qy"), F.col("saa").alias("qx"), "sab",
        F.col("shift_b").alias("hy"), F.col("shift_a").alias("hx"),
    ))
    cxy = F.col("sab") - F.col("sx") * F.col("sy") / n
    cxx = F.col("qx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("qy") - F.col("sy") * F.col("sy") / n
    slope = cxy / cxx
    rated = both.filter((n >= min_common) & (cxx > 1e-9) & (cyy > 1e-9)).select(
        "target",
        F.struct(
            F.abs(cxy / F.sqrt(cxx * cyy)).alias("strength"), "analog", (cxy / F.sqrt(cxx * cyy)).alias("r"),
            slope.alias("slope"), (F.col("sy") / n + F.col("hy") - slope * (F.col("sx") / n + F.col("hx"))).alias("intercept"),
        ).alias("b"),
    )
    return rated.groupBy("target").agg(F.max("b").alias("b")).select("target", "b.*")


def fill_by_correlation(df: DataFrame, min_common: int = 5) -> DataFrame:
    """Fill the steps a post lacks from its best correlated partner by regression."""
    obs = observed(df)
    best = best_partner(df, min_common).withColumnRenamed("analog", "post")
    src = spread(obs.withColumn("blk", block_of(F.col("t"))), best)
    guess = src.select(
        F.col("target").alias("post"), "t", (F.col("slope") * F.col("value") + F.col("intercept")).alias("value")
    )
    new = guess.join(obs.select("post", "t"), ["post", "t"], "left_anti")
    return obs.select("post", "t", "value", F.lit(False).alias("filled")).unionByName(
        new.withColumn("filled", F.lit(True))
    )


def end_values(df: DataFrame) -> DataFrame:
    """Three smallest and three largest observations of each post: a1..a3, z1..z3."""
    r = value_ranks(df)
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("upto")), F.col("value")))
    n = F.col("n")
    return r.groupBy("post").agg(
        F.max("n").alias("n"),
        *[at(F.lit(k)).alias(f"a{k + 1}") for k in range(3)],
        *[at(n - 1 - k).alias(f"z{k + 1}") for k in range(3)],
    )


def dixon(ends: DataFrame) -> DataFrame:
    R, n = F.col("z1") - F.col("a1"), F.col("n")
    zero = F.lit(0.0)
    full = (R > 0) & (n >= 3)
    ratio = lambda num: F.when(full, num / R).otherwise(zero)
    gap = F.col("a2") - F.col("a1")
    return ends.select(
        "*",
        F.when((R > 0) & (n >= 2), gap / R).otherwise(zero).alias("D1N"),
        ratio(F.col("a3") - F.col("a1")).alias("D2N"),
        ratio(F.col("z1") - F.col("z3")).alias("D3N"),
        ratio(F.col("z1") - F.col("z2")).alias("D4N"),
        F.when(full & (gap > 0), (F.col("z1") - F.col("z2")) / gap).otherwise(zero).alias("D5N"),
    )


def _level(alpha, table, fallback=0.05):
    return table[alpha if alpha in table else fallback]


def dixon_critical(n: Column, alpha=0.05) -> Column:
    return lerp(n, _level(alpha, fixed.DIXON))


def dixon_critical_by_skew(n: Column, cs: Column, alpha=0.05) -> Column:
    """Variant that depends on the skewness class; null below n = 3."""
    alpha = alpha if alpha in (0.01, 0.05) else 0.05
    by = lambda cat: lerp(n, fixed.DIXON_BY_SKEW[(alpha, cat)])
    inside = F.when(cs < 0.5, by("low")).when(cs < 1.5, by("med")).otherwise(by("high"))
    return F.when(n > 30, F.lit(fixed.DIXON_LONG[alpha])).when(n >= 3, inside)


def grubbs_critical_step(n: Column, alpha=0.05) -> Column:
    v = _level(alpha, fixed.GRUBBS_STEP)
    return F.when(n <= 10, v[0]).when(n <= 15, v[1]).when(n <= 20, v[2]).when(n <= 30, v[3]).otherwise(v[4])


def grubbs(ends_and_moments: DataFrame) -> DataFrame:
    mean, s, n = F.col("mean"), F.col("std"), F.col("n")
    ok = (n >= 3) & (s >= 1e-12)
    far = F.greatest(F.col("z1") - mean, mean - F.col("a1"))
    return ends_and_moments.withColumn("Gn", F.when(ok, far / s).otherwise(F.lit(0.0))).withColumn(
        "G1", F.when(ok, (F.col("z1") - F.col("z2")) / s).otherwise(F.lit(0.0))
    )


def outlier_criteria(df: DataFrame) -> DataFrame:
    m = moments(df).drop("n", "min", "max")
    return grubbs(dixon(end_values(df)).join(m, "post"))


def homogeneity(df: DataFrame, alpha=0.05, min_length: int = 3) -> DataFrame:
    """Seven criteria per post in long form: empirical, critical, significant."""
    c = outlier_criteria(df).filter(F.col("n") >= min_length)
    n = F.col("n")
    crit = {k: dixon_critical(n, alpha) * f for k, f in fixed.DIXON_FACTOR.items()}
    crit["Gn"] = lerp(n, _level(alpha, fixed.GRUBBS_MAX))
    crit["G1"] = lerp(n, _level(alpha, fixed.GRUBBS_GAP))
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("criterion"), F.col(k).alias("empirical"), v.alias("critical")) for k, v in crit.items()
    ]))
    return c.select("post", "n", rows.alias("r")).select(
        "post", "n", "r.*", (F.col("r.empirical") > F.col("r.critical")).alias("significant")
    )


def homogeneity_summary(df: DataFrame, alpha=0.05, min_length: int = 20) -> DataFrame:
    """One row per post; posts shorter than ``min_length`` are reported as skipped."""
    h = homogeneity(df, alpha, min_length).groupBy("post").agg(
        F.count_if("significant").alias("exceeded"),
        F.bool_or(F.col("criterion").isin("D1N", "Gn") & F.col("significant")).alias("basic_fails"),
    )
    sizes = observed(df).groupBy("post").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(h, "post", "left").select(
        "post", "n", F.col("exceeded").isNull().alias("skipped"), "exceeded",
        (F.col("exceeded") == 0).alias("homogeneous"), (~F.col("basic_fails")).alias("homogeneous_basic"),
    )


def outliers(df: DataFrame) -> DataFrame:
    """Rows beyond three (population) deviations or 1.5 interquartile ranges."""
    obs = observed(df).withColumn("blk", block_of(F.col("t")))
    m = obs.groupBy("post").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    q = quantiles(value_ranks(df), {"q1": 0.25, "q3": 0.75})
    v, iqr = F.col("value"), F.col("q3") - F.col("q1")
    z = F.abs(v - F.col("mean")) / F.col("sd")
    return spread(obs, m.join(q, "post").filter(F.col("sd") > 0)).select(
        "post", "t", "value", z.alias("z"), (z > 3).alias("by_z"),
        ((v < F.col("q1") - 1.5 * iqr) | (v > F.col("q3") + 1.5 * iqr)).alias("by_iqr"),
    ).filter(F.col("by_z") | F.col("by_iqr"))


def halves(df: DataFrame, split_year: int | None = None) -> DataFrame:
    """Mark part 1 / 2: before and from a year, or the first n div 2 rows and the rest."""
    seq = sequence(observed(df)).select("post", "t", "value", "i", "n", "blk")
    first = F.col("t") < split_year if split_year is not None else F.col("i") <= F.floor(F.col("n") / 2)
    return seq.withColumn("part", F.when(first, 1).otherwise(2))


def part_moments(parts: DataFrame) -> DataFrame:
    one, two = F.col("part") == 1, F.col("part") == 2
    v = F.col("value")
    aggs = []
    for tag, cond in (("1", one), ("2", two)):
        x = F.when(cond, v)
        aggs += [F.count(x).alias("n" + tag), F.avg(x).alias("mean" + tag), F.var_samp(x).alias("var" + tag)]
    return parts.groupBy("post").agg(*aggs).filter((F.col("n1") >= 2) & (F.col("n2") >= 2))


def welch_and_f(m: DataFrame) -> DataFrame:
    """Welch t (absolute) and F = larger to smaller variance."""
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    lo, hi = F.least("var1", "var2"), F.greatest("var1", "var2")
    return m.select(
        "*", F.abs((F.col("mean1") - F.col("mean2")) / F.sqrt(a + b)).alias("t_stat"),
        (F.pow(a + b, F.lit(2.0)) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("t_df"),
        F.when(lo > 1e-12, hi / lo).otherwise(F.lit(1.0)).alias("f_stat"),
    )


def stationarity(df: DataFrame, split_year: int | None = None, alpha=0.05) -> DataFrame:
    m = welch_and_f(part_moments(halves(df, split_year)))
    d1, d2 = F.col("n1") - 1, F.col("n2") - 1
    return m.select(
        "post", "n1", "n2", "mean1", "mean2", "var1", "var2", "t_stat", "f_stat",
        t_two_sided_col("t_stat", "t_df").alias("t_p"),
        t_critical_col(F.lit(alpha), d1 + d2).alias("t_critical"),
        f_upper_col(F.col("f_stat"), d1, d2).alias("f_p"),
        f_critical_col(F.lit(alpha / 2), d1, d2).alias("f_critical"),
    ).withColumn("stationary", ~((F.col("t_stat") > F.col("t_critical")) | (F.col("f_stat") > F.col("f_critical"))))


def rank_tests(parts: DataFrame) -> DataFrame:
    """Rank sum, Mann-Whitney U, their normal deviates and the two-sample KS distance."""
    ones = F.when(F.col("part") == 1, F.lit(1)).otherwise(F.lit(0))
    cells = parts.groupBy("post", "value").agg(F.sum(ones).alias("c1"), F.count(F.lit(1)).alias("c"))
    tot = cells.groupBy("post").agg(F.sum("c1").alias("n1"), F.sum("c").alias("n"), F.sum(F.pow(F.col("c"), F.lit(3)) - F.col("c")).alias("ties"))
    # counts of part one up to each distinct value: KS compares the two running shares
    r = ranks_of(cells.select("post", "value", "c"))
    both = r.drop("n").join(cells.drop("c"), ["post", "value"])
    vb = F.floor(F.col("below") / BLOCK).cast("bigint")
    both = running(both.withColumn("vb", vb), F.col("c1"), "r1", order="value", block="vb")
    both = spread(both, tot.drop("ties"), block="vb")
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    mid = (F.col("below") + F.col("upto") + 1) / 2
    gap = F.abs(F.col("r1") / n1 - (F.col("upto") - F.col("r1")) / n2)
    s = both.groupBy("post").agg(F.sum(F.col("c1") * mid).alias("rank_sum"), F.max(gap).alias("ks")).join(tot, "post")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    n = F.col("n")
    sd = F.sqrt(n1 * n2 * (n + 1) / 12)
    sd_tied = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select(
        "post", n1.alias("n1"), n2.alias("n2"), "rank_sum", u.alias("u"), "ks",
        ((F.col("rank_sum") - n1 * (n + 1) / 2) / sd).alias("w_z"),
        ((F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd_tied).alias("u_z"),
    )


def pooled_t(m: DataFrame) -> DataFrame:
    n1, n2 = F.col("n1"), F.col("n2")
    sp = ((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / (n1 + n2 - 2)
    return m.withColumn("t_stat", (F.col("mean1") - F.col("mean2")) / F.sqrt(sp * (1 / n1 + 1 / n2))).withColumn(
        "f_stat", F.col("var1") / F.col("var2")
    )


def _tail(z: Column) -> Column:
    return 2 * (1 - normal_cdf_col(F.abs(z)))


def two_part_tests(parts: DataFrame) -> DataFrame:
    """Pooled t, F, rank sum, Mann-Whitney and KS between part 1 and part 2, with p-values.

    Rank and KS p-values are the large-sample ones.
    """
    m = pooled_t(part_moments(parts))
    r = rank_tests(parts).drop("n1", "n2")
    n1, n2 = F.col("n1"), F.col("n2")
    en = F.sqrt(n1 * n2 / (n1 + n2))
    out = m.join(r, "post")
    return out.select(
        "post", "n1", "n2", "t_stat", "f_stat", "rank_sum", "w_z", "u", "ks",
        t_two_sided_col(F.col("t_stat"), n1 + n2 - 2).alias("t_p"),
        f_upper_col(F.col("f_stat"), n1 - 1, n2 - 1).alias("f_p"),
        _tail(F.col("w_z")).alias("w_p"),
        F.least(F.lit(1.0), 2 * (1 - normal_cdf_col(F.col("u_z")))).alias("u_p"),
        kolmogorov_col(F.col("ks") * en).alias("ks_p"),
    ).withColumn("homogeneous", (F.col("t_p") > 0.05) & (F.col("f_p") > 0.05) & (F.col("w_p") > 0.05))
