"""Distribution fits, goodness of fit, resampling."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosheaf.functions import fixed
from hydrosheaf.functions.special import (
    chi2_upper_col, gamma_ppf_col, gammainc_col, kolmogorov_col, lgamma, normal_cdf_col, normal_ppf_col, pearson3_z,
)
from hydrosheaf.operators import likelihood
from hydrosheaf.operators.freq import l_moments, pearson3_curve, plotting_positions, probabilities
from hydrosheaf.operators.stats import cv_of, moments, parameters
from hydrosheaf.plans.ordering import (
    BLOCK, observed, sequence, spread, value_ranks,
)


def digamma(x):
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        out = np.where(low, out - 1 / y, out)
        y = np.where(low, y + 1, y)
    i = 1 / (y * y)
    return out + np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def _gamma_shape(s):
    """Shape of the gamma law from s = ln(mean) - mean(ln): Newton on the digamma equation, NaN where it does not settle."""
    s = np.asarray(s, float)
    a = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    off = np.full(s.shape, np.inf)
    for _ in range(60):
        h = a * 1e-5
        slope = (digamma(a + h) - digamma(a - h)) / (2 * h)
        new = 1 / (1 / a + (-s + np.log(a) - digamma(a)) / (a * a * (1 / a - slope)))
        off, a = np.abs(new - a) / a, new
        if np.all(off < 1e-14):
            break
    # steps below rounding may alternate for ever; larger ones have not converged
    return np.where(off < 1e-9, a, np.nan)


@F.pandas_udf(T.DoubleType())
def gamma_shape_col(s: pd.Series) -> pd.Series:
    v = s.to_numpy(dtype=float, na_value=np.nan)
    ok = v > 1e-12
    out = np.full(len(v), np.nan)
    if ok.any():
        out[ok] = _gamma_shape(v[ok])
    return pd.Series(out).astype("Float64").mask(~np.isfinite(out))


@F.pandas_udf(T.DoubleType())
def lgamma_col(x: pd.Series) -> pd.Series:
    v = x.to_numpy(dtype=float, na_value=np.nan)
    return pd.Series(lgamma(np.where(v > 0, v, np.nan)))


def simple_fits(df: DataFrame) -> DataFrame:
    """Closed-form likelihood fits in one aggregate: normal, lognormal and gamma (location 0)."""
    x = F.col("value")
    pos = F.when(x > 0, x)
    g = observed(df).groupBy("post").agg(
        F.count(x).alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"), F.stddev_samp(x).alias("sd"),
        F.count(pos).alias("n_pos"), F.avg(F.log(pos)).alias("mu_ln"), F.stddev_pop(F.log(pos)).alias("sigma_ln"),
        F.avg(pos).alias("_mp"))
    g = g.withColumn("shape", gamma_shape_col(F.log("_mp") - F.col("mu_ln")))
    return g.withColumn("scale", F.col("_mp") / F.col("shape")).drop("_mp")


def fitted_quantiles(df: DataFrame, ps=fixed.P_CURVE) -> DataFrame:
    """Quantiles of the fitted normal, lognormal and gamma laws at exceedance probabilities."""
    d = probabilities(simple_fits(df), ps)
    z = normal_ppf_col(1 - F.col("p"))
    return d.select(
        "post", "p", (F.col("mu") + F.col("sigma") * z).alias("normal"),
        F.exp(F.col("mu_ln") + F.col("sigma_ln") * z).alias("lognormal"),
        (gamma_ppf_col(F.col("shape"), 1 - F.col("p")) * F.col("scale")).alias("gamma"))


# --- likelihood fits ------------------------------------------------------------------------
def criteria(d: DataFrame, k: int) -> DataFrame:
    return d.withColumn("aic", 2.0 * k - 2 * F.col("loglik")).withColumn("bic", k * F.log("n") - 2 * F.col("loglik"))


FLAGS = ("converged", "at_bound")


def fit_pearson3(df: DataFrame, bounds=None) -> DataFrame:
    t = F.col("theta")
    return criteria(likelihood.fit(df, "pearson3", bounds, least=5), 3).select(
        "post", "n", t[0].alias("mean"), (F.exp(t[1]) / F.abs(t[0])).alias("cv"), t[2].alias("cs"), "loglik", "aic", "bic", *FLAGS)


def fit_log_pearson3(df: DataFrame, bounds=None) -> DataFrame:
    """Pearson III of ln x (positive values); criteria on the scale of x."""
    logs = observed(df).filter(F.col("value") > 0).withColumn("value", F.log("value"))
    jac = logs.groupBy("post").agg(F.sum("value").alias("_j"))
    t = F.col("theta")
    d = likelihood.fit(logs, "pearson3", bounds, least=5).join(jac, "post").withColumn("loglik", F.col("loglik") - F.col("_j"))
    s2 = F.exp(2 * t[1])
    return criteria(d, 3).select(
        "post", "n", t[0].alias("mean_log"), (F.exp(t[1]) / F.abs(t[0])).alias("cv_log"), t[2].alias("cs_log"),
        F.exp(t[0] + 0.5 * s2).alias("mean_original"), F.sqrt(F.exp(s2) - 1).alias("cv_original"), "loglik", "aic", "bic", *FLAGS)


def fit_gev(df: DataFrame, bounds=None) -> DataFrame:
    t = F.col("theta")
    return criteria(likelihood.fit(df, "gev", bounds), 3).select(
        "post", "n", t[2].alias("shape_xi"), t[0].alias("location"), F.exp(t[1]).alias("scale"), "loglik", "aic", "bic", *FLAGS)


def fit_weibull(df: DataFrame) -> DataFrame:
    """Location fixed at zero, as in the reference; two free parameters are counted."""
    t = F.col("theta")
    pos = observed(df).filter(F.col("value") > 0)
    return criteria(likelihood.fit(pos, "weibull"), 2).select(
        "post", "n", F.exp(t[0]).alias("shape"), F.exp(t[1]).alias("scale"), F.lit(0.0).alias("location"), "loglik", "aic", "bic", *FLAGS)


def _simple_criteria(df: DataFrame) -> DataFrame:
    f = simple_fits(df)
    n = F.col("n")
    ln2pi = float(np.log(2 * np.pi))
    normal = -0.5 * n * (ln2pi + 1) - n * F.log("sigma")
    a, b = F.col("shape"), F.col("scale")
    gamma = F.when(F.col("n_pos") == n, n * ((a - 1) * F.col("mu_ln") - F.col("mu") / b - lgamma_col(a) - a * F.log(b)))
    pick = lambda name, ll: criteria(f.select("post", "n", F.lit(name).alias("law"), ll.alias("loglik")), 2)
    return pick("normal", normal).unionByName(pick("gamma", gamma)).filter(F.col("loglik").isNotNull())


def compare_laws(df: DataFrame) -> DataFrame:
    """Laws of a post ranked by AIC; only laws fitted to all of its values are ranked."""
    from pyspark.sql import Window as W

    take = lambda d, name: d.select("post", "n", F.lit(name).alias("law"), "loglik", "aic", "bic")
    u = take(fit_pearson3(df), "pearson3").unionByName(take(fit_log_pearson3(df), "log_pearson3")).unionByName(
        take(fit_gev(df), "gev")).unionByName(take(fit_weibull(df), "weibull")).unionByName(_simple_criteria(df))
    every = observed(df).groupBy("post").agg(F.count(F.lit(1)).alias("n"))
    u = u.join(every, ["post", "n"], "left_semi")      # a law of positive values alone has another sample
    return u.withColumn("rank", F.row_number().over(W.partitionBy("post").orderBy("aic", "law")))  # six rows per post


# --- goodness of fit ------------------------------------------------------------------------
LAWS = ("normal", "lognormal", "gamma", "pearson3", "gev")


def law_fits(df: DataFrame, law: str) -> DataFrame:
    """Parameters of the law per post: closed forms, Pearson III by moments, GEV by L-moments."""
    if law not in LAWS:
        raise ValueError(f"unknown law {law!r}; known: {', '.join(LAWS)}")
    f = simple_fits(df)
    if law == "pearson3":
        return f.join(moments(df).select("post", "mean", "std", "cs"), "post")
    if law == "gev":
        lm = l_moments(df)
        c = 2 / (3 + F.col("tau3")) - float(np.log(2) / np.log(3))
        k = 7.859 * c + 2.9554 * c * c
        g = F.exp(lgamma_col(1 + F.col("k")))
        scale = F.col("lambda2") * F.col("k") / ((1 - F.pow(F.lit(2.0), -F.col("k"))) * g)
        lm = lm.withColumn("k", k).withColumn("alpha", scale).withColumn("xi0", F.col("lambda1") - F.col("alpha") * (1 - g) / F.col("k"))
        return f.join(lm.select("post", "k", "alpha", "xi0"), "post")
    return f


def law_cdf(x: Column, law: str, sd="sigma") -> Column:
    if law == "normal":
        return normal_cdf_col((x - F.col("mu")) / F.col(sd))
    if law == "lognormal":
        return F.when(x > 0, normal_cdf_col((F.log(F.when(x > 0, x)) - F.col("mu_ln")) / F.col("sigma_ln"))).otherwise(F.lit(0.0))
    if law == "pearson3":
        a = 4 / (F.col("cs") * F.col("cs"))
        y = F.signum("cs") * (x - F.col("mean")) / F.col("std") * F.sqrt(a) + a
        low = F.when(y > 0, gammainc_col(a, F.greatest(y, F.lit(1e-300)))).otherwise(F.lit(0.0))
        return F.when(F.abs("cs") < 1e-6, normal_cdf_col((x - F.col("mean")) / F.col("std"))).when(F.col("cs") > 0, low).otherwise(1 - low)
    if law == "gev":
        t = 1 - F.col("k") * (x - F.col("xi0")) / F.col("alpha")
        return F.when(t > 0, F.exp(-F.pow(t, 1 / F.col("k")))).otherwise(F.when(F.col("k") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(x > 0, gammainc_col(F.col("shape"), x / F.col("scale"))).otherwise(F.lit(0.0))


def law_ppf(p: Column, law: str) -> Column:
    if law == "normal":
        return F.col("mu") + F.col("sigma") * normal_ppf_col(p)
    if law == "lognormal":
        return F.exp(F.col("mu_ln") + F.col("sigma_ln") * normal_ppf_col(p))
    if law == "pearson3":
        return F.col("mean") + F.col("std") * pearson3_col(1 - p, F.col("cs"))
    if law == "gev":
        return F.col("xi0") + F.col("alpha") / F.col("k") * (1 - F.pow(-F.log(p), F.col("k")))
    return gamma_ppf_col(F.col("shape"), p) * F.col("scale")


@F.pandas_udf(T.DoubleType())
def pearson3_col(p_exceed: pd.Series, cs: pd.Series) -> pd.Series:
    return pd.Series(pearson3_z(p_exceed.to_numpy(float), cs.to_numpy(float)))


def goodness_of_fit(df: DataFrame, law="pearson3") -> DataFrame:
    """KS, Anderson-Darling and chi-square against the fitted law.

    The AD form of the normal law uses the sample deviation; KS p is the large-sample one.
    """
    f = law_fits(df, law)
    r = value_ranks(df).withColumn("vb", F.floor(F.col("below") / BLOCK).cast("bigint"))
    d = spread(r.drop("n"), f, block="vb").withColumn("F", law_cdf(F.col("value"), law))
    d = d.withColumn("A", law_cdf(F.col("value"), law, "sd") if law == "normal" else F.col("F"))
    n, b, u = F.col("n"), F.col("below").cast("double"), F.col("upto").cast("double")
    odd = u * u - b * b
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-300)), F.lit(1 - 1e-16))
    s = d.groupBy("post", "n").agg(
        F.max(F.greatest(u / n - F.col("F"), F.col("F") - b / n)).alias("ks"),
        F.sum(odd * F.log(clip(F.col("A"))) + (2 * n * F.col("c") - odd) * F.log(clip(1 - F.col("A")))).alias("_ad"))
    s = s.withColumn("ad", -n - F.col("_ad") / n).drop("_ad").withColumn("ks_p", kolmogorov_col(F.col("ks") * F.sqrt(n)))
    return s.join(_chi_square(df, f, law), "post")


def _chi_square(df: DataFrame, f: DataFrame, law: str) -> DataFrame:
    obs = observed(df).withColumn("blk", F.floor(F.col("t") / BLOCK))
    ends = obs.groupBy("post").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("_n"))
    ends = ends.withColumn("bins", F.greatest(F.lit(5), F.floor(F.sqrt("_n"))).cast("int")).filter(F.col("hi") > F.col("lo"))
    w = (F.col("hi") - F.col("lo")) / F.col("bins")
    b = F.least(F.floor((F.col("value") - F.col("lo")) / w), F.col("bins") - 1).cast("int")
    seen = spread(obs, ends).groupBy("post", b.alias("bin")).agg(F.count(F.lit(1)).alias("seen"))
    every = ends.select("post", "lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    d = every.join(seen, ["post", "bin"], "left").fillna(0, ["seen"]).join(f, "post")
    edge = lambda k: F.col("lo") + k * w
    d = d.withColumn("x0", edge(F.col("bin"))).withColumn("x1", F.when(F.col("bin") == F.col("bins") - 1, F.col("hi")).otherwise(edge(F.col("bin") + 1)))
    d = d.withColumn("c0", law_cdf(F.col("x0"), law)).withColumn("c1", law_cdf(F.col("x1"), law))
    e = F.greatest((F.col("c1") - F.col("c0")) * F.col("n"), F.lit(1.0))
    g = d.groupBy("post", "bins").agg(F.sum((F.col("seen") - e) * (F.col("seen") - e) / e).alias("chi2"))
    return g.withColumn("chi2_p", chi2_upper_col(F.col("chi2"), F.col("bins") - 3))


def qq_points(df: DataFrame, law="normal") -> DataFrame:
    """Sorted observations against fitted quantiles at i/(n+1)."""
    rows = plotting_positions(df, ("weibull",))
    rows = rows.withColumn("i", F.col("n") + 1 - F.col("m")).withColumn("ib", F.floor(F.col("m") / BLOCK).cast("bigint"))
    d = spread(rows.drop("n"), law_fits(df, law), block="ib")
    return d.select("post", "i", F.col("value").alias("empirical"), law_ppf(F.col("i") / (F.col("n") + 1), law).alias("theoretical"))


def pp_points(df: DataFrame, law="normal") -> DataFrame:
    rows = plotting_positions(df, ("weibull",))
    rows = rows.withColumn("i", F.col("n") + 1 - F.col("m")).withColumn("ib", F.floor(F.col("m") / BLOCK).cast("bigint"))
    d = spread(rows.drop("n"), law_fits(df, law), block="ib")
    return d.select("post", "i", (F.col("i") / (F.col("n") + 1)).alias("p_empirical"), law_cdf(F.col("value"), law).alias("p_theoretical"))


# --- bootstrap ------------------------------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit numbers; products stay below 2**63, so SQL can do the same."""
    x = ((x ^ (x >> 16)) * MIX[0]) & LOW
    x = ((x ^ (x >> 15)) * MIX[1]) & LOW
    return x ^ (x >> 15)


LOW, MIX, STRIDE = (1 << 32) - 1, (0x21F0AAAD, 0x735A2D97), 0x9E3779B9
DRAWS = 1 << 20     # draws that a task holds at once


def _name(seed: int, post: str, what) -> int:
    return int(hashlib.sha256(f"{seed}:{post}:{what}".encode()).hexdigest()[:8], 16)


def block_draws(seed: int, post: str, block: int, blocks: int, n: int, width: int, replicates: int) -> np.ndarray:
    """How many of the n draws of each replicate fall into a block.

    From all blocks down to one, each half of a range of blocks gets a binomial share of the range's draws.
    The share depends on (post, range) alone, so tasks that pass through a range agree about it, and a block
    takes as many splits as the logarithm of the number of blocks.
    """
    low, high, left = 0, blocks, np.full(replicates, n)
    root = _name(seed, post, "tree")
    while high - low > 1:
        mid = (low + high) // 2
        size = lambda a, b: min(b * width, n) - a * width        # noqa: E731
        share = np.random.default_rng([root, low, high]).binomial(left, size(low, mid) / size(low, high))
        low, high, left = (low, mid, share) if block < mid else (mid, high, left - share)
    return left


def block_sums(seed: int, post: str, block: int, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Power sums 0 to 3 of each replicate's draws from a block; a draw is a hash of (post, block, replicate, number)."""
    base, out = _name(seed, post, block), np.zeros((len(draws), 4))
    powers = np.stack([np.ones_like(x), x, x * x, x * x * x])
    ends = np.cumsum(draws)
    at = 0
    while at < len(draws):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - draws[at] + DRAWS, "right")))
        own = np.repeat(np.arange(to - at), draws[at:to])
        k = np.arange(len(own)) - np.repeat(ends[at:to] - draws[at:to] - (ends[at] - draws[at]), draws[at:to])
        place = (_mixed((_mixed((base + at + own) & LOW) + k * STRIDE) & LOW) * len(x)) >> 32
        for j, p in enumerate(powers):
            out[at:to, j] = np.bincount(own, p[place], to - at)
        at = to
    return out


def bootstrap_params(df: DataFrame, replicates: int = 1000, seed: int = 42, width: int = BLOCK) -> DataFrame:
    """Moments of resamples with replacement, without moving the draws.

    The draws of a replicate are dealt to blocks of rows down a binary tree of blocks; inside a block each
    draw is a hashed place.  Only power sums per (post, replicate) leave a task.
    """
    seq = sequence(observed(df)).select("post", "value", "i", "n").filter(F.col("n") >= 3)
    m = moments(df).select("post", F.col("mean").alias("_m"))
    packed = seq.groupBy("post", "n", F.floor((F.col("i") - 1) / width).cast("bigint").alias("ob")).agg(
        F.sort_array(F.collect_list(F.struct("i", "value"))).alias("a")).join(m, "post")

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def draw(a: pd.Series, post: pd.Series, ob: pd.Series, n: pd.Series, mean: pd.Series) -> pd.Series:
        out = []
        for x, p, b, total, mu in zip(a, post, ob, n, mean):
            total = int(total)
            mine = block_draws(seed, p, int(b), -(-total // width), total, width, replicates)
            out.append(block_sums(seed, p, int(b), np.asarray(x, float) - mu, mine).tolist())
        return pd.Series(out)

    d = packed.select("post", "n", "_m", draw(F.col("a.value"), "post", "ob", "n", "_m").alias("s"))
    d = d.select("post", "n", "_m", F.posexplode("s").alias("rep", "s"))
    g = d.groupBy("post", "n", "_m", "rep").agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(4)])
    n = F.col("s0")
    mu = F.col("s1") / n
    m2 = F.greatest(F.col("s2") / n - mu * mu, F.lit(0.0))
    m3 = F.col("s3") / n - 3 * mu * F.col("s2") / n + 2 * mu * mu * mu
    g = g.select(
        "post", "rep", "n", (F.col("_m") + mu).alias("mean"), F.sqrt(m2 * n / (n - 1)).alias("std"),
        F.when(m2 > 1e-20, m3 / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(0.0)).alias("cs"))
    return g.withColumn("cv", cv_of(F.col("mean"), F.col("std")))


def bootstrap_bands(df: DataFrame, ps=fixed.P_BANDS, confidence=0.95, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Point curve with percentile bounds and standard error from resampling.

    Draws are repeatable for a seed but are not those of another random generator.
    """
    c = pearson3_curve(bootstrap_params(df, replicates, seed), ps)
    tail = (1 - confidence) / 2
    # one group holds `replicates` values: a bounded number
    b = c.groupBy("post", "p").agg(
        F.percentile("q", F.array(F.lit(tail), F.lit(1 - tail))).alias("e"), F.stddev_samp("q").alias("std_error"))
    point = pearson3_curve(parameters(df), ps).select("post", "p", "q")
    return point.join(b, ["post", "p"]).select("post", "p", "q", F.col("e")[0].alias("q_low"), F.col("e")[1].alias("q_high"), "std_error")
