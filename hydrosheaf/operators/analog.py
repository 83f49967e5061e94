"""Analog rivers: correlation, extension, restoration, integral curves.

``pairs`` is a table (target, analog[, k]) chosen by the user; posts are never paired with all
others here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosheaf.functions import fixed
from hydrosheaf.functions.special import lerp, t_two_sided_col
from hydrosheaf.operators.freq import module_quantiles
from hydrosheaf.operators.stats import annual_runoff_stats, cv_of, moments
from hydrosheaf.plans.ordering import BLOCK, block_of, observed, sequence, spread

KEYS = ["target", "analog"]


def pair_rows(series: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every analog step of a pair: ``qa`` and, where observed, the target's ``qc``."""
    obs = observed(series).select("post", "t", "value")
    a = obs.withColumn("blk", block_of(F.col("t")))
    a = spread(a, pairs.withColumnRenamed("analog", "post")).withColumnRenamed("post", "analog").withColumnRenamed("value", "qa")
    c = obs.select(F.col("post").alias("target"), "t", F.col("value").alias("qc"))
    return a.join(c, ["target", "t"], "left")


def ro_critical(n: Column) -> Column:
    """Critical correlation; one below five common years."""
    return F.when(n < 5, F.lit(1.0)).otherwise(lerp(n, fixed.RO_CRITICAL))


def quality_class(r: Column, strict: bool = True) -> Column:
    names = ("excellent", "good", "fair", "weak")
    e = None
    for lim, name in zip((0.95, 0.90, 0.80, 0.70), names):
        cond = r > lim if strict else r >= lim
        e = F.when(cond, name) if e is None else e.when(cond, name)
    return e.otherwise("poor")


def _both(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("qc").isNotNull())


def validate_correlation(rows: DataFrame, with_p: bool = False) -> DataFrame:
    g = _both(rows).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.corr("qa", "qc").alias("_r"))
    n = F.col("n")
    ok = (n >= 5) & ~F.isnan("_r")
    d = g.withColumn("r", F.when(ok, F.col("_r")).otherwise(F.lit(0.0))).drop("_r")
    r = F.col("r")
    d = d.select(
        *KEYS, "n", "r", (r * r).alias("r2"), ro_critical(n).alias("ro"), (r > ro_critical(n)).alias("significant"),
        F.when(n < 5, "none").otherwise(quality_class(r)).alias("quality"))
    if with_p:
        d = d.withColumn("p_value", t_two_sided_col(r * F.sqrt((n - 2) / (1 - r * r)), n - 2))
    return d


def regression_fit(rows: DataFrame) -> DataFrame:
    return _both(rows).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("qc", "qa").alias("a"), F.regr_intercept("qc", "qa").alias("b")).filter(F.col("n") >= 2)


def _extend(rows: DataFrame, fit: DataFrame, guess: Column) -> DataFrame:
    return spread(rows, fit, KEYS).select(
        *KEYS, "t", F.coalesce("qc", guess).alias("value"), F.col("qc").isNull().alias("extended"))


def regression_extension(rows: DataFrame) -> DataFrame:
    """All analog steps: the observation where there is one, else a Q_analog + b."""
    return _extend(rows, regression_fit(rows).drop("n"), F.col("a") * F.col("qa") + F.col("b"))


def proportional_fit(rows: DataFrame) -> DataFrame:
    g = _both(rows).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("qc").alias("mean_c"), F.avg("qa").alias("mean_a")).filter(F.col("n") >= 2)
    return g.withColumn("k", F.when(F.col("mean_a") != 0, F.col("mean_c") / F.col("mean_a")).otherwise(F.lit(1.0)))


def proportional_extension(rows: DataFrame) -> DataFrame:
    return _extend(rows, proportional_fit(rows).select(*KEYS, F.col("k").alias("ratio")), F.col("ratio") * F.col("qa"))


def extension_error(series: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relative error before and after extension, with K_r = sqrt(3)."""
    m = moments(series).select("post", "n", cv_of(F.col("mean"), F.col("std")).alias("cv"))
    side = lambda name: m.withColumnRenamed("post", name).withColumnRenamed("n", "n_" + name)
    d = pairs.select(*KEYS).join(side("target"), "target").join(side("analog").drop("cv"), "analog")
    k = F.sqrt(F.lit(3.0))
    e0, e1 = F.col("cv") / F.sqrt("n_target") * k * 100, F.col("cv") / F.sqrt("n_analog") * k * 100
    return d.select(
        *KEYS, "n_target", "n_analog", "cv", e0.alias("eps_original"), e1.alias("eps_extended"),
        F.when(e1 <= 10, "reliable").when(e1 <= 15, "reduced").otherwise("unreliable").alias("reliability"),
        F.when(e0 > 0, (e0 - e1) / e0 * 100).otherwise(F.lit(0.0)).alias("improvement"))


def extension_workflow(series: DataFrame, pairs: DataFrame, method: str = "regression") -> DataFrame:
    """Validation, fit, extended mean and error of each pair, with warnings."""
    rows = pair_rows(series, pairs)
    ext = regression_extension(rows) if method == "regression" else proportional_extension(rows)
    m = ext.groupBy(*KEYS).agg(F.avg("value").alias("mean_extended"), F.count_if("extended").alias("n_added"))
    d = validate_correlation(rows).join(m, KEYS).join(extension_error(series, pairs).drop("n_target", "cv"), KEYS)
    return d.withColumn("warnings", F.array_compact(F.array(
        F.when(~F.col("significant"), "correlation not significant"), F.when(F.col("n") < 10, "fewer than 10 common years"),
        F.when(F.col("eps_extended") > 15, "error above 15 %"))))


# --- several analogs at once ----------------------------------------------------------------
@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series, means: pd.Series) -> pd.Series:
    """Centred normal equations of one target: R2, residual sum, coefficients and their errors."""
    out = []
    for m, a, b, c, mu in zip(n, xx, xy, yy, means):
        b, mu = np.asarray(b, float), np.asarray(mu, float)
        k = len(b)
        a = np.asarray(a, float).reshape(k, k)
        try:
            inv = np.linalg.inv(a)
        except np.linalg.LinAlgError:
            out.append(None)
            continue
        beta = inv @ b
        rss = max(c - beta @ b, 0.0)
        r2 = 1 - rss / c if c > 0 else 0.0
        spread_k = np.concatenate(([1 / m + mu[:k] @ inv @ mu[:k]], np.diag(inv)))
        err = np.sqrt(np.abs(spread_k) * rss / max(m - k - 1, 1))
        out.append([r2, rss, mu[k] - beta @ mu[:k], *beta, *err])
    return pd.Series(out)


def wide_analogs(series: DataFrame, pairs: DataFrame, count: int = 3) -> DataFrame:
    rows = pair_rows(series, pairs.filter(F.col("k") <= count))
    x = [F.max(F.when(F.col("k") == j, F.col("qa"))).alias(f"x{j}") for j in range(1, count + 1)]
    return rows.groupBy("target", "t").agg(F.max("qc").alias("y"), *x)


def multi_analog_fit(wide: DataFrame, count: int = 3, n_min: int = 6, ro_cr=0.7, ro_over_sigma=2.0, k_over_sigma=2.0,
                     y_over_sigma=0.2) -> DataFrame:
    """Least squares on up to three analogs over the steps that all of them share, with its criteria.

    ``y_over_sigma`` limits the mean residual against its deviation; ``accepted`` is all criteria at once.
    """
    names = [f"x{j}" for j in range(1, count + 1)]
    full = wide.dropna(subset=["y", *names])
    n = F.count(F.lit(1))
    g = full.groupBy("target").agg(
        n.alias("n"), F.array(*[F.covar_pop(a, b) * n for a in names for b in names]).alias("xx"),
        F.array(*[F.covar_pop(a, "y") * n for a in names]).alias("xy"), (F.covar_pop("y", "y") * n).alias("yy"),
        F.array(*[F.avg(a) for a in [*names, "y"]]).alias("means"))
    s = g.filter(F.col("n") >= n_min).withColumn("s", _solve("n", "xx", "xy", "yy", "means")).filter(F.col("s").isNotNull())
    k = count + 1
    r2 = F.col("s")[0]
    r = F.sqrt(F.greatest(r2, F.lit(0.0)))
    sig = (1 - r2) / F.sqrt("n")
    coef = [F.col("s")[2 + j].alias(f"k{j}") for j in range(k)]
    err = [F.col("s")[2 + k + j].alias(f"s_k{j}") for j in range(k)]
    off = F.col("means")[count] - F.col("s")[2]
    for j in range(count):
        off = off - F.col("s")[3 + j] * F.col("means")[j]
    d = s.select(
        "target", "n", r.alias("r"), sig.alias("sigma_ro"), F.sqrt(F.col("s")[1] / (F.col("n") - 1)).alias("s_res"), *coef, *err, F.abs(off).alias("_off"))
    strong = [F.col(f"k{j}") / F.col(f"s_k{j}") >= k_over_sigma for j in range(1, k)]
    both = strong[0]
    for c in strong[1:]:
        both = both & c
    d = d.withColumn("y_ratio", F.when(F.col("s_res") > 0, F.col("_off") / F.col("s_res"))).drop("_off")
    d = d.withColumn("r_ok", F.col("r") >= ro_cr).withColumn("ratio_ok", F.col("r") / F.col("sigma_ro") >= ro_over_sigma).withColumn("k_ok", both)
    d = d.withColumn("y_ok", F.coalesce(F.col("y_ratio") <= y_over_sigma, F.lit(False)))
    return d.withColumn("accepted", F.col("r_ok") & F.col("ratio_ok") & F.col("k_ok") & F.col("y_ok"))


def multi_analog_extension(wide: DataFrame, fit: DataFrame, count: int = 3) -> DataFrame:
    """Fill missing target steps where all analogs are known; negative estimates stay empty."""
    d = spread(wide.withColumn("blk", block_of(F.col("t"))), fit.select("target", *[f"k{j}" for j in range(count + 1)]), ["target"])
    guess = F.col("k0")
    for j in range(1, count + 1):
        guess = guess + F.col(f"k{j}") * F.col(f"x{j}")
    val = F.coalesce("y", F.when(guess >= 0, guess))
    return d.select("target", "t", val.alias("value"), (F.col("y").isNull() & val.isNotNull()).alias("filled"))


# --- short series ---------------------------------------------------------------------------
def analog_relationship(rows: DataFrame, single_solution: bool = True) -> DataFrame:
    """Line k0 + k1 Q_analog with k1 = s_c / s_a (single solution) or r s_c / s_a."""
    g = _both(rows).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.corr("qa", "qc").alias("r"), F.avg("qc").alias("mean_c"), F.avg("qa").alias("mean_a"),
        F.stddev_samp("qc").alias("sc"), F.stddev_samp("qa").alias("sa"))
    g = g.filter((F.col("n") >= 3) & (F.col("sc") >= 1e-12) & (F.col("sa") >= 1e-12))
    r, n = F.col("r"), F.col("n")
    k1 = F.col("sc") / F.col("sa") * (F.lit(1.0) if single_solution else r)
    var = F.col("sc") * F.col("sc") + k1 * k1 * F.col("sa") * F.col("sa") - 2 * k1 * r * F.col("sc") * F.col("sa")
    sig = (1 - r * r) / F.sqrt(n)
    ratio = F.when(sig > 1e-12, F.abs(r) / sig).otherwise(F.lit(0.0))
    return g.select(
        *KEYS, "n", "r", (F.col("mean_c") - k1 * F.col("mean_a")).alias("k0"), k1.alias("k1"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sigma_res"),
        sig.alias("sigma_ro"), ratio.alias("r_over_sigma"), ro_critical(n).alias("ro"), quality_class(F.abs(r), False).alias("quality"),
        ((F.abs(r) >= ro_critical(n)) & (ratio >= 2) & (n >= 5)).alias("usable"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _weighted(qs: pd.Series, ws: pd.Series) -> pd.Series:
    """Partial estimates of one step (one per analog) -> value, sigma, number used.

    Negative estimates go first, then up to three passes drop those beyond three deviations.
    """
    out = []
    for q, w in zip(qs, ws):
        q, w = np.asarray(q, float), np.asarray(w, float)
        keep = q >= 0
        for _ in range(3):
            x = q[keep]
            if len(x) < 3 or x.std(ddof=1) < 1e-12:
                break
            keep &= np.abs(q - x.mean()) / x.std(ddof=1) <= 3
        total = w[keep].sum()
        out.append([float((w * q)[keep].sum() / total), float(1 / np.sqrt(total)), float(keep.sum())] if total >= 1e-12 else None)
    return pd.Series(out)


def restore_short_series(series: DataFrame, pairs: DataFrame, min_analogs: int = 5, single_solution: bool = True, areas: DataFrame | None = None) -> DataFrame:
    """Observed, restored and unrestored steps of each target over the span of its analogs.

    With ``areas`` (post, area_km2) all series are first turned into modules.
    """
    obs = observed(series).select("post", "t", "value")
    if areas is not None:
        b = spread(obs.withColumn("blk", block_of(F.col("t"))), areas, how="left")
        obs = b.select("post", "t", F.when(F.col("area_km2") > 0, F.col("value") * 1000 / F.col("area_km2")).otherwise(F.col("value")).alias("value"))
    rows = pair_rows(obs, pairs)
    fit = analog_relationship(rows, single_solution).select(*KEYS, "k0", "k1", "sigma_res")
    need = pairs.groupBy("target").agg(F.least(F.lit(min_analogs), F.count(F.lit(1))).alias("need"))
    part = spread(rows.filter(F.col("qc").isNull()), fit, KEYS).select(
        "target", "t", F.struct((F.col("k0") + F.col("k1") * F.col("qa")).alias("q"),
                                F.when(F.col("sigma_res") > 1e-12, 1 / (F.col("sigma_res") * F.col("sigma_res"))).otherwise(F.lit(0.0)).alias("w")).alias("e"))
    # one array entry per chosen analog
    g = part.groupBy("target", "t").agg(F.count(F.lit(1)).alias("n_total"), F.collect_list("e").alias("a"))
    g = g.join(need, "target").filter(F.col("n_total") >= F.col("need"))
    g = g.select("target", "t", "n_total", _weighted(F.col("a.q"), F.col("a.w")).alias("x")).filter(F.col("x").isNotNull()).select(
        "target", "t", F.col("x")[0].alias("q"), F.col("x")[1].alias("sigma"), F.col("x")[2].cast("bigint").alias("n_used"), "n_total")
    g = g.withColumn("delta", F.when(F.abs("q") > 1e-12, F.col("sigma") / F.abs("q") * 100).otherwise(F.lit(0.0)))
    span = rows.groupBy("target").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    steps = span.withColumn("b", F.explode(F.sequence(block_of(F.col("t0")), block_of(F.col("t1"))))).repartition("target", "b")
    steps = steps.select("target", F.explode(F.sequence(F.greatest("t0", F.col("b") * BLOCK), F.least("t1", F.col("b") * BLOCK + BLOCK - 1))).alias("t"))
    mine = obs.select(F.col("post").alias("target"), "t", F.col("value").alias("q")).join(pairs.select("target").distinct(), "target", "left_semi")
    missing = steps.join(mine.select("target", "t"), ["target", "t"], "left_anti").join(g, ["target", "t"], "left")
    return mine.withColumn("note", F.lit("observed")).unionByName(
        missing.withColumn("note", F.when(F.col("q").isNull(), "not restored").otherwise("restored")), allowMissingColumns=True)


def proportional_quantiles(series: DataFrame, pairs: DataFrame, ps=(75, 80, 90, 95, 97)) -> DataFrame:
    """Mean ratio of common years times the analog's quantile."""
    rows = _both(pair_rows(series, pairs))
    k = rows.groupBy(*KEYS).agg(F.avg(F.when(F.col("qa") != 0, F.col("qc") / F.col("qa"))).alias("k_mean"))
    q = module_quantiles(annual_runoff_stats(series), ps).select(F.col("post").alias("analog"), "p", F.col("q").alias("qa"))
    return k.filter(F.col("k_mean").isNotNull()).join(q, "analog").select(*KEYS, "p", "k_mean", (F.col("k_mean") * F.col("qa")).alias("q"))


def compare_methods(series: DataFrame, pairs: DataFrame, ps=(75, 80, 90, 95, 97)) -> DataFrame:
    st = module_quantiles(annual_runoff_stats(series), ps).select(F.col("post").alias("target"), "p", F.col("q").alias("q_statistical"))
    pr = proportional_quantiles(series, pairs, ps)
    d = pr.join(st, ["target", "p"], "left")
    return d.select(*KEYS, "p", "q_statistical", F.col("q").alias("q_proportional"),
                    ((F.col("q") - F.col("q_statistical")) / F.col("q_statistical") * 100).alias("difference"))


def integral_curves(df: DataFrame) -> DataFrame:
    """k = x / mean, its running sum, the running sum of (k - 1) / Cv and its turning points."""
    obs = observed(df)
    m = moments(obs).filter(F.col("n") >= 4).select("post", "n", "mean", cv_of(F.col("mean"), F.col("std")).alias("cv"))
    d = spread(sequence(obs).drop("n"), m)
    mean, i = F.col("mean"), F.col("i")
    k = F.when(mean > 0, F.col("value") / mean).otherwise(F.lit(1.0))
    total = F.when(mean > 0, F.col("run") / mean).otherwise(i.cast("double"))
    step = F.when(F.col("cv") > 1e-12, F.col("cv")).otherwise(F.lit(1.0))
    here, after = F.col("value") - mean, F.col("next") - mean
    turn = (i > 1) & (i < F.col("n")) & (here * after < 0)
    return d.select("post", "t", k.alias("k"), total.alias("integral"), ((total - i) / step).alias("difference_integral"), F.coalesce(turn, F.lit(False)).alias("turning"))
