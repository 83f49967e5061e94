"""Exceedance curves: plotting positions, theoretical quantiles, design values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosheaf.functions import fixed
from hydrosheaf.functions.special import normal_ppf_col, pearson3_z, pearson3_z_col
from hydrosheaf.operators.stats import annual_runoff_stats, max_runoff_stats, moments, parameters
from hydrosheaf.plans.ordering import (
    BLOCK, observed, order_rows, value_ranks, spread,
)


def probabilities(df: DataFrame, ps, percent=False) -> DataFrame:
    """Every row of ``df`` with every probability of a short fixed list (no shuffle)."""
    scale = 100.0 if percent else 1.0
    return df.withColumn("p", F.explode(F.array(*[F.lit(float(p) / scale) for p in ps])))


# --- plotting positions ---------------------------------------------------------------------
_POSITIONS = {
    "median": lambda m, n: (m - 0.3) / (n + 0.4),
    "weibull": lambda m, n: m / (n + 1),
    "hazen": lambda m, n: (m - 0.5) / n,
    "gringorten": lambda m, n: (m - 0.44) / (n + 0.12),
}


def plotting_positions(df: DataFrame, kinds=("median",), keys=("post",)) -> DataFrame:
    """Observations ranked from the largest, with their exceedance probabilities."""
    rows = order_rows(value_ranks(df, keys), keys)
    m, n = F.col("m"), F.col("n")
    return rows.select(*keys, "value", "n", "m", *[_POSITIONS[k](m, n).alias(f"p_{k}") for k in kinds])


# --- theoretical quantiles ------------------------------------------------------------------
def pearson3_quantile(mean: Column, cv: Column, z: Column) -> Column:
    """Pearson III value from its standard deviate, negative values cut at zero."""
    return F.greatest(mean + mean * F.greatest(F.abs(cv), F.lit(0.001)) * z, F.lit(0.0))


def pearson3_curve(params: DataFrame, ps, percent=False) -> DataFrame:
    d = probabilities(params, ps, percent).withColumn("z", pearson3_z_col("p", "cs"))
    return d.withColumn("q", pearson3_quantile(F.col("mean"), F.col("cv"), F.col("z")))


def kritsky_menkel_curve(params: DataFrame, ps, percent=False) -> DataFrame:
    """Three-parameter gamma: origin mean (1 - 2 Cv / Cs), shape 4 / Cs^2, scale mean Cv |Cs| / 2.

    For positive Cs this is Pearson III; for negative Cs the tail stays on the right, only the origin moves.
    """
    cs = F.when(F.abs("cs") < 0.001, F.lit(0.001)).otherwise(F.col("cs"))
    cv = F.greatest(F.abs("cv"), F.lit(0.001))
    d = probabilities(params.withColumn("_cs", cs).withColumn("_a", F.abs("_cs")), ps, percent).withColumn("z", pearson3_z_col("p", "_a"))
    moved = F.when(F.col("_cs") < 0, F.col("mean") * 4 * cv / F.col("_a")).otherwise(F.lit(0.0))
    q = F.greatest(F.col("mean") + moved + F.col("mean") * cv * F.col("z"), F.lit(0.0))
    return d.withColumn("q", q).drop("_cs", "_a")


def module_quantiles(params: DataFrame, ps=fixed.P_KM, percent=True) -> DataFrame:
    """Deviate, k_p = 1 + Cv z and Q_p; not cut at zero."""
    d = probabilities(params, ps, percent).withColumn("z", pearson3_z_col("p", "cs"))
    return d.withColumn("kp", 1 + F.col("cv") * F.col("z")).withColumn("q", F.col("mean") * F.col("kp"))


def empirical_quantiles(df: DataFrame, ps, keys=("post",)) -> DataFrame:
    """Straight lines between plotting points, ends held: position m = p (n + 0.4) + 0.3."""
    keys = list(keys)
    r = value_ranks(df, keys)
    n = F.col("n")
    aggs = [F.max("n").alias("n")]
    for j, p in enumerate(ps):
        m = F.least(F.greatest(F.lit(float(p)) * (n + 0.4) + 0.3, F.lit(1.0)), n.cast("double"))
        for tag, k in (("a", F.floor(m)), ("b", F.ceil(m))):
            # rank m from the top is the zero-based rank n - m from the bottom
            aggs.append(F.max(F.when((F.col("below") <= n - k) & (n - k < F.col("upto")), F.col("value"))).alias(f"_{tag}{j}"))
    got = r.groupBy(*keys).agg(*aggs)
    cells = []
    for j, p in enumerate(ps):
        m = F.least(F.greatest(F.lit(float(p)) * (n + 0.4) + 0.3, F.lit(1.0)), n.cast("double"))
        a, b = F.col(f"_a{j}"), F.col(f"_b{j}")
        cells.append(F.struct(F.lit(float(p)).alias("p"), (a + (b - a) * (m - F.floor(m))).alias("q")))
    return got.select(*keys, "n", F.explode(F.array(*cells)).alias("c")).select(*keys, "n", "c.*")


def frequency_curve(df: DataFrame, kind="pearson3", ps=fixed.P_CURVE) -> DataFrame:
    """normal, pearson3, kritsky_menkel, empirical (= piecewise) or none."""
    if kind in ("empirical", "piecewise"):
        return empirical_quantiles(df, ps).select("post", "p", "q")
    p = parameters(df)
    if kind == "pearson3":
        c = pearson3_curve(p, ps)
    elif kind == "kritsky_menkel":
        c = kritsky_menkel_curve(p, ps)
    elif kind == "none":
        c = probabilities(p, ps).withColumn("q", F.lit(None).cast("double"))
    else:
        c = probabilities(p, ps).withColumn("q", F.col("mean") + F.col("std") * normal_ppf_col(1 - F.col("p")))
    return c.select("post", "p", "q")


def design_discharges(df: DataFrame, levels=fixed.P_LEVELS, kind="pearson3") -> DataFrame:
    """For each level the nearest point of the curve (the first one on a tie)."""
    c = frequency_curve(df, kind)
    rows = c.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    gap = F.round(F.abs(F.col("p") - F.col("level")), 9)
    return rows.groupBy("post", "level").agg(F.min(F.struct(gap.alias("g"), "p", "q")).alias("b")).select(
        "post", "level", "b.p", "b.q"
    )


# --- Cs/Cv search ---------------------------------------------------------------------------
def _ratio_grid(lo, hi, step):
    return np.round(lo + step * np.arange(int(round((hi - lo) / step)) + 1), 10)


def ratio_scores(df: DataFrame, lo=-2.0, hi=6.0, step=0.05, p_range=None, curve="pearson3") -> DataFrame:
    """Sum of squares between observed values and a curve for every Cs/Cv of the grid.

    ``curve`` is ``pearson3`` or ``kritsky_menkel``.

    Rows are packed into bounded arrays per (post, block of ranks); one Arrow call scores a
    block against the whole grid, so only (post, ratio) partial sums are shuffled.
    """
    if curve not in ("pearson3", "kritsky_menkel"):
        raise ValueError(f"unknown curve {curve!r}")
    ratios = _ratio_grid(lo, hi, step)
    m = moments(df).filter(F.col("n") >= 5).select(
        "post", F.col("mean"), F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0)).alias("cv"))
    rows = plotting_positions(df)
    p = F.col("p_median")
    if p_range is not None:
        rows = rows.filter((p >= p_range[0]) & (p <= p_range[1]))
    packed = rows.groupBy("post", F.floor(F.col("m") / BLOCK).alias("mb")).agg(
        F.collect_list(F.struct(p.alias("p"), "value")).alias("a")
    )
    packed = spread(packed, m, block="mb")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(ps: pd.Series, xs: pd.Series, mean: pd.Series, cv: pd.Series) -> pd.Series:
        out = []
        for pp, xx, mu, c in zip(ps, xs, mean, cv):
            pp, xx = np.asarray(pp, float), np.asarray(xx, float)
            cs = ratios * c
            if curve == "kritsky_menkel":
                cs, v = np.where(np.abs(cs) < 0.001, 0.001, cs), max(abs(c), 0.001)
                z = pearson3_z(np.broadcast_to(pp, (len(cs), len(pp))), np.abs(cs)[:, None])
                q = np.maximum(mu + np.where(cs < 0, mu * 4 * v / np.abs(cs), 0.0)[:, None] + mu * v * z, 0.0)
                out.append(((xx[None, :] - q) ** 2).sum(axis=1))
                continue
            plain = np.abs(cs) < 1e-6
            z = pearson3_z(np.broadcast_to(pp, (len(cs), len(pp))), np.where(plain, 0.0, cs)[:, None])
            q = mu + mu * np.where(plain, c, max(abs(c), 0.001))[:, None] * z
            q = np.where(plain[:, None], q, np.maximum(q, 0.0))
            out.append(((xx[None, :] - q) ** 2).sum(axis=1))
        return pd.Series(out)

    s = packed.select("post", F.size("a").alias("k"), score(F.col("a.p"), F.col("a.value"), "mean", "cv").alias("ss"))
    s = s.select("post", "k", F.posexplode("ss").alias("j", "ss"))
    ratio = F.round(F.lit(float(lo)) + F.col("j") * float(step), 10)
    return s.groupBy("post", ratio.alias("ratio")).agg(F.sum("ss").alias("ss"), F.sum("k").alias("points")).filter(
        F.col("points") >= 3
    ).join(m, "post")


def best_ratio(df: DataFrame, **grid) -> DataFrame:
    """First minimum of :func:`ratio_scores` per post."""
    s = ratio_scores(df, **grid)
    return s.groupBy("post", "mean", "cv").agg(F.min(F.struct("ss", "ratio")).alias("b")).select(
        "post", "mean", "cv", F.col("b.ratio").alias("ratio"), (F.col("b.ratio") * F.col("cv")).alias("cs"), F.col("b.ss").alias("ss")
    )


def curve_variants(df: DataFrame) -> DataFrame:
    """Side by side: moments with Pearson III, with Cs = 2 Cv, and with the searched ratio."""
    p = parameters(df)
    pick = lambda d, name, cs: d.select(
        "post", F.lit(name).alias("variant"), "mean", "cv", cs.alias("cs"),
        F.when(F.col("cv") != 0, cs / F.col("cv")).alias("ratio"))
    return pick(p, "pearson3_moments", F.col("cs")).unionByName(pick(p, "kritsky_menkel_2cv", 2 * F.col("cv"))).unionByName(
        pick(best_ratio(df), "searched_ratio", F.col("cs")))


# --- tables of ordinates --------------------------------------------------------------------
def ordinate_table(spark, ratios=tuple(x / 2 for x in range(-2, 13)), cvs=tuple(x / 10 for x in range(1, 21)), ps=fixed.P_ORDINATES) -> DataFrame:
    """Ordinates k_p by rule: the gamma curve at each node (Cs/Cv, Cv), cut at zero.

    A printed table of the same shape can be passed to :func:`lookup_ordinates` instead.
    """
    nodes = spark.range(1).select(F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio"))
    nodes = nodes.withColumn("cv", F.explode(F.array(*[F.lit(float(c)) for c in cvs])))
    d = probabilities(nodes, ps, percent=True).withColumn("cs", F.col("ratio") * F.col("cv"))
    z = pearson3_z_col("p", "cs")
    return d.withColumn("k", F.greatest(1 + F.col("cv") * z, F.lit(0.0))).select("ratio", "cv", "p", "k")


def lookup_ordinates(params: DataFrame, table: DataFrame, ratios, cvs) -> DataFrame:
    """Bilinear lookup in (Cs/Cv, Cv), clamped to the table; then Q_p = k mean.

    The brackets come from the fixed node lists by arithmetic on columns, so the join is a plain
    equality on four corner keys and the table side (nodes times probabilities) is bounded.
    """
    def edges(x, nodes):
        nodes = sorted(float(v) for v in nodes)
        lo, hi = F.lit(nodes[-1]), F.lit(nodes[-1])
        for a, b in reversed(list(zip(nodes, nodes[1:]))):
            lo, hi = F.when(x <= b, F.lit(a)).otherwise(lo), F.when(x <= b, F.lit(b)).otherwise(hi)
        below = x <= nodes[0]
        return F.when(below, F.lit(nodes[0])).otherwise(lo), F.when(below, F.lit(nodes[0])).otherwise(hi)

    r, c = F.col("_r"), F.col("cv")
    d = params.withColumn("_r", F.when(F.col("cv") != 0, F.col("cs") / F.col("cv")).otherwise(F.lit(0.0)))
    r0, r1 = edges(r, ratios)
    c0, c1 = edges(c, cvs)
    frac = lambda x, a, b: F.when(b > a, (x - a) / (b - a)).otherwise(F.lit(0.0))
    d = d.withColumn("r0", r0).withColumn("r1", r1).withColumn("c0", c0).withColumn("c1", c1)
    wr, wc = frac(r, F.col("r0"), F.col("r1")), frac(c, F.col("c0"), F.col("c1"))
    corners = F.array(
        F.struct(F.col("r0").alias("r"), F.col("c0").alias("c"), ((1 - wr) * (1 - wc)).alias("w")),
        F.struct(F.col("r0").alias("r"), F.col("c1").alias("c"), ((1 - wr) * wc).alias("w")),
        F.struct(F.col("r1").alias("r"), F.col("c0").alias("c"), (wr * (1 - wc)).alias("w")),
        F.struct(F.col("r1").alias("r"), F.col("c1").alias("c"), (wr * wc).alias("w")),
    )
    e = d.select("post", "mean", F.explode(corners).alias("e")).select("post", "mean", "e.*")
    t = table.select(F.round("ratio", 6).alias("r"), F.round("cv", 6).alias("c"), "p", "k")
    e = e.withColumn("r", F.round("r", 6)).withColumn("c", F.round("c", 6))
    return e.join(F.broadcast(t), ["r", "c"]).groupBy("post", "mean", "p").agg(F.sum(F.col("w") * F.col("k")).alias("k")).withColumn(
        "q", F.col("k") * F.col("mean"))


# --- structure classes ----------------------------------------------------------------------
def structure_class(height: Column, volume: Column) -> Column:
    """Class by height, else by volume, else the strictest."""
    def by(x, bounds):
        e = F.when(x > bounds[0][1], bounds[0][0])
        for name, lo in bounds[1:]:
            e = e.when(x > lo, name)
        return e.otherwise("IV")

    return F.when(height.isNotNull(), by(height, fixed.CLASS_HEIGHT)).when(
        volume.isNotNull(), by(volume, fixed.CLASS_VOLUME)).otherwise("I")


def class_probability(cls: Column, case: str) -> Column:
    j = ("max_main", "max_check", "min_main", "min_check").index(case)
    e = None
    for name, v in fixed.STRUCTURE_P.items():
        e = F.when(cls == name, F.lit(v[j])) if e is None else e.when(cls == name, F.lit(v[j]))
    return e


def classify_structures(df: DataFrame, height="height", volume="volume") -> DataFrame:
    d = df.withColumn("structure_class", structure_class(F.col(height), F.col(volume)))
    for case in ("max_main", "max_check", "min_main", "min_check"):
        d = d.withColumn("p_" + case, class_probability(F.col("structure_class"), case))
    return d


def class_curve(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Curve per (post, class) at the standard probabilities and the two main ones of the class."""
    cls = F.col("structure_class")
    ps = F.array_sort(F.array_distinct(F.concat(
        F.array(*[F.lit(float(p)) for p in fixed.P_STRUCTURE]),
        F.array(class_probability(cls, "max_main"), class_probability(cls, "min_main")))))
    d = parameters(df).join(classes.select("post", "structure_class").distinct(), "post").withColumn("p", F.explode(ps))
    d = d.withColumn("z", pearson3_z_col("p", "cs"))
    return d.withColumn("q", pearson3_quantile(F.col("mean"), F.col("cv"), F.col("z"))).select("post", "structure_class", "p", "q")


def interpolate_curve(curve: DataFrame, targets: DataFrame, keys, log_p=False) -> DataFrame:
    """Clamped linear interpolation of q at ``target`` in p, or in ln p; curves are short."""
    f = (lambda c: F.log(c)) if log_p else (lambda c: c)
    packed = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "q"))).alias("_c"))
    d = targets.join(packed, list(keys))
    t = F.col("target")
    lo = F.element_at(F.filter("_c", lambda x: x["p"] <= t), -1)
    hi = F.get(F.filter("_c", lambda x: x["p"] >= t), F.lit(0))
    d = d.withColumn("_lo", F.when(t >= F.col("_c")[0]["p"], lo)).withColumn("_hi", hi).drop("_c")
    w = (f(t) - f(F.col("_lo.p"))) / (f(F.col("_hi.p")) - f(F.col("_lo.p")))
    q = F.when(F.col("_lo").isNull(), F.col("_hi.q")).when(F.col("_hi").isNull(), F.col("_lo.q")).when(
        F.col("_hi.p") == F.col("_lo.p"), F.col("_lo.q")).otherwise(
        F.col("_lo.q") + (F.col("_hi.q") - F.col("_lo.q")) * w)
    return d.withColumn("q", q).drop("_lo", "_hi")


def class_design_points(df: DataFrame, classes: DataFrame) -> DataFrame:
    curve = class_curve(df, classes)
    cls = F.col("structure_class")
    cases = F.explode(F.array(*[
        F.struct(F.lit(c).alias("case"), class_probability(cls, c).alias("target"))
        for c in ("max_main", "max_check", "min_main", "min_check")]))
    t = classes.select("post", "structure_class").distinct().select("post", "structure_class", cases.alias("x")).select("post", "structure_class", "x.*")
    return interpolate_curve(curve, t, ["post", "structure_class"])


# --- intervals, extremes, two-part and category curves --------------------------------------
def normal_interval(df: DataFrame, ps, confidence=0.95) -> DataFrame:
    """Q_p plus or minus z mean Cv / sqrt(n)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    c = pearson3_curve(parameters(df), ps)
    se = F.col("mean") * F.col("cv") / F.sqrt("n")
    return c.select("post", "p", "q", se.alias("std_error"), (F.col("q") - z * se).alias("q_low"), (F.col("q") + z * se).alias("q_high"))


def with_historical_extremes(df: DataFrame, extremes: DataFrame, is_max=True) -> DataFrame:
    """Correct mean and Cv by extremes known from before the record (post, year, value, period)."""
    m = moments(df).filter(F.col("n") >= 3).select(
        "post", "n", F.col("mean").alias("mean_raw"),
        F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0)).alias("cv_raw"))
    x, mean = F.col("value"), F.col("mean_raw")
    beyond = F.when(x > mean, x - mean) if is_max else F.when(x < mean, mean - x)
    e = extremes.join(m, "post")
    shift = e.groupBy("post").agg(
        F.sum(F.coalesce(beyond, F.lit(0.0)) / (F.col("n") + 1)).alias("delta_mean"),
        F.sum("value").alias("_s1"), F.sum(x * x).alias("_s2"), F.count(x).alias("_k"))
    d = m.join(shift, "post", "left").fillna(0.0, ["delta_mean", "_s1", "_s2"]).fillna(0, ["_k"])
    mc = F.col("mean_corrected")
    d = d.withColumn("mean_corrected", F.col("mean_raw") + F.col("delta_mean"))
    extra = (F.col("_s2") - 2 * mc * F.col("_s1") + F.col("_k") * mc * mc) / (mc * mc) / (F.col("n") + 1)
    return d.withColumn("cv_corrected", F.sqrt(F.col("cv_raw") * F.col("cv_raw") + extra)).select(
        "post", "n", "mean_raw", "cv_raw", "delta_mean", "mean_corrected", "cv_corrected")


def extreme_probability(extremes: DataFrame) -> DataFrame:
    return extremes.withColumn("p", 1 / (F.col("period") + 0.5))


def two_part_curve(df: DataFrame, year: int, ps=fixed.P_TWO_PART, normative=True) -> DataFrame:
    """Curve of each part (before / from a year) and their mean weighted by length."""
    from hydrosheaf.operators.trend import split_by_year

    p = annual_runoff_stats(split_by_year(observed(df), year), ["post", "part"], normative)
    c = pearson3_curve(p, ps)
    side = lambda k: F.max(F.when(F.col("part") == k, F.col("q")))
    return c.groupBy("post", "p").agg(
        side(1).alias("q1"), side(2).alias("q2"), (F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("q"))


def composite_curve(df: DataFrame, ps=fixed.P_COMPOSITE, points: int = 200) -> DataFrame:
    """Curve of a post whose years fall in categories: P(Q) = sum n_i P_i(Q) / N, inverted.

    Only curves (19 points per category) and a 200-point grid per post are handled here; the
    observations enter through their grouped moments.
    """
    m = moments(df, ["post", "category"])
    m = m.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0)))
    span = m.groupBy("post").agg(
        F.sum("n").alias("total"), F.greatest(F.min("min") * 0.5, F.lit(0.0)).alias("q0"), (F.max("max") * 1.5).alias("q1"),
        F.count(F.lit(1)).alias("cats")).filter((F.col("total") >= 5) & (F.col("cats") >= 2))
    curve = pearson3_curve(m.filter(F.col("n") >= 3), fixed.P_BANDS).groupBy("post", "category", "n").agg(
        F.array_sort(F.collect_list(F.struct("q", "p"))).alias("c"))
    grid = span.select("post", "total", F.posexplode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g", "_x"), "q0", "q1").withColumn(
        "x", F.col("q0") + (F.col("q1") - F.col("q0")) / (points - 1) * F.col("g"))
    d = grid.join(curve, "post")
    x = F.col("x")
    lo = F.element_at(F.filter("c", lambda e: e["q"] <= x), -1)
    hi = F.get(F.filter("c", lambda e: e["q"] > x), F.lit(0))
    d = d.withColumn("_lo", F.when(x >= F.col("c")[0]["q"], lo)).withColumn("_hi", hi)
    first, last = F.col("c")[0]["p"], F.element_at("c", -1)["p"]
    inner = F.col("_lo.p") + (F.col("_hi.p") - F.col("_lo.p")) * (x - F.col("_lo.q")) / (F.col("_hi.q") - F.col("_lo.q"))
    p = F.when(F.col("_lo").isNull(), first).when(F.col("_hi").isNull(), last).otherwise(inner)
    p = F.least(F.greatest(p, F.lit(0.0001)), F.lit(0.9999))
    mix = d.groupBy("post", "g", "x", "total").agg((F.sum(p * F.col("n")) / F.col("total")).alias("pc"))
    # the ends are flat at 0.001 and 0.999: rounding keeps them exactly flat
    pc = F.round(F.least(F.greatest(F.col("pc"), F.lit(0.0001)), F.lit(0.9999)), 12)
    # invert: p falls with x, so order from the largest x
    w = W.partitionBy("post").orderBy("g")  # 200 grid rows per post
    seg = mix.select("post", "g", "x", pc.alias("pc")).withColumn("px", F.lag("x").over(w)).withColumn("pp", F.lag("pc").over(w))
    ends = seg.groupBy("post").agg(F.max(F.struct("g", "x", "pc")).alias("top"), F.min(F.struct("g", "x", "pc")).alias("low"))
    t = probabilities(ends, ps)
    hit = t.join(seg, "post").filter((F.col("pc") <= F.col("p")) & (F.col("p") < F.col("pp")))
    inv = hit.withColumn("q", F.col("x") + (F.col("px") - F.col("x")) * (F.col("p") - F.col("pc")) / (F.col("pp") - F.col("pc")))
    one = inv.groupBy("post", "p").agg(F.max(F.struct("g", "q")).alias("b")).select("post", "p", F.col("b.q").alias("q"))
    return t.join(one, ["post", "p"], "left").select(
        "post", "p",
        F.coalesce("q", F.when(F.col("p") < F.col("top.pc"), F.col("top.x")).otherwise(F.col("low.x"))).alias("q"))


def max_runoff_curve(df: DataFrame, ps=fixed.P_MAX) -> DataFrame:
    return pearson3_curve(max_runoff_stats(df), ps, percent=True).withColumn(
        "kp", F.when(F.col("mean") != 0, F.col("q") / F.col("mean"))).select("post", "p", "q", "kp")


def min_runoff_curve(df: DataFrame, ps=fixed.P_MIN, keys=("post",)) -> DataFrame:
    return module_quantiles(annual_runoff_stats(df, keys), ps).select(*keys, "p", "q")


def index_year_curve(df: DataFrame, dims: DataFrame, ps=fixed.P_INDEX) -> DataFrame:
    """Ratios of maxima to the gauged mean flow give K_p, applied to the ungauged mean flow."""
    d = dims.filter(F.col("gauged_mean") > 0)
    # Cv and lag-one correlation do not change when a series is divided by a constant
    p = annual_runoff_stats(df).join(d, "post").withColumn("mean", F.col("mean") / F.col("gauged_mean"))
    return pearson3_curve(p, ps, percent=True).select(
        "post", "p", F.col("q").alias("kp"), (F.col("q") * F.col("target_mean")).alias("q"))


def l_moments(df: DataFrame, as_reference=False) -> DataFrame:
    """Probability weighted moments from ranks alone; ties need no order.

    ``as_reference`` uses weights 1 - i/(n+1) on the ascending order (lambda2 is then negative).
    """
    r = value_ranks(df)
    c, b, u, n = F.col("c").cast("double"), F.col("below").cast("double"), F.col("upto").cast("double"), F.col("n").cast("double")
    s1 = (u * (u + 1) - b * (b + 1)) / 2
    s2 = (u * (u + 1) * (2 * u + 1) - b * (b + 1) * (2 * b + 1)) / 6
    w1, w2 = s1 / (n + 1), s2 / ((n + 1) * (n + 1))
    if as_reference:
        w1, w2 = c - w1, c - 2 * w1 + w2
    x = F.col("value")
    g = r.groupBy("post").agg(
        F.max("n").alias("n"), (F.sum(x * c) / F.max("n")).alias("b0"), (F.sum(x * w1) / F.max("n")).alias("b1"),
        (F.sum(x * w2) / F.max("n")).alias("b2")).filter(F.col("n") >= 5)
    l2 = 2 * F.col("b1") - F.col("b0")
    l3 = 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")
    tau = F.when(F.abs(l2) > 1e-10, l3 / l2).otherwise(F.lit(0.0))
    cv = F.when(F.col("b0") != 0, l2 / F.col("b0")).otherwise(F.lit(0.0))
    return g.select(
        "post", "n", F.col("b0").alias("mean"), cv.alias("cv"), F.when(F.abs(cv) > 1e-10, tau / cv).otherwise(F.lit(0.0)).alias("cs"),
        F.col("b0").alias("lambda1"), l2.alias("lambda2"), l3.alias("lambda3"), tau.alias("tau3"))
