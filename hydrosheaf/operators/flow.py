"""Daily and monthly flow: extremes, duration, regime, baseflow, drought, spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrosheaf.functions import fixed
from hydrosheaf.operators.fourier import fourier_sums
from hydrosheaf.operators.freq import module_quantiles
from hydrosheaf.operators.stats import annual_runoff_stats
from hydrosheaf.plans.carry import compress, scan
from hydrosheaf.plans.ordering import (
    block_of, fill_edges, histogram, observed, quantiles, ranks_of, rolling, running, sequence, spread, value_ranks,
)


def day(t: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), t.cast("int"))


# --- annual extremes ------------------------------------------------------------------------
def _yearly_windows(df: DataFrame, rows: int, months=None) -> DataFrame:
    """Moving mean of ``rows`` rows inside each calendar year (at most 366 rows per group)."""
    d = observed(df).withColumn("year", F.year(day(F.col("t"))))
    if months:
        d = d.filter(F.month(day(F.col("t"))).isin(*months))
    w = W.partitionBy("post", "year").orderBy("t")
    full = F.row_number().over(w) >= rows
    mean = F.avg("value").over(w.rowsBetween(-(rows - 1), 0))
    return d.withColumn("ma", F.when(full, mean))


def annual_maxima(df: DataFrame, rows: int = 1) -> DataFrame:
    """Largest moving mean of the year; a year shorter than the window gives its plain maximum."""
    d = _yearly_windows(df, rows)
    return d.groupBy("post", "year").agg(F.coalesce(F.max("ma"), F.max("value")).alias("value")).select(
        "post", F.col("year").cast("bigint").alias("t"), "value")


def annual_minima(df: DataFrame, rows: int = 7, season: str = "annual") -> DataFrame:
    """Smallest moving mean of the year or season; shorter years are left out."""
    d = _yearly_windows(df, rows, fixed.SEASON_MONTHS.get(season))
    return d.groupBy("post", "year").agg(F.min("ma").alias("value")).filter(F.col("value").isNotNull()).select(
        "post", F.col("year").cast("bigint").alias("t"), "value")


def annual_extremes(df: DataFrame) -> DataFrame:
    """Flagship: 1-day and 7-day annual maxima with design statistics and empirical position."""
    from hydrosheaf.operators.freq import plotting_positions
    from hydrosheaf.operators.stats import max_runoff_stats

    both = annual_maxima(df, 1).withColumn("window", F.lit(1)).unionByName(annual_maxima(df, 7).withColumn("window", F.lit(7)))
    pos = plotting_positions(both, ("median",), ("post", "window"))
    st = max_runoff_stats(both, ("post", "window")).select("post", "window", "mean", "cv", "cs", "epsilon")
    return pos.join(st, ["post", "window"])


def low_flow_quantile(df: DataFrame, rows: int = 7, ps=(90,)) -> DataFrame:
    """Annual minima of ``rows`` days -> normative statistics -> quantiles (7Q10 is P = 90)."""
    st = annual_runoff_stats(annual_minima(df, rows)).filter(F.col("n") >= 3)
    return module_quantiles(st, ps).select("post", "p", "q", "n", "mean", "cv")


def compare_low_flow(df: DataFrame) -> DataFrame:
    """Ten percent rule, 7/10/30-day minima at 90/95/99 and 7Q10, set against the ecological flow."""
    mean = observed(df).groupBy("post").agg(F.avg("value").alias("qm"))
    rows = mean.select("post", F.lit("10 percent").alias("method"), F.lit(None).cast("double").alias("p"), (0.1 * F.col("qm")).alias("q"))
    for k in (7, 10, 30):
        q = low_flow_quantile(df, k, (90, 95, 99)).select("post", F.lit(f"{k}-day minimum").alias("method"), "p", "q")
        rows = rows.unionByName(q)
        if k == 7:
            rows = rows.unionByName(q.filter(F.col("p") == 0.9).withColumn("method", F.lit("7Q10")))
    eco = 0.1 * F.col("qm")
    return rows.join(mean, "post").select(
        "post", "method", "p", "q",
        F.when(F.col("method") == "10 percent", "within norm").when(F.col("q") < eco, "below ecological").otherwise("above ecological").alias("status"))


# --- peaks over threshold -------------------------------------------------------------------
def islands(seq: DataFrame, cond: Column) -> DataFrame:
    """Rows that satisfy ``cond`` with a run number per post: (post, i, t, value, run)."""
    hits = seq.filter(cond).select("post", F.col("i").alias("t"), F.col("t").alias("_t"), "value")
    s = sequence(hits).withColumn("_new", F.coalesce((F.col("t") - F.col("prev_t") > 1).cast("bigint"), F.lit(1)))
    r = running(s.select("post", "t", "_t", "value", "blk", "_new"), F.col("_new"), "run")
    return r.select("post", F.col("t").alias("i"), F.col("_t").alias("t"), "value", "run")


def _pot_summary(sep):
    def summary(start, end):
        # thresholds: run ends; result: where the search stands after the chain that begins at a run
        out = np.empty(len(end))
        for j in range(len(end) - 1, -1, -1):
            pos = end[j] + 1 + sep
            k = int(np.searchsorted(end, pos, side="left"))
            out[j] = out[k] if k < len(end) else pos
        th, res = compress(end, out)
        return th, res, (1.0, 0.0, np.inf)

    return summary


def _pot_run(sep):
    def run(pos, start, end):
        # start of the part of each run that is used, or nan when the run is skipped
        out = []
        for s, e in zip(start, end):
            if e >= pos:
                out.append(float(max(s, pos)))
                pos = e + 1 + sep
            else:
                out.append(None)
        return out

    return run


def peaks_over_threshold(df: DataFrame, percentile: float = 95.0, separation: int = 5) -> DataFrame:
    """Peak of every run at or above the threshold; after a run ``separation`` rows are skipped."""
    seq = sequence(observed(df)).select("post", "t", "value", "i", "n", "blk")
    th = quantiles(value_ranks(df), {"threshold": percentile / 100}).drop("n")
    hit = islands(spread(seq, th), F.col("value") >= F.col("threshold"))
    runs = hit.groupBy("post", "run").agg(F.min("i").alias("s"), F.max("i").alias("e"))
    if separation > 0:
        chain = runs.select("post", F.col("run").alias("i"), F.col("s").cast("double").alias("x"), F.col("e").cast("double").alias("y"))
        used = scan(chain, _pot_summary(separation), _pot_run(separation), 0.0)
        runs = used.filter(F.col("state").isNotNull()).select("post", F.col("i").alias("run"), F.col("state").alias("s"))
    # a run may be long: the pick is a partial aggregate, not a window
    best = hit.join(runs.select("post", "run", "s"), ["post", "run"]).filter(F.col("i") >= F.col("s")).groupBy("post", "run").agg(
        F.max(F.struct("value", (-F.col("i")).alias("j"), "t")).alias("b"))
    return best.join(th, "post").select("post", "run", (-F.col("b.j") - 1).alias("index"), F.col("b.t").alias("t"), F.col("b.value").alias("value"), "threshold")


def peak_rate(df: DataFrame, percentile: float = 95.0, separation: int = 5) -> DataFrame:
    n = observed(df).groupBy("post").agg(F.count(F.lit(1)).alias("n"))
    p = peaks_over_threshold(df, percentile, separation).groupBy("post", "threshold").agg(F.count(F.lit(1)).alias("n_peaks"))
    return n.join(p, "post").withColumn("annual_rate", F.col("n_peaks") / (F.col("n") / 365.25))


# --- months ---------------------------------------------------------------------------------
def water_year_sums(monthly: DataFrame, non_limiting=fixed.NON_LIMITING, limiting=fixed.LIMITING, season=fixed.LIMITING_SEASON, start_month: int = 1) -> DataFrame:
    """Sums of the year, the non-limiting and limiting periods and the limiting season.

    ``start_month`` other than 1 counts the months from it on to the next year.
    """
    m, v = F.col("month"), F.col("value")
    year = F.col("year") + (m >= start_month).cast("int") if start_month > 1 else F.col("year")
    part = lambda ms: F.sum(F.when(m.isin(*ms), v).otherwise(F.lit(0.0)))
    return monthly.groupBy("post", year.cast("bigint").alias("year")).agg(
        part(tuple(non_limiting) + tuple(limiting)).alias("sum_year"), part(non_limiting).alias("sum_non_limiting"),
        part(limiting).alias("sum_limiting"), part(season).alias("sum_season"))


def intra_annual_stats(sums: DataFrame) -> DataFrame:
    long = sums.unpivot(["post", "year"], ["sum_year", "sum_non_limiting", "sum_limiting", "sum_season"], "part", "value")
    return annual_runoff_stats(long.withColumnRenamed("year", "t"), ("post", "part"))


def model_year(sums: DataFrame, p: float = 90.0, by: str = "sum_limiting") -> DataFrame:
    """Year whose sum lies nearest the P-quantile, the earliest one on a tie."""
    s = sums.select("post", F.col("year").alias("t"), F.col(by).alias("value"))
    target = module_quantiles(annual_runoff_stats(s), (p,)).select("post", F.col("q").alias("target_sum"))
    d = s.join(target, "post").withColumn("delta", F.abs(F.col("value") - F.col("target_sum")))
    return d.groupBy("post", "target_sum").agg(F.min(F.struct("delta", "t")).alias("b")).select(
        "post", F.col("b.t").alias("year"), "target_sum", F.col("b.delta").alias("delta"))


def distribute_by_model_year(monthly: DataFrame, model: DataFrame, annual_sum="annual_sum") -> DataFrame:
    """Month shares (%) of the model year, two decimals, times the annual sum."""
    d = monthly.join(model.select("post", "year", annual_sum), ["post", "year"])
    total = F.sum("value").over(W.partitionBy("post", "year"))  # twelve rows
    share = F.round(F.col("value") / total * 100, 2)
    return d.withColumn("_t", total).filter(F.col("_t") != 0).select(
        "post", "year", "month", share.alias("share"), F.round(share / 100 * F.col(annual_sum), 2).alias("discharge"))


def months_from_text(text: str) -> list[int]:
    """'11-3' -> [11, 12, 1, 2, 3]; lists like '4,6-8' are allowed too."""
    out: list[int] = []
    for token in text.replace(";", ",").split(","):
        token = token.strip()
        if not token:
            continue
        a, _, b = token.partition("-")
        a, b = int(a), int(b or a)
        if not (1 <= a <= 12 and 1 <= b <= 12):
            raise ValueError(f"month out of range: {token}")
        out += [(a - 1 + k) % 12 + 1 for k in range((b - a) % 12 + 1)]
    return list(dict.fromkeys(out))


ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")    # fixed values


def months_to_text(months: Column) -> Column:
    """An array of months in Roman numerals joined by dashes; other numbers stay as they are."""
    names = F.array(*map(F.lit, ROMAN))
    name = lambda m: F.when(m.between(1, 12), F.get(names, m.cast("int") - 1)).otherwise(m.cast("string"))
    return F.array_join(F.transform(months, name), "–")


def period_table(spark, **periods: str) -> DataFrame:
    """Month definition table (period, month) from texts such as winter='11-3'."""
    rows = [(k, m) for k, text in periods.items() for m in months_from_text(text)]
    return spark.createDataFrame(rows, "period string, month bigint")


# --- duration and regime --------------------------------------------------------------------
def flow_duration(df: DataFrame, ps=fixed.P_DURATION) -> DataFrame:
    q = quantiles(value_ranks(df), {f"q{j}": 1 - p for j, p in enumerate(ps)})
    cells = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"q{j}").alias("q")) for j, p in enumerate(ps)]))
    return q.select("post", "n", cells.alias("c")).select("post", "n", "c.*")


def duration_percentiles(df: DataFrame, ps=fixed.DURATION_PERCENTILES) -> DataFrame:
    return quantiles(value_ranks(df), {f"q{p}": (100 - p) / 100 for p in ps})


def slope_index(df: DataFrame) -> DataFrame:
    q = quantiles(value_ranks(df), {"q10": 0.9, "q50": 0.5, "q90": 0.1, "q2": 0.98, "q98": 0.02})
    m = observed(df).groupBy("post").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    span = float(np.log(0.98) - np.log(0.02))
    n_value = F.when((F.col("q98") > 0) & (F.col("q2") > 0), (F.log("q2") - F.log("q98")) / span).otherwise(F.lit(0.0))
    return q.join(m, "post").select(
        "post", "n", n_value.alias("n_value"), F.when(F.col("q90") > 0, F.col("q10") / F.col("q90")).alias("ratio_10_90"),
        F.when(F.col("q90") > 0, F.col("q50") / F.col("q90")).alias("ratio_50_90"), "q10", "q50", "q90",
        F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(F.lit(0.0)).alias("cv"))


def regime_class(df: DataFrame) -> DataFrame:
    s = slope_index(df)
    cv, n = F.col("cv"), F.col("n_value")
    return s.select(
        "post", "n_value", "cv",
        F.when((cv > 0.6) | (n > 1.5), "highly_variable").when((cv > 0.4) | (n > 0.8), "moderately_variable").otherwise("stable").alias("regime"),
        F.when(F.col("ratio_10_90") > 10, "strong").when(F.col("ratio_10_90") > 3, "moderate").otherwise("weak").alias("contrast"))


def exceedance_share(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Share of observations at or above each level of the post (post, level).

    Levels are ranked among the values, as values that no row holds: one ranking in value blocks serves any
    number of levels.  Null levels and posts without an observation have no share.
    """
    asked = levels.select("post", F.col("level").cast("double").alias("value")).filter(F.col("value").isNotNull()).distinct()
    values = histogram(observed(df)).unionByName(asked.withColumn("c", F.lit(0).cast("bigint")))
    ranks = ranks_of(values.groupBy("post", "value").agg(F.sum("c").alias("c")))
    n = F.col("n")
    return ranks.filter(n > 0).join(asked, ["post", "value"]).select("post", F.col("value").alias("level"), ((n - F.col("below")) / n).alias("p"))


def eco_class(ratio: Column) -> Column:
    e = None
    for name, r in fixed.ECO_RATIO:
        e = F.when(ratio <= 2 * r, name) if e is None else e.when(ratio <= 2 * r, name)
    return e.otherwise("VI")


def eco_classes(df: DataFrame) -> DataFrame:
    """Class I..VI of every observation by its ratio to the post mean, counted."""
    d = observed(df).withColumn("blk", block_of(F.col("t")))
    m = d.groupBy("post").agg(F.avg("value").alias("mean"))
    ratio = F.col("value") / F.col("mean")
    cls = F.when(F.col("mean") <= 0, "I").otherwise(eco_class(ratio))
    return spread(d, m).groupBy("post", cls.alias("class")).agg(F.count(F.lit(1)).alias("days"), F.avg(ratio).alias("mean_ratio"))


def seasonal_ecological_flow(monthly_means: DataFrame, region: str = "central") -> DataFrame:
    """alpha Q_mean (Q_month / Q_mean) ^ beta per month; ``monthly_means``: post, month, value."""
    a, b = fixed.SEASONAL_FLOW.get(region, fixed.SEASONAL_FLOW["central"])
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col("month").cast("int"))
    mean = monthly_means.groupBy("post").agg(F.avg("value").alias("qm"))
    q = F.greatest("value", F.lit(0.01))
    r = F.greatest(F.when(F.col("qm") > 0, q / F.col("qm")).otherwise(F.lit(1.0)), F.lit(0.01))
    return monthly_means.join(mean, "post").select(
        "post", "month", q.alias("q_month"), pick(a).alias("alpha"), pick(b).alias("beta"),
        (pick(a) * F.col("qm") * F.pow(r, pick(b))).alias("q_eco"), "qm")


def ecosystem_minimum(means: DataFrame, mean="mean") -> DataFrame:
    q = F.col(mean)
    rows = F.explode(F.array(
        F.struct(F.lit("tenpct").alias("method"), (0.1 * q).alias("q_eco")),
        F.struct(F.lit("tessmann").alias("method"), (0.2 * q * (1 + 0.5 * float(np.log(1 / 0.9)))).alias("q_eco")),
        F.struct(F.lit("7q10").alias("method"), (0.4 * q).alias("q_eco"))))
    d = means.filter(q > 0).select("post", q.alias("mean"), rows.alias("r")).select("post", "mean", "r.*")
    return d.withColumn("compliance", F.when(F.col("method") == "7q10", "to be refined").when(
        F.col("q_eco") < 0.1 * F.col("mean"), "below norm").when(F.col("q_eco") <= 0.3 * F.col("mean"), "within norm").otherwise("above norm"))


def min_flow_comparison(df: DataFrame, monthly: DataFrame) -> DataFrame:
    """Ten, thirty and twenty-five percent rules, 7Q10 and the mean seasonal flow, per post."""
    m = observed(df).groupBy("post").agg(F.avg("value").alias("qm"))
    row = lambda name, e: m.select("post", F.lit(name).alias("method"), e.alias("q"))
    mm = monthly.groupBy("post", "month").agg(F.avg("value").alias("value"))
    ratio = mm.join(mm.groupBy("post").agg(F.avg("value").alias("_a")), "post").join(m, "post")
    # month means rescaled to the mean flow of the post
    seas = seasonal_ecological_flow(ratio.select("post", "month", (F.col("value") / F.col("_a") * F.col("qm")).alias("value")))
    return (
        row("10 percent", 0.1 * F.col("qm")).unionByName(row("30 percent", 0.3 * F.col("qm"))).unionByName(row("tessmann", 0.25 * F.col("qm")))
        .unionByName(low_flow_quantile(df, 7, (90,)).select("post", F.lit("7Q10").alias("method"), "q"))
        .unionByName(seas.groupBy("post").agg(F.avg("q_eco").alias("q")).select("post", F.lit("seasonal").alias("method"), "q")))


def wetted_perimeter(df: DataFrame, keys=("section",)) -> DataFrame:
    """Q at the smallest slope dP/dQ of a section's (q, perimeter) points, the first on a tie."""
    seq = sequence(df.select(*keys, F.col("q").alias("t"), F.col("perimeter").alias("value")), keys, width=1)
    slope = (F.col("next") - F.col("value")) / (F.col("next_t") - F.col("t"))
    d = seq.filter(F.col("next_t").isNotNull()).select(*keys, slope.alias("slope"), F.col("t").alias("q"), F.col("value").alias("perimeter"))
    return d.groupBy(*keys).agg(F.min(F.struct("slope", "q", "perimeter")).alias("b")).select(
        *keys, F.col("b.q").alias("q_eco"), F.col("b.perimeter").alias("p_eco"), F.col("b.slope").alias("slope"))


# --- baseflow -------------------------------------------------------------------------------
def baseflow_straight_line(df: DataFrame, min_separation: int = 5) -> DataFrame:
    """Lines between strict local peaks (their minimum when close), zero outside, within 0..Q.

    A post with fewer than two peaks takes 0.3 Q.
    """
    seq = sequence(observed(df)).select("post", "t", "value", "i", "prev", "next", "blk")
    q = F.col("value")
    peak = F.coalesce((q > F.col("prev")) & (q > F.col("next")), F.lit(False))
    peaks = seq.filter(peak).select("post", F.col("i").alias("t"), "value")
    info = sequence(peaks).select("post", F.col("t").alias("i"), F.struct(
        F.col("t").alias("i"), "value", F.col("next_t").alias("ni"), F.col("next").alias("nv"),
        F.col("prev_t").alias("pi"), F.col("prev").alias("pv")).alias("peak"))
    counts = peaks.groupBy("post").agg(F.count(F.lit(1)).alias("peaks"))
    d = spread(fill_edges(seq.join(info, ["post", "i"], "left"), F.col("peak")), counts, how="left")
    at = F.col("left")
    # the last peak closes the segment before it; rows behind it have none
    last = at["ni"].isNull()
    i0, v0 = F.when(last, at["pi"]).otherwise(at["i"]), F.when(last, at["pv"]).otherwise(at["value"])
    i1, v1 = F.when(last, at["i"]).otherwise(at["ni"]), F.when(last, at["value"]).otherwise(at["nv"])
    inside = at.isNotNull() & (F.col("i") <= i1)
    line = F.when(i1 - i0 > min_separation, v0 + (v1 - v0) * (F.col("i") - i0) / (i1 - i0)).otherwise(F.least(v0, v1))
    base = F.when(F.coalesce("peaks", F.lit(0)) < 2, 0.3 * q).otherwise(F.coalesce(F.when(inside, line), F.lit(0.0)))
    return d.select("post", "t", "value", F.least(F.greatest(base, F.lit(0.0)), q).alias("baseflow"))


def _filter_summary(alpha):
    def summary(x, first):
        # intervals of the incoming state that have met a reset, with their states now; the rest is scale * s + c.
        # A row that resets more of the rest resets all intervals below it, so with flows of zero or more
        # they become one; intervals that agree are always merged
        theta, state = [], []
        c, scale = 0.0, 1.0
        for q, start in zip(x.tolist(), first.tolist()):
            if start:
                # the first row of a post ignores what came before
                limit, theta, state = np.inf, [], []
            elif scale > 0:
                limit = (q - c) / scale
            else:
                limit = np.inf if q >= c else -np.inf
            state = [alpha * b + (1 - alpha) * q if q < b else 0.5 * q for b in state]
            if limit > (theta[-1] if theta else -np.inf):
                theta.append(limit)
                state.append(0.5 * q)
            if len(theta) > 1:
                theta, state = compress(theta, state)
            c = alpha * c + (1 - alpha) * q
            scale *= alpha
        return theta, state, (scale, c, np.inf)

    return summary


def _filter_run(alpha):
    def run(s, x, first):
        out, b = [], s
        for k in range(len(x)):
            b = alpha * b + (1 - alpha) * x[k] if x[k] < b and not first[k] else 0.5 * x[k]
            out.append(float(b))
        return out

    return run


def baseflow_digital_filter(df: DataFrame, alpha: float = 0.925) -> DataFrame:
    """b = alpha b' + (1 - alpha) Q while Q < b', else Q / 2; finally within 0..Q.

    More passes or a threshold up to one do not change this recurrence.
    """
    seq = sequence(observed(df)).select("post", "t", "value", "i")
    rows = seq.select("post", "i", F.col("value").alias("x"), (F.col("i") == 1).cast("double").alias("y"))
    s = scan(rows, _filter_summary(alpha), _filter_run(alpha), 0.0)
    q = F.col("value")
    return seq.join(s, ["post", "i"]).select("post", "t", "value", F.least(F.greatest("state", F.lit(0.0)), q).alias("baseflow"))


def _lyne_summary(a):
    def summary(x, prev):
        p, q, r = 1.0, 0.0, np.inf
        for k in range(len(x)):
            if np.isnan(prev[k]):
                p, q, r = 0.0, 0.5 * x[k], np.inf
                continue
            h = (1 - a) / 2 * (x[k] + prev[k])
            p, q, r = a * p, a * q + h, min(a * r + h, x[k])
        return [], [], (p, q, r)

    return summary


def _lyne_run(a):
    def run(s, x, prev):
        out, b = [], s
        for k in range(len(x)):
            b = 0.5 * x[k] if np.isnan(prev[k]) else min(a * b + (1 - a) / 2 * (x[k] + prev[k]), x[k])
            out.append(float(b))
        return out

    return run


def baseflow_lyne_hollick(df: DataFrame, a: float = 0.97) -> DataFrame:
    """b = min(a b' + (1 - a) / 2 (Q + Q'), Q), begun at half the first flow."""
    seq = sequence(observed(df)).select("post", "t", "value", "i", "prev")
    rows = seq.select("post", "i", F.col("value").alias("x"), F.col("prev").alias("y"))
    s = scan(rows, _lyne_summary(a), _lyne_run(a), 0.0)
    return seq.join(s, ["post", "i"]).select("post", "t", "value", F.greatest("state", F.lit(0.0)).alias("baseflow"))


def baseflow_statistics(bf: DataFrame) -> DataFrame:
    """Mean, extremes, ratio, and the share of steps that change by less than 0.1 deviation."""
    b = F.col("baseflow")
    sd = bf.groupBy("post").agg(F.stddev_pop("baseflow").alias("_sd"))
    flow = sequence(bf.select("post", "t", b.alias("value"), F.col("value").alias("flow")))
    d = spread(flow, sd)
    steady = F.abs(F.col("value") - F.col("prev")) < 0.1 * F.col("_sd")
    return d.groupBy("post").agg(
        F.avg("value").alias("bf_mean"), F.min("value").alias("bf_min"), F.max("value").alias("bf_max"),
        (F.avg("value") / F.avg("flow")).alias("bf_ratio"), (F.count_if(steady) / F.count(F.lit(1)) * 100).alias("steady_percent"))


# --- drought --------------------------------------------------------------------------------
def spi(df: DataFrame, scale: int = 3) -> DataFrame:
    """Standardised moving sum (null counts as zero); leading positions are zero.

    As in the reference this is a z-score, not a gamma transform.
    """
    seq = sequence(df.withColumn("value", F.coalesce("value", F.lit(0.0)))).select("post", "t", "value", "i", "n", "blk")
    r = rolling(seq, scale, {"total": F.sum("value")})
    m = r.filter("full").groupBy("post").agg(F.avg("total").alias("_m"), F.stddev_samp("total").alias("_sd"), F.count(F.lit(1)).alias("_k"))
    d = spread(r.select("post", "t", "i", "blk", "total", "full"), m, how="left")
    z = (F.col("total") - F.col("_m")) / F.col("_sd")
    return d.select("post", "t", "i", "full", F.when(F.col("full") & (F.col("_k") >= 3) & (F.col("_sd") > 0), z).otherwise(F.lit(0.0)).alias("spi"))


def spei(precip: DataFrame, pet: DataFrame, scale: int = 3) -> DataFrame:
    """The same index of precipitation minus evaporation demand on common steps."""
    b = precip.join(pet.select("post", "t", F.col("value").alias("_e")), ["post", "t"])
    return spi(b.select("post", "t", (F.col("value") - F.col("_e")).alias("value")), scale)


def drought_class(x: Column) -> Column:
    return (
        F.when(x >= 2, "extremely_wet").when(x >= 1.5, "very_wet").when(x >= 1, "moderately_wet").when(x >= 0, "slightly_wet")
        .when(x >= -1, "slightly_dry").when(x >= -1.5, "moderately_dry").when(x >= -2, "severely_dry").otherwise("extremely_dry"))


def drought_events(index: DataFrame, threshold: float = -1.0, keep_open: bool = True) -> DataFrame:
    """Runs below the threshold; ``keep_open`` keeps the run that reaches the end of the record."""
    seq = sequence(index.select("post", "t", F.col("spi").alias("value"))).select("post", "t", "value", "i", "n")
    ends = seq.groupBy("post").agg(F.max("i").alias("_n"))
    e = islands(seq, F.col("value") < threshold).groupBy("post", "run").agg(
        (F.min("i") - 1).alias("start"), F.max("i").alias("end"), F.min("value").alias("severity"))
    e = e.join(ends, "post")
    if not keep_open:
        e = e.filter(F.col("end") < F.col("_n"))
    return e.select("post", "run", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "severity")


def drought_frequency(index: DataFrame, threshold: float = -1.0, keep_open: bool = True) -> DataFrame:
    n = index.groupBy("post").agg(F.count("spi").alias("_n"))
    e = drought_events(index, threshold, keep_open).groupBy("post").agg(
        F.count(F.lit(1)).alias("n_droughts"), F.avg("duration").alias("mean_duration"), F.min("severity").alias("max_severity"), F.sum("duration").alias("_d"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return n.join(e, "post", "left").select(
        "post", F.coalesce("n_droughts", F.lit(0)).alias("n_droughts"), zero("mean_duration").alias("mean_duration"),
        zero("max_severity").alias("max_severity"), ((F.col("_n") - zero("_d")) / F.col("_n") * 100).alias("drought_free_percent"))


# --- spectrum and memory --------------------------------------------------------------------
_TAPER = {
    "hanning": lambda x: 0.5 - 0.5 * F.cos(x),
    "hamming": lambda x: 0.54 - 0.46 * F.cos(x),
    "blackman": lambda x: 0.42 - 0.5 * F.cos(x) + 0.08 * F.cos(2 * x),
    "none": lambda x: F.lit(1.0),
}
def spectrum(df: DataFrame, taper: str = "none", piece: int | None = None) -> DataFrame:
    """Discrete Fourier sums of the demeaned, tapered series: (post, n, k, re, im), k = 1..n/2."""
    seq = sequence(observed(df)).filter(F.col("n") >= 4)
    angle = 2 * np.pi * (F.col("i") - 1) / (F.col("n") - 1)
    x = (F.col("value") - F.col("total") / F.col("n")) * _TAPER[taper](angle)
    return fourier_sums(seq.select("post", "n", (F.col("i") - 1).alias("m"), x.alias("x")), piece)


def fft_analysis(df: DataFrame, dt: float = 1.0, piece: int | None = None) -> DataFrame:
    s = spectrum(df, "none", piece)
    n = F.col("n")
    amp = F.hypot("re", "im") * 2 / n
    return s.select("post", "k", (F.col("k") / (n * dt)).alias("frequency"), (n * dt / F.col("k")).alias("period"), amp.alias("amplitude"), (amp * amp).alias("power"))


def power_spectrum(df: DataFrame, dt: float = 1.0, taper: str = "hanning", piece: int | None = None) -> DataFrame:
    s = spectrum(df, taper, piece)
    n = F.col("n")
    return s.select(
        "post", "k", (F.col("k") / (n * dt)).alias("frequency"), (n * dt / F.col("k")).alias("period"),
        ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n).alias("power"))


def dominant_period(spec: DataFrame) -> DataFrame:
    return spec.groupBy("post").agg(F.max(F.struct("power", (-F.col("k")).alias("j"), "period")).alias("b")).select(
        "post", F.col("b.period").alias("dominant_period"), F.col("b.power").alias("power"))


def periodicities(df: DataFrame, dt: float = 1.0, top: int = 5) -> DataFrame:
    """Periods whose power exceeds mean + 3 deviations; the ``top`` strongest of each post."""
    spec = power_spectrum(df, dt)
    st = spec.groupBy("post").agg((F.avg("power") + 3 * F.stddev_pop("power")).alias("threshold"), F.count(F.lit(1)).alias("_k"))
    # few lines pass: by Chebyshev at most a tenth of them
    hit = spread(spec.withColumn("blk", block_of(F.col("k"))), st.filter(F.col("_k") >= 3)).filter(F.col("power") > F.col("threshold"))
    near = hit.withColumn("_r", F.row_number().over(W.partitionBy("post", "blk").orderBy(F.desc("power"), "k"))).filter(F.col("_r") <= top)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("post").orderBy(F.desc("power"), "k"))).filter(F.col("rank") <= top).select(
        "post", "rank", "k", "period", "power", "threshold")


def hurst(df: DataFrame, max_window: int | None = None) -> DataFrame:
    """Rescaled range over window sizes 10, 10 + step, ... and the slope of ln R/S on ln w.

    The running deviation inside a window follows from one running sum of the whole series, so
    a window of any length is two plain aggregates, not an ordered pass of its own.
    """
    seq = sequence(observed(df)).filter(F.col("n") >= 20)
    n = F.col("n")
    top = F.lit(max_window).cast("bigint") if max_window else F.floor(n / 4)
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(top / 20))
    sizes = F.when(top >= 10, F.sequence(F.lit(10).cast("bigint"), top, step)).otherwise(F.array().cast("array<bigint>"))
    mean = F.col("total") / n
    d = seq.select("post", "n", "i", "blk", (F.col("value") - mean).alias("x"), (F.col("run") - F.col("i") * mean).alias("c"), F.explode(sizes).alias("w"))
    d = d.withColumn("b", F.floor((F.col("i") - 1) / F.col("w"))).filter((F.col("b") + 1) * F.col("w") <= n)
    edge = d.groupBy("post", "w", "b").agg(
        F.sum("x").alias("_s"), F.stddev_samp("x").alias("_sd"), F.max(F.struct("i", "c")).alias("_e"))
    edge = edge.select("post", "w", "b", (F.col("_e.c") - F.col("_s")).alias("c0"), (F.col("_s") / F.col("w")).alias("m"), "_sd").filter(F.col("_sd") > 0)
    e = spread(d, edge, ["post", "w", "b"])
    dev = F.col("c") - F.col("c0") - (F.col("i") - F.col("b") * F.col("w")) * F.col("m")
    rs = e.groupBy("post", "w", "b", "_sd").agg(((F.max(dev) - F.min(dev)) / F.first("_sd")).alias("rs"))
    per = rs.groupBy("post", "w").agg(F.avg("rs").alias("rs"))
    h = per.groupBy("post").agg(
        F.regr_slope(F.log("rs"), F.log(F.col("w").cast("double"))).alias("h"), F.avg("rs").alias("mean_rs"), F.count(F.lit(1)).alias("windows"))
    x = F.col("h")
    return h.filter(F.col("windows") >= 3).select(
        "post", "h", "mean_rs", "windows",
        F.when(x > 0.65, "persistent").when(x > 0.55, "weakly_persistent").when(x > 0.45, "random_walk").when(x > 0.35, "weakly_antipersistent").otherwise("antipersistent").alias("memory"))
