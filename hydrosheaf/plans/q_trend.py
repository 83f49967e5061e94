"""Registered queries: trend and change point."""

from pyspark.sql import functions as F

from hydrosheaf.operators import trend
from hydrosheaf.plans import sqltext
from hydrosheaf.plans.catalog import B, R, register
from hydrosheaf.plans.views import view, with_views

ANN = with_views("annual")
DAY = with_views("daily")
LIN = """lt AS (SELECT post, count(*) AS n, regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept, regr_r2(value, t) AS r2,
  sqrt((1 - regr_r2(value, t)) * regr_syy(value, t) / regr_sxx(value, t) / (count(*) - 2)) AS std_err FROM {v} GROUP BY post)"""
MK = """mp AS (SELECT a.post, sum(sign(b.value - a.value)) AS s FROM {v} a JOIN {v} b ON a.post = b.post AND a.t < b.t GROUP BY 1),
 mt AS (SELECT post, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT post, value, count(*) AS c FROM {v} GROUP BY 1, 2) GROUP BY 1),
 mk AS (SELECT post, n, s, (s - sign(s)) / sqrt((CAST(n AS DOUBLE) * (n - 1) * (2 * n + 5) - ties) / 18) AS z FROM mp JOIN mt USING (post))"""
SEN = """sp AS (SELECT a.post, median((b.value - a.value) / (b.t - a.t)) AS slope FROM {v} a JOIN {v} b ON a.post = b.post AND a.t < b.t GROUP BY 1),
 sen AS (SELECT post, slope, median(value) - slope * median(t) AS intercept FROM sp JOIN {v} USING (post) GROUP BY post, slope)"""
PET = """pr AS (SELECT post, t, row_number() OVER (PARTITION BY post ORDER BY t) AS i, count(*) OVER (PARTITION BY post) AS n,
   2 * rank() OVER (PARTITION BY post ORDER BY value) + count(*) OVER (PARTITION BY post, value) - 1 AS r2 FROM {v}),
 pu AS (SELECT *, abs(sum(r2) OVER (PARTITION BY post ORDER BY t) - i * (n + 1)) AS u FROM pr),
 pb AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY u DESC, i) AS k FROM pu WHERE i < n),
 pet AS (SELECT post, n, i, t, u, least(1.0, 2 * exp(-6.0 * u * u / (CAST(n AS DOUBLE) * n * n + CAST(n AS DOUBLE) * n))) AS p FROM pb WHERE k = 1)"""


@register("t01_linear_trend", ANN + ", " + LIN.format(v="annual") + f" SELECT post, {B('n')}, {R('slope', 'intercept', 'r2', 'std_err')} FROM lt")
def _(s, d):
    return trend.linear_trend(view(s, d, "annual"))


@register("t01_linear_trend_p", ANN + ", " + LIN.format(v="annual") + f" SELECT post, {R(sqltext.t_two_sided('(slope / std_err)', '(n - 2)') + ' AS p_value')} FROM lt")
def _(s, d):
    return trend.linear_trend_significance(view(s, d, "annual")).select("post", "p_value")


@register("t01_linear_trend_interval")
def _(s, d):
    return trend.linear_trend_significance(view(s, d, "annual")).select("post", "slope_low", "slope_high", "significant")


def _mk(v):
    return with_views(v) + ", " + MK.format(v=v) + f""" SELECT post, {B('n', 's')}, {R('z', sqltext.normal_two_sided('z') + ' AS p_value')},
 CASE WHEN s > 0 THEN 'rising' WHEN s < 0 THEN 'falling' ELSE 'none' END AS trend,
 {sqltext.normal_two_sided('z')} < 0.05 AS significant FROM mk"""


@register("t02_mann_kendall", _mk("annual"))
def _(s, d):
    return trend.mann_kendall(view(s, d, "annual"))


@register("t02_mann_kendall_daily", _mk("daily"))
def _(s, d):
    return trend.mann_kendall(view(s, d, "daily"))


@register("t03_sens_slope", ANN + ", " + SEN.format(v="annual") + f" SELECT post, {R('slope', 'intercept')} FROM sen")
def _(s, d):
    return trend.sens_slope(view(s, d, "annual"))


@register("t03_sens_slope_daily", DAY + ", " + SEN.format(v="daily") + f" SELECT post, {R('slope', 'intercept')} FROM sen")
def _(s, d):
    return trend.sens_slope(view(s, d, "daily"))


@register("t04_pettitt", ANN + ", " + PET.format(v="annual") + f" SELECT post, {B('n', 'i - 1 AS change_index', 't AS change_t', 'u AS max_u')}, {R('p AS p_value')}, p < 0.05 AS significant FROM pet")
def _(s, d):
    return trend.pettitt(view(s, d, "annual"))


@register("t04_change_point_daily", DAY + ", " + PET.format(v="daily") + f" SELECT post, {B('n', 'i - 1 AS change_index', 't AS change_t', 'u AS max_u')}, {R('p AS p_value')}, p < 0.05 AS significant FROM pet WHERE n >= 10")
def _(s, d):
    return trend.pettitt(view(s, d, "daily"), 10)


@register("t05_trend_summary", ANN + ", " + ", ".join(x.format(v="annual") for x in (LIN, MK, SEN, PET)) + f""",
 j AS (SELECT lt.post, lt.n, lt.slope AS ols_slope, r2, {sqltext.t_two_sided('(lt.slope / std_err)', '(lt.n - 2)')} AS ols_p, s, z,
   {sqltext.normal_two_sided('z')} AS mk_p, CASE WHEN s > 0 THEN 'rising' WHEN s < 0 THEN 'falling' ELSE 'none' END AS trend,
   sen.slope AS sen_slope, pet.t AS change_t, u AS max_u, p AS pettitt_p FROM lt JOIN mk ON lt.post = mk.post JOIN sen ON lt.post = sen.post JOIN pet ON lt.post = pet.post)
 SELECT post, {B('n', 's', 'change_t', 'max_u')}, {R('ols_slope', 'r2', 'ols_p', 'z', 'mk_p', 'sen_slope', 'pettitt_p')}, trend,
  CASE WHEN mk_p < 0.05 THEN 'significant ' || trend ELSE 'no significant trend, direction ' || trend END
   || CASE WHEN pettitt_p < 0.05 THEN '; change near ' || CAST(change_t AS VARCHAR) ELSE '' END AS verdict FROM j""")
def _(s, d):
    return trend.trend_summary(view(s, d, "annual"))


@register("t06_split_by_year", ANN + f" SELECT post, {B('CASE WHEN t < 1940 THEN 1 ELSE 2 END AS part', 'count(*) AS n')}, {R('avg(value) AS mean')} FROM annual GROUP BY 1, 2")
def _(s, d):
    return trend.split_by_year(view(s, d, "annual"), 1940).groupBy("post", "part").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
