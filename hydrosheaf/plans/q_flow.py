"""Registered queries: extremes, months, duration, baseflow, drought, spectrum."""

from pyspark.sql import functions as F

from hydrosheaf.functions import fixed
from hydrosheaf.operators import flow
from hydrosheaf.plans import sqltext
from hydrosheaf.plans.catalog import B, R, register
from hydrosheaf.plans.q_freq import plist
from hydrosheaf.plans.views import view, with_views

DAY = with_views("daily")
YEAR = "CAST(year(DATE '1970-01-01' + CAST(t AS INTEGER)) AS BIGINT)"
MONTH = "month(DATE '1970-01-01' + CAST(t AS INTEGER))"


def moving(name, n, months=None):
    f = f" WHERE {MONTH} IN {months}" if months else ""
    return f"""{name} AS (SELECT post, y, value, CASE WHEN row_number() OVER w >= {n} THEN avg(value) OVER (PARTITION BY post, y ORDER BY t ROWS {n - 1} PRECEDING) END AS ma
  FROM (SELECT *, {YEAR} AS y FROM daily{f}) WINDOW w AS (PARTITION BY post, y ORDER BY t))"""


def amax(n):
    return moving(f"m{n}", n) + f", mx{n} AS (SELECT post, y AS t, coalesce(max(ma), max(value)) AS value FROM m{n} GROUP BY post, y)"


def amin(n, months=None):
    return moving(f"l{n}", n, months) + f", mn{n} AS (SELECT post, y AS t, min(ma) AS value FROM l{n} GROUP BY post, y HAVING min(ma) IS NOT NULL)"


@register("x01_annual_extremes", DAY + f""", {amax(1)}, {amax(7)}, bo AS (SELECT *, 1 AS w FROM mx1 UNION ALL SELECT *, 7 FROM mx7),
 st AS (SELECT post, w, count(*) AS n, avg(value) AS mean, stddev_samp(value) / avg(value) AS cv FROM bo GROUP BY post, w HAVING count(*) >= 3),
 rk AS (SELECT *, row_number() OVER (PARTITION BY post, w ORDER BY value DESC) AS m FROM bo)
 SELECT post, {B('w AS "window"', 'n', 'm')}, {R('value', '(m - 0.3) / (n + 0.4) AS p_median', 'mean', 'cv', 'CASE WHEN cv <= 0.5 THEN 2 * cv ELSE 3 * cv END AS cs', 'cv / sqrt(n) * 100 AS epsilon')} FROM rk JOIN st USING (post, w)""")
def _(s, d):
    return flow.annual_extremes(view(s, d, "daily"))


@register("x01_annual_maxima_7", DAY + f", {amax(7)} SELECT post, {B('t')}, {R('value')} FROM mx7")
def _(s, d):
    return flow.annual_maxima(view(s, d, "daily"), 7)


@register("x02_annual_minima_10", DAY + f", {amin(10)} SELECT post, {B('t')}, {R('value')} FROM mn10")
def _(s, d):
    return flow.annual_minima(view(s, d, "daily"), 10)


@register("x02_summer_minima_30", DAY + f", {amin(30, (6, 7, 8))} SELECT post, {B('t')}, {R('value')} FROM mn30")
def _(s, d):
    return flow.annual_minima(view(s, d, "daily"), 30, "summer")


def lowq(n, ps):
    """CTE lq{n}: quantiles of the n-day annual minima."""
    return f"""{amin(n)}, ls{n} AS (SELECT post, count(*) AS n, avg(value) AS mean, stddev_samp(value) / avg(value) AS cv FROM mn{n} GROUP BY post HAVING count(*) >= 3),
 lp{n} AS (SELECT *, 2 * cv AS cs FROM ls{n}, {plist(ps, True)}), {sqltext.pearson3(f'lp{n}', f'z{n}')},
 lq{n} AS (SELECT lp{n}.post, lp{n}.p, n, mean, cv, mean * (1 + cv * z) AS q FROM lp{n} JOIN z{n} ON lp{n}.p = z{n}.p AND lp{n}.cs = z{n}.cs)"""


@register("x03_low_flow_7q10", DAY + f", {lowq(7, (90,))} SELECT post, {B('n')}, {R('p', 'q', 'mean', 'cv')} FROM lq7")
def _(s, d):
    return flow.low_flow_quantile(view(s, d, "daily"), 7, (90,))


@register("x03_low_flow_30", DAY + f", {lowq(30, (90, 95, 99))} SELECT post, {B('n')}, {R('p', 'q', 'mean', 'cv')} FROM lq30")
def _(s, d):
    return flow.low_flow_quantile(view(s, d, "daily"), 30, (90, 95, 99))


@register("x04_compare_low_flow", DAY + f""", {lowq(7, (90, 95, 99))}, {lowq(10, (90, 95, 99))}, {lowq(30, (90, 95, 99))}, qm AS (SELECT post, avg(value) AS qm FROM daily GROUP BY post),
 u AS (SELECT post, '10 percent' AS method, CAST(NULL AS DOUBLE) AS p, 0.1 * qm AS q FROM qm UNION ALL SELECT post, '7-day minimum', p, q FROM lq7 UNION ALL SELECT post, '7Q10', p, q FROM lq7 WHERE p = 0.9
  UNION ALL SELECT post, '10-day minimum', p, q FROM lq10 UNION ALL SELECT post, '30-day minimum', p, q FROM lq30)
 SELECT post, method, {R('p', 'q')}, CASE WHEN method = '10 percent' THEN 'within norm' WHEN q < 0.1 * qm THEN 'below ecological' ELSE 'above ecological' END AS status FROM u JOIN qm USING (post)""")
def _(s, d):
    return flow.compare_low_flow(view(s, d, "daily"))


def runs(src, cond):
    """CTEs nu (rows with i) and ru (rows of ``cond`` with run number)."""
    return f"""hi AS (SELECT *, i - row_number() OVER (PARTITION BY post ORDER BY i) AS g FROM {src} WHERE {cond}),
 ru AS (SELECT *, dense_rank() OVER (PARTITION BY post ORDER BY g) AS run FROM hi)"""


POT = DAY + """, th AS (SELECT post, quantile_cont(value, 0.95) AS threshold FROM daily GROUP BY post),
 nu AS (SELECT post, t, value, threshold, row_number() OVER (PARTITION BY post ORDER BY t) AS i FROM daily JOIN th USING (post)), """ + runs("nu", "value >= threshold")


@register("x05_peaks_no_separation", POT + f""", pk AS (SELECT *, row_number() OVER (PARTITION BY post, run ORDER BY value DESC, i) AS k FROM ru)
 SELECT post, {B('run', 'i - 1 AS "index"', 't')}, {R('value', 'threshold')} FROM pk WHERE k = 1""")
def _(s, d):
    return flow.peaks_over_threshold(view(s, d, "daily"), 95.0, 0)


@register("x05_peaks_over_threshold", POT + f""", re AS (SELECT post, run, min(i) AS s, max(i) AS e FROM ru GROUP BY post, run),
 ch AS (SELECT post, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS run, CAST(NULL AS BIGINT) AS s0 FROM th
   UNION ALL SELECT c.post, n.e + 6, n.run, greatest(n.s, c.pos) FROM ch c JOIN LATERAL (SELECT run, s, e FROM re WHERE re.post = c.post AND re.e >= c.pos ORDER BY run LIMIT 1) n ON true),
 pk AS (SELECT ru.*, row_number() OVER (PARTITION BY ru.post, ru.run ORDER BY value DESC, i) AS k FROM ru JOIN ch ON ch.post = ru.post AND ch.run = ru.run AND ru.i >= s0)
 SELECT post, {B('run', 'i - 1 AS "index"', 't')}, {R('value', 'threshold')} FROM pk WHERE k = 1""")
def _(s, d):
    return flow.peaks_over_threshold(view(s, d, "daily"), 95.0, 5)


@register("x05_peak_rate", POT + f""", n AS (SELECT post, count(*) AS n FROM daily GROUP BY post), p AS (SELECT post, threshold, max(run) AS n_peaks FROM ru GROUP BY post, threshold)
 SELECT post, {B('n', 'n_peaks')}, {R('threshold', 'n_peaks / (n / 365.25) AS annual_rate')} FROM n JOIN p USING (post)""")
def _(s, d):
    return flow.peak_rate(view(s, d, "daily"), 95.0, 0)


# --- months -----------------------------------------------------------------------------------
SUMS = with_views("monthly") + """, ws AS (SELECT post, year, sum(value) AS sum_year, coalesce(sum(value) FILTER (month BETWEEN 4 AND 10), 0) AS sum_non_limiting,
  coalesce(sum(value) FILTER (month IN (11, 12, 1, 2, 3)), 0) AS sum_limiting, coalesce(sum(value) FILTER (month IN (12, 1, 2)), 0) AS sum_season FROM monthly GROUP BY 1, 2)"""


@register("i01_water_year_sums", SUMS + f" SELECT post, {B('year')}, {R('sum_year', 'sum_non_limiting', 'sum_limiting', 'sum_season')} FROM ws")
def _(s, d):
    return flow.water_year_sums(view(s, d, "monthly"))


@register("i02_intra_annual_stats", SUMS + f""", lo AS (UNPIVOT ws ON sum_year, sum_non_limiting, sum_limiting, sum_season INTO NAME part VALUE value)
 SELECT post, part, {B('count(*) AS n')}, {R('avg(value) AS mean', 'stddev_samp(value) / avg(value) AS cv', '2 * stddev_samp(value) / avg(value) AS cs')} FROM lo GROUP BY 1, 2""")
def _(s, d):
    return flow.intra_annual_stats(flow.water_year_sums(view(s, d, "monthly"))).select("post", "part", "n", "mean", "cv", "cs")


MODEL = SUMS + f""", ms AS (SELECT post, avg(sum_limiting) AS mean, stddev_samp(sum_limiting) / avg(sum_limiting) AS cv FROM ws GROUP BY post),
 mp AS (SELECT *, CAST(0.9 AS DOUBLE) AS p, 2 * cv AS cs FROM ms), {sqltext.pearson3('mp')}, mt AS (SELECT mp.post, mean * (1 + cv * z) AS target_sum FROM mp JOIN p3z USING (p, cs)),
 md AS (SELECT post, year, target_sum, abs(sum_limiting - target_sum) AS delta, row_number() OVER (PARTITION BY post ORDER BY abs(sum_limiting - target_sum), year) AS k FROM ws JOIN mt USING (post))"""


@register("i03_model_year", MODEL + f" SELECT post, {B('year')}, {R('target_sum', 'delta')} FROM md WHERE k = 1")
def _(s, d):
    return flow.model_year(flow.water_year_sums(view(s, d, "monthly")))


@register("i04_monthly_distribution", MODEL + f""", sh AS (SELECT monthly.post, monthly.year, month, round(value / sum(value) OVER (PARTITION BY monthly.post) * 100, 2) AS share, target_sum FROM monthly JOIN md ON md.post = monthly.post AND md.year = monthly.year AND k = 1)
 SELECT post, {B('year', 'month')}, {R('share', 'round(share / 100 * target_sum, 2) AS discharge')} FROM sh""")
def _(s, d):
    m = view(s, d, "monthly")
    return flow.distribute_by_model_year(m, flow.model_year(flow.water_year_sums(m)), "target_sum")


@register("i05_period_texts", with_views("monthly") + """, mt AS (SELECT post, year, list(month ORDER BY month) AS ms FROM (SELECT DISTINCT post, year, month FROM monthly) GROUP BY 1, 2)
 SELECT post, year, array_to_string(list_transform(ms, lambda m: ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'][m]), '–') AS months FROM mt""")
def _(s, d):
    m = view(s, d, "monthly").groupBy("post", "year").agg(F.sort_array(F.collect_set("month")).alias("ms"))  # twelve at most
    return m.select("post", "year", flow.months_to_text(F.col("ms")).alias("months"))


@register("i05_period_sums", with_views("monthly") + f""", pd(period, month) AS (VALUES ('winter', 11), ('winter', 12), ('winter', 1), ('winter', 2), ('winter', 3), ('summer', 6), ('summer', 7), ('summer', 8))
 SELECT post, year, period, {B('count(*) AS months')}, {R('sum(value) AS total')} FROM monthly JOIN pd USING (month) GROUP BY 1, 2, 3""")
def _(s, d):
    p = flow.period_table(s, winter="11-3", summer="6-8")
    return view(s, d, "monthly").join(F.broadcast(p), "month").groupBy("post", "year", "period").agg(F.count(F.lit(1)).alias("months"), F.sum("value").alias("total"))


# --- duration and regime ----------------------------------------------------------------------
@register("r01_flow_duration", DAY + f", pv AS (SELECT * FROM {plist(fixed.P_DURATION)}), sv AS (SELECT post, count(*) AS n, " + ", ".join(
    f"quantile_cont(value, {1 - p!r}) AS q{j}" for j, p in enumerate(fixed.P_DURATION)) + " FROM daily GROUP BY post) " + " UNION ALL ".join(
    f"SELECT post, {B('n')}, {R(f'CAST({p!r} AS DOUBLE) AS p', f'q{j} AS q')} FROM sv" for j, p in enumerate(fixed.P_DURATION)))
def _(s, d):
    return flow.flow_duration(view(s, d, "daily"))


@register("r02_duration_percentiles", DAY + f" SELECT post, {B('count(*) AS n')}, " + R(*[f"quantile_cont(value, {(100 - p) / 100}) AS q{p}" for p in fixed.DURATION_PERCENTILES]) + " FROM daily GROUP BY post")
def _(s, d):
    return flow.duration_percentiles(view(s, d, "daily"))


SLOPE = DAY + """, sq AS (SELECT post, count(*) AS n, quantile_cont(value, 0.9) AS q10, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.1) AS q90,
  quantile_cont(value, 0.98) AS q2, quantile_cont(value, 0.02) AS q98, stddev_samp(value) / avg(value) AS cv FROM daily GROUP BY post),
 si AS (SELECT *, CASE WHEN q98 > 0 AND q2 > 0 THEN (ln(q2) - ln(q98)) / (ln(0.98) - ln(0.02)) ELSE 0 END AS n_value FROM sq)"""


@register("r03_slope_index", SLOPE + f" SELECT post, {B('n')}, {R('n_value', 'q10 / q90 AS ratio_10_90', 'q50 / q90 AS ratio_50_90', 'q10', 'q50', 'q90', 'cv')} FROM si")
def _(s, d):
    return flow.slope_index(view(s, d, "daily"))


@register("r04_regime_class", SLOPE + f""" SELECT post, {R('n_value', 'cv')}, CASE WHEN cv > 0.6 OR n_value > 1.5 THEN 'highly_variable' WHEN cv > 0.4 OR n_value > 0.8 THEN 'moderately_variable' ELSE 'stable' END AS regime,
 CASE WHEN q10 / q90 > 10 THEN 'strong' WHEN q10 / q90 > 3 THEN 'moderate' ELSE 'weak' END AS contrast FROM si""")
def _(s, d):
    return flow.regime_class(view(s, d, "daily"))


@register("r05_exceedance_share", DAY + f""", lv AS (SELECT post, unnest([avg(value) / 2, avg(value), avg(value) * 2]) AS level FROM daily GROUP BY post)
 SELECT lv.post, {R('level', 'avg(CASE WHEN value >= level THEN 1.0 ELSE 0.0 END) AS p')} FROM lv JOIN daily USING (post) GROUP BY lv.post, level""")
def _(s, d):
    v = view(s, d, "daily")
    m = F.avg("value")
    lv = v.groupBy("post").agg(F.array(m / 2, m, m * 2).alias("l")).select("post", F.explode("l").alias("level"))
    return flow.exceedance_share(v, lv)


@register("r06_eco_classes", DAY + f""", em AS (SELECT post, avg(value) AS mean FROM daily GROUP BY post), er AS (SELECT post, value / mean AS r FROM daily JOIN em USING (post))
 SELECT post, CASE WHEN r <= 0.1 THEN 'I' WHEN r <= 0.2 THEN 'II' WHEN r <= 0.4 THEN 'III' WHEN r <= 0.6 THEN 'IV' WHEN r <= 1.0 THEN 'V' ELSE 'VI' END AS "class", {B('count(*) AS days')}, {R('avg(r) AS mean_ratio')} FROM er GROUP BY 1, 2""")
def _(s, d):
    return flow.eco_classes(view(s, d, "daily"))


def _arr(xs):
    return "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in xs) + "]"


SEAS = with_views("daily", "monthly") + f""", mm AS (SELECT post, month, avg(value) AS value FROM monthly GROUP BY 1, 2), ma AS (SELECT post, avg(value) AS qm FROM mm GROUP BY 1),
 se AS (SELECT post, month, greatest(value, 0.01) AS q_month, qm, {_arr(fixed.SEASONAL_FLOW['mountain'][0])}[month] AS alpha, {_arr(fixed.SEASONAL_FLOW['mountain'][1])}[month] AS beta FROM mm JOIN ma USING (post))"""


@register("r07_seasonal_ecological_flow", SEAS + f" SELECT post, {B('month')}, {R('q_month', 'alpha', 'beta', 'alpha * qm * pow(greatest(q_month / qm, 0.01), beta) AS q_eco')} FROM se")
def _(s, d):
    mm = view(s, d, "monthly").groupBy("post", "month").agg(F.avg("value").alias("value"))
    return flow.seasonal_ecological_flow(mm, "mountain").drop("qm")


@register("r08_ecosystem_minimum", DAY + f""", em AS (SELECT post, avg(value) AS mean FROM daily GROUP BY post),
 e AS (SELECT post, mean, 'tenpct' AS method, 0.1 * mean AS q_eco FROM em UNION ALL SELECT post, mean, 'tessmann', 0.2 * mean * (1 + 0.5 * ln(1 / 0.9)) FROM em UNION ALL SELECT post, mean, '7q10', 0.4 * mean FROM em)
 SELECT post, method, {R('mean', 'q_eco')}, CASE WHEN method = '7q10' THEN 'to be refined' WHEN q_eco < 0.1 * mean THEN 'below norm' WHEN q_eco <= 0.3 * mean THEN 'within norm' ELSE 'above norm' END AS compliance FROM e""")
def _(s, d):
    return flow.ecosystem_minimum(view(s, d, "daily").groupBy("post").agg(F.avg("value").alias("mean")))


@register("r08_min_flow_comparison", SEAS.replace("mountain", "central") + f""", {lowq(7, (90,))}, dm AS (SELECT post, avg(value) AS qm FROM daily GROUP BY post),
 sc AS (SELECT mm.post, month, greatest(value / ma.qm * dm.qm, 0.01) AS v FROM mm JOIN ma ON ma.post = mm.post JOIN dm ON dm.post = mm.post), sm AS (SELECT post, avg(v) AS qm FROM sc GROUP BY post),
 sx AS (SELECT sc.post, avg({_arr(fixed.SEASONAL_FLOW['central'][0])}[month] * qm * pow(greatest(v / qm, 0.01), {_arr(fixed.SEASONAL_FLOW['central'][1])}[month])) AS q FROM sc JOIN sm USING (post) GROUP BY sc.post),
 u AS (SELECT post, '10 percent' AS method, 0.1 * qm AS q FROM dm UNION ALL SELECT post, '30 percent', 0.3 * qm FROM dm UNION ALL SELECT post, 'tessmann', 0.25 * qm FROM dm UNION ALL SELECT post, '7Q10', q FROM lq7 UNION ALL SELECT post, 'seasonal', q FROM sx)
 SELECT post, method, {R('q')} FROM u""")
def _(s, d):
    return flow.min_flow_comparison(view(s, d, "daily"), view(s, d, "monthly"))


@register("r09_wetted_perimeter", DAY + f""", sg AS (SELECT post AS section, value AS q, 10 + 3 * ln(1 + value) + count(*) / 50.0 AS perimeter FROM daily GROUP BY 1, 2),
 sl AS (SELECT *, (lead(perimeter) OVER w - perimeter) / (lead(q) OVER w - q) AS slope FROM sg WINDOW w AS (PARTITION BY section ORDER BY q)),
 sk AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY round(slope, 9), q) AS k FROM sl WHERE slope IS NOT NULL)
 SELECT section, {R('q AS q_eco', 'perimeter AS p_eco', 'slope')} FROM sk WHERE k = 1""")
def _(s, d):
    pts = view(s, d, "daily").groupBy(F.col("post").alias("section"), F.col("value").alias("q")).agg(F.count(F.lit(1)).alias("c")).select(
        "section", "q", (10 + 3 * F.log(1 + F.col("q")) + F.col("c") / 50.0).alias("perimeter"))
    return flow.wetted_perimeter(pts)


# --- baseflow ---------------------------------------------------------------------------------
# exponent literals are doubles in SQL; 0.925 would be an exact decimal
NUM = "nu AS (SELECT post, t, value / 9.73 AS value, row_number() OVER w AS i, lag(value / 9.73) OVER w AS pv, lead(value / 9.73) OVER w AS nv FROM daily WINDOW w AS (PARTITION BY post ORDER BY t))"


def flows(s, d):
    """Daily flow off the decimal grid, so that rounding has no ties."""
    return view(s, d, "daily").withColumn("value", F.col("value") / 9.73)


@register("b01_baseflow_straight_line", DAY + f""", {NUM}, pk AS (SELECT post, i, value AS v, lead(i) OVER w AS ni, lead(value) OVER w AS nq, lag(i) OVER w AS pi, lag(value) OVER w AS pq FROM nu WHERE value > pv AND value > nv WINDOW w AS (PARTITION BY post ORDER BY i)),
 sg AS (SELECT post, i AS a, v AS va, ni AS b, nq AS vb FROM pk WHERE ni IS NOT NULL),
 rw AS (SELECT nu.post, nu.t, nu.value, nu.i, sg.*, row_number() OVER (PARTITION BY nu.post, nu.i ORDER BY a DESC) AS k FROM nu LEFT JOIN sg ON sg.post = nu.post AND nu.i BETWEEN sg.a AND sg.b)
 SELECT post, {B('t')}, {R('value', 'least(greatest(CASE WHEN a IS NULL THEN 0 WHEN b - a > 5 THEN va + (vb - va) * (i - a) / (b - a) ELSE least(va, vb) END, 0), value) AS baseflow')} FROM rw WHERE k = 1""")
def _(s, d):
    return flow.baseflow_straight_line(flows(s, d))


FILT = DAY + f", {NUM}, bf AS (SELECT post, i, value * 0.5 AS b FROM nu WHERE i = 1 UNION ALL SELECT nu.post, nu.i, CASE WHEN nu.value < b THEN 9.25e-1 * b + (1 - 9.25e-1) * nu.value ELSE nu.value * 0.5 END FROM bf JOIN nu ON nu.post = bf.post AND nu.i = bf.i + 1)"
LYNE = DAY + f", {NUM}, bf AS (SELECT post, i, value * 0.5 AS b FROM nu WHERE i = 1 UNION ALL SELECT nu.post, nu.i, least(9.7e-1 * b + (1 - 9.7e-1) / 2 * (nu.value + nu.pv), nu.value) FROM bf JOIN nu ON nu.post = bf.post AND nu.i = bf.i + 1)"


@register("b02_baseflow_digital_filter", FILT + f" SELECT post, {B('t')}, {R('value', 'least(greatest(b, 0), value) AS baseflow')} FROM nu JOIN bf USING (post, i)")
def _(s, d):
    return flow.baseflow_digital_filter(flows(s, d))


@register("b03_baseflow_lyne_hollick", LYNE + f" SELECT post, {B('t')}, {R('value', 'greatest(b, 0) AS baseflow')} FROM nu JOIN bf USING (post, i)")
def _(s, d):
    return flow.baseflow_lyne_hollick(flows(s, d))


@register("b04_baseflow_statistics", LYNE + f""", bb AS (SELECT post, value, greatest(b, 0) AS b, greatest(b, 0) - lag(greatest(b, 0)) OVER (PARTITION BY post ORDER BY i) AS db FROM nu JOIN bf USING (post, i)),
 bs AS (SELECT post, stddev_pop(b) AS sd FROM bb GROUP BY post)
 SELECT post, {R('avg(b) AS bf_mean', 'min(b) AS bf_min', 'max(b) AS bf_max', 'avg(b) / avg(value) AS bf_ratio', 'count(*) FILTER (abs(db) < 0.1 * sd) / count(*) * 100 AS steady_percent')} FROM bb JOIN bs USING (post) GROUP BY post""")
def _(s, d):
    return flow.baseflow_statistics(flow.baseflow_lyne_hollick(flows(s, d)))


# --- drought ----------------------------------------------------------------------------------
def spi_cte(src, k):
    return f"""sn AS (SELECT post, t, row_number() OVER w AS i, sum(value) OVER (PARTITION BY post ORDER BY t ROWS {k - 1} PRECEDING) AS s FROM {src} WINDOW w AS (PARTITION BY post ORDER BY t)),
 sm AS (SELECT post, avg(s) AS mu, stddev_samp(s) AS sd, count(*) AS k FROM sn WHERE i >= {k} GROUP BY post),
 sp AS (SELECT post, t, i, CASE WHEN i >= {k} AND k >= 3 AND sd > 0 THEN (s - mu) / sd ELSE 0.0 END AS spi FROM sn LEFT JOIN sm USING (post))"""


RAIN = with_views("forcing") + ", rn AS (SELECT post, t, p AS value FROM forcing)"


def rain(s, d, c="p"):
    return view(s, d, "forcing").select("post", "t", F.col(c).alias("value"))


@register("g01_spi", RAIN + ", " + spi_cte("rn", 3) + f" SELECT post, {B('t')}, {R('spi')} FROM sp")
def _(s, d):
    return flow.spi(rain(s, d), 3).select("post", "t", "spi")


@register("g01_spi_daily_30", DAY + ", " + spi_cte("daily", 30) + f" SELECT post, {B('t')}, {R('spi')} FROM sp")
def _(s, d):
    return flow.spi(view(s, d, "daily"), 30).select("post", "t", "spi")


@register("g02_spei", with_views("forcing") + ", rn AS (SELECT post, t, p - pet AS value FROM forcing), " + spi_cte("rn", 6) + f" SELECT post, {B('t')}, {R('spi')} FROM sp")
def _(s, d):
    return flow.spei(rain(s, d), rain(s, d, "pet"), 6).select("post", "t", "spi")


CLS = "CASE WHEN spi >= 2 THEN 'extremely_wet' WHEN spi >= 1.5 THEN 'very_wet' WHEN spi >= 1 THEN 'moderately_wet' WHEN spi >= 0 THEN 'slightly_wet' WHEN spi >= -1 THEN 'slightly_dry' WHEN spi >= -1.5 THEN 'moderately_dry' WHEN spi >= -2 THEN 'severely_dry' ELSE 'extremely_dry' END"


@register("g03_drought_classes", RAIN + ", " + spi_cte("rn", 3) + f" SELECT post, {CLS} AS category, {B('count(*) AS n')} FROM sp GROUP BY 1, 2")
def _(s, d):
    return flow.spi(rain(s, d), 3).groupBy("post", flow.drought_class(F.col("spi")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


EV = DAY + ", " + spi_cte("daily", 30) + ", " + runs("sp", "spi < -1.0") + ", ev AS (SELECT post, run, min(i) - 1 AS s, max(i) AS e, min(spi) AS severity FROM ru GROUP BY 1, 2), nn AS (SELECT post, count(*) AS n FROM sp GROUP BY 1)"


@register("g04_drought_events", EV + f' SELECT post, {B("run", "s AS start", chr(101) + " AS " + chr(34) + "end" + chr(34), "e - s AS duration")}, {R("severity")} FROM ev')
def _(s, d):
    return flow.drought_events(flow.spi(view(s, d, "daily"), 30))


@register("g04_drought_frequency", EV + f""" SELECT nn.post, {B('count(run) AS n_droughts')}, {R('coalesce(avg(e - s), 0) AS mean_duration', 'coalesce(min(severity), 0) AS max_severity',
  '(any_value(n) - coalesce(sum(e - s), 0)) / any_value(n) * 100 AS drought_free_percent')} FROM nn LEFT JOIN ev USING (post) GROUP BY nn.post""")
def _(s, d):
    return flow.drought_frequency(flow.spi(view(s, d, "daily"), 30))


# --- spectrum ---------------------------------------------------------------------------------
def dft(src, taper):
    return f"""cn AS (SELECT post, row_number() OVER (PARTITION BY post ORDER BY t) - 1 AS j, count(*) OVER (PARTITION BY post) AS n, value - avg(value) OVER (PARTITION BY post) AS x0 FROM {src}),
 cx AS (SELECT *, x0 * ({taper}) AS x FROM cn), ck AS (SELECT post, n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT post, n FROM cn)),
 sp AS (SELECT ck.post, ck.n, ck.k, sum(x * cos(2 * pi() * ((j * ck.k) % ck.n) / ck.n)) AS re, sum(x * sin(2 * pi() * ((j * ck.k) % ck.n) / ck.n)) AS im FROM ck JOIN cx ON cx.post = ck.post GROUP BY ALL),
 pw AS (SELECT post, n, k, (re * re + im * im) / n AS power FROM sp)"""


HANN = "0.5 - 0.5 * cos(2 * pi() * j / (n - 1))"
HOUR = with_views("hourly")


@register("p01_fft_analysis", HOUR + ", " + dft("hourly", "1.0") + f" SELECT post, {B('k')}, {R('k / n AS frequency', 'n / k AS period', 'sqrt(re * re + im * im) * 2 / n AS amplitude', '(re * re + im * im) * 4 / n / n AS power')} FROM sp")
def _(s, d):
    return flow.fft_analysis(view(s, d, "hourly"))


@register("p02_power_spectrum", HOUR + ", " + dft("hourly", HANN) + f" SELECT post, {B('k')}, {R('k / n AS frequency', 'n / k AS period', 'power')} FROM pw")
def _(s, d):
    return flow.power_spectrum(view(s, d, "hourly"))


@register("p02_dominant_period", HOUR + ", " + dft("hourly", "0.42 - 0.5 * cos(2 * pi() * j / (n - 1)) + 0.08 * cos(4 * pi() * j / (n - 1))") + f" SELECT post, {R('arg_max(n / k, power) AS dominant_period', 'max(power) AS power')} FROM pw GROUP BY post")
def _(s, d):
    return flow.dominant_period(flow.power_spectrum(view(s, d, "hourly"), taper="blackman"))


@register("p03_hurst", DAY + f""", hn AS (SELECT post, value, row_number() OVER (PARTITION BY post ORDER BY t) - 1 AS j, count(*) OVER (PARTITION BY post) AS n FROM daily),
 hw AS (SELECT DISTINCT post, n, unnest(range(10, n // 4 + 1, greatest(1, n // 4 // 20))) AS w FROM hn),
 hb AS (SELECT hn.post, w, j // w AS b, j, value - avg(value) OVER (PARTITION BY hn.post, w, j // w) AS dv, stddev_samp(value) OVER (PARTITION BY hn.post, w, j // w) AS sd FROM hn JOIN hw ON hw.post = hn.post AND (j // w + 1) * w <= hn.n),
 hc AS (SELECT *, sum(dv) OVER (PARTITION BY post, w, b ORDER BY j) AS c FROM hb), hr AS (SELECT post, w, b, (max(c) - min(c)) / any_value(sd) AS rs FROM hc WHERE sd > 0 GROUP BY 1, 2, 3),
 hm AS (SELECT post, w, avg(rs) AS rs FROM hr GROUP BY 1, 2), hh AS (SELECT post, regr_slope(ln(rs), ln(w)) AS h, avg(rs) AS mean_rs, count(*) AS windows FROM hm GROUP BY 1)
 SELECT post, {B('windows')}, {R('h', 'mean_rs')}, CASE WHEN h > 0.65 THEN 'persistent' WHEN h > 0.55 THEN 'weakly_persistent' WHEN h > 0.45 THEN 'random_walk' WHEN h > 0.35 THEN 'weakly_antipersistent' ELSE 'antipersistent' END AS memory FROM hh""")
def _(s, d):
    return flow.hurst(view(s, d, "daily"))


@register("p04_periodicities", HOUR + ", " + dft("hourly", HANN) + f""", pt AS (SELECT post, avg(power) + 3 * stddev_pop(power) AS threshold FROM pw GROUP BY 1),
 pr AS (SELECT pw.post, k, n / k AS period, power, threshold, row_number() OVER (PARTITION BY pw.post ORDER BY power DESC, k) AS rank FROM pw JOIN pt USING (post) WHERE power > threshold)
 SELECT post, {B('rank', 'k')}, {R('period', 'power', 'threshold')} FROM pr WHERE rank <= 5""")
def _(s, d):
    return flow.periodicities(view(s, d, "hourly"))
