"""Registered queries: analog rivers."""

from pyspark.sql import functions as F

from hydrosheaf.functions import fixed
from hydrosheaf.operators import analog
from hydrosheaf.plans import sqltext
from hydrosheaf.plans.catalog import B, R, register
from hydrosheaf.plans.q_freq import plist
from hydrosheaf.plans.views import view, with_views

PR = with_views("many", "pairs") + """, pr AS (SELECT p.target, p.analog, p.k, a.t, a.value AS qa, c.value AS qc
  FROM pairs p JOIN many a ON a.post = p.analog LEFT JOIN many c ON c.post = p.target AND c.t = a.t), bo AS (SELECT * FROM pr WHERE qc IS NOT NULL)"""
RO = f"CASE WHEN n < 5 THEN 1.0 ELSE {sqltext.lerp('n', fixed.RO_CRITICAL)} END"
VAL = f"""vl AS (SELECT target, analog, n, CASE WHEN n >= 5 AND NOT isnan(r0) THEN r0 ELSE 0 END AS r FROM (SELECT target, analog, count(*) AS n, coalesce(corr(qa, qc), 'nan') AS r0 FROM bo GROUP BY 1, 2)),
 vc AS (SELECT *, {RO} AS ro, CASE WHEN n < 5 THEN 'none' WHEN r > 0.95 THEN 'excellent' WHEN r > 0.9 THEN 'good' WHEN r > 0.8 THEN 'fair' WHEN r > 0.7 THEN 'weak' ELSE 'poor' END AS quality FROM vl)"""


def args(s, d):
    return view(s, d, "many"), view(s, d, "pairs")


@register("j01_validate_correlation", PR + f", {VAL} SELECT target, analog, {B('n')}, {R('r', 'r * r AS r2', 'ro')}, n >= 5 AND r > ro AS significant, quality, {R(sqltext.t_two_sided('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)') + ' AS p_value')} FROM vc")
def _(s, d):
    return analog.validate_correlation(analog.pair_rows(*args(s, d)), with_p=True)


@register("j02_ro_critical", with_views("sparse") + f", m AS (SELECT post, count(*) AS n FROM sparse GROUP BY 1) SELECT post, {B('n')}, {R(RO + ' AS ro')} FROM m")
def _(s, d):
    n = view(s, d, "sparse").groupBy("post").agg(F.count(F.lit(1)).alias("n"))
    return n.select("post", "n", analog.ro_critical(F.col("n")).alias("ro"))


RG = "rg AS (SELECT target, analog, regr_slope(qc, qa) AS a, regr_intercept(qc, qa) AS b, avg(qc) / avg(qa) AS kk FROM bo GROUP BY 1, 2 HAVING count(*) >= 2)"


@register("j03_regression_extension", PR + f", {RG} SELECT target, analog, {B('t')}, {R('coalesce(qc, a * qa + b) AS value')}, qc IS NULL AS extended FROM pr JOIN rg USING (target, analog)")
def _(s, d):
    return analog.regression_extension(analog.pair_rows(*args(s, d)))


@register("j04_proportional_extension", PR + f", {RG} SELECT target, analog, {B('t')}, {R('coalesce(qc, kk * qa) AS value')}, qc IS NULL AS extended FROM pr JOIN rg USING (target, analog)")
def _(s, d):
    return analog.proportional_extension(analog.pair_rows(*args(s, d)))


ERR = """em AS (SELECT post, count(*) AS n, stddev_samp(value) / avg(value) AS cv FROM many GROUP BY 1),
 ee AS (SELECT target, analog, c.n AS n_target, a.n AS n_analog, c.cv, c.cv / sqrt(c.n) * sqrt(3.0) * 100 AS e0, c.cv / sqrt(a.n) * sqrt(3.0) * 100 AS e1 FROM pairs JOIN em c ON c.post = target JOIN em a ON a.post = analog)"""
REL = "CASE WHEN e1 <= 10 THEN 'reliable' WHEN e1 <= 15 THEN 'reduced' ELSE 'unreliable' END AS reliability"


@register("j05_extension_error", PR + f", {ERR} SELECT target, analog, {B('n_target', 'n_analog')}, {R('cv', 'e0 AS eps_original', 'e1 AS eps_extended', '(e0 - e1) / e0 * 100 AS improvement')}, {REL} FROM ee")
def _(s, d):
    return analog.extension_error(*args(s, d))


@register("j06_extension_workflow", PR + f""", {VAL}, {ERR}, {RG}, ex AS (SELECT target, analog, avg(coalesce(qc, a * qa + b)) AS mean_extended, count(*) FILTER (qc IS NULL) AS n_added FROM pr JOIN rg USING (target, analog) GROUP BY 1, 2)
 SELECT target, analog, {B('n', 'n_added', 'n_analog')}, {R('r', 'r * r AS r2', 'ro', 'mean_extended', 'e0 AS eps_original', 'e1 AS eps_extended', '(e0 - e1) / e0 * 100 AS improvement')}, r > ro AS significant, quality, {REL},
  CAST(CASE WHEN r > ro THEN 0 ELSE 1 END + CASE WHEN n < 10 THEN 1 ELSE 0 END + CASE WHEN e1 > 15 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings
 FROM vc JOIN ex USING (target, analog) JOIN ee USING (target, analog)""")
def _(s, d):
    return analog.extension_workflow(*args(s, d)).withColumn("n_warnings", F.size("warnings")).drop("warnings")


MULTI = f"""jw AS (SELECT target, t, max(qc) AS y, max(qa) FILTER (k = 1) AS x1, max(qa) FILTER (k = 2) AS x2, max(qa) FILTER (k = 3) AS x3 FROM pr WHERE k <= 3 GROUP BY 1, 2),
 jf AS (SELECT target, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, covar_pop(y, y) * count(*) AS yy,
   covar_pop(x1, x1) * count(*) AS a, covar_pop(x1, x2) * count(*) AS b, covar_pop(x1, x3) * count(*) AS c, covar_pop(x2, x2) * count(*) AS e, covar_pop(x2, x3) * count(*) AS f, covar_pop(x3, x3) * count(*) AS i,
   covar_pop(x1, y) * count(*) AS u, covar_pop(x2, y) * count(*) AS v, covar_pop(x3, y) * count(*) AS w
   FROM jw WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL GROUP BY 1 HAVING count(*) >= 6),
 jd AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM jf),
 ji AS (SELECT *, (e * i - f * f) / det AS i11, (c * f - b * i) / det AS i12, (b * f - c * e) / det AS i13, (a * i - c * c) / det AS i22, (b * c - a * f) / det AS i23, (a * e - b * b) / det AS i33 FROM jd),
 jb AS (SELECT *, i11 * u + i12 * v + i13 * w AS k1, i12 * u + i22 * v + i23 * w AS k2, i13 * u + i23 * v + i33 * w AS k3 FROM ji),
 jr AS (SELECT *, my - k1 * m1 - k2 * m2 - k3 * m3 AS k0, greatest(yy - k1 * u - k2 * v - k3 * w, 0) AS rss FROM jb),
 js AS (SELECT *, sqrt(greatest(1 - rss / yy, 0)) AS r, rss / yy / sqrt(n) AS sigma_ro, sqrt(rss / (n - 1)) AS s_res, rss / (n - 4) AS s2 FROM jr),
 je AS (SELECT *, sqrt(abs(1 / n + i11 * m1 * m1 + i22 * m2 * m2 + i33 * m3 * m3 + 2 * (i12 * m1 * m2 + i13 * m1 * m3 + i23 * m2 * m3)) * s2) AS s_k0, sqrt(abs(i11) * s2) AS s_k1, sqrt(abs(i22) * s2) AS s_k2, sqrt(abs(i33) * s2) AS s_k3 FROM js)"""


@register("j07_multi_analog_fit", PR + f""", {MULTI} SELECT target, {B('n')}, {R('r', 'sigma_ro', 's_res', 'k0', 'k1', 'k2', 'k3', 's_k0', 's_k1', 's_k2', 's_k3', 'CAST(0 AS DOUBLE) AS y_ratio')},
 r >= 0.7 AS r_ok, r / sigma_ro >= 2 AS ratio_ok, k1 / s_k1 >= 2 AND k2 / s_k2 >= 2 AND k3 / s_k3 >= 2 AS k_ok, true AS y_ok, r >= 0.7 AND r / sigma_ro >= 2 AND k1 / s_k1 >= 2 AND k2 / s_k2 >= 2 AND k3 / s_k3 >= 2 AS accepted FROM je""")
def _(s, d):
    return analog.multi_analog_fit(analog.wide_analogs(*args(s, d)))


@register("j07_multi_analog_extension", PR + f""", {MULTI}, jg AS (SELECT target, t, y, CASE WHEN k0 + k1 * x1 + k2 * x2 + k3 * x3 >= 0 THEN k0 + k1 * x1 + k2 * x2 + k3 * x3 END AS g FROM jw JOIN je USING (target))
 SELECT target, {B('t')}, {R('coalesce(y, g) AS value')}, y IS NULL AND g IS NOT NULL AS filled FROM jg""")
def _(s, d):
    w = analog.wide_analogs(*args(s, d))
    return analog.multi_analog_extension(w, analog.multi_analog_fit(w))


FIT = f"""f0 AS (SELECT target, analog, count(*) AS n, corr(qa, qc) AS r, avg(qc) AS mc, avg(qa) AS ma, stddev_samp(qc) AS sc, stddev_samp(qa) AS sa FROM bo GROUP BY 1, 2 HAVING count(*) >= 3 AND stddev_samp(qc) >= 1e-12 AND stddev_samp(qa) >= 1e-12),
 ft AS (SELECT *, sc / sa AS k1, mc - sc / sa * ma AS k0, sqrt(greatest(2 * sc * sc * (1 - r), 0)) AS sigma_res, (1 - r * r) / sqrt(n) AS sigma_ro, abs(r) / ((1 - r * r) / sqrt(n)) AS ratio, {RO} AS ro FROM f0)"""


@register("j08_analog_relationship", PR + f""", {FIT} SELECT target, analog, {B('n')}, {R('r', 'k0', 'k1', 'sigma_res', 'sigma_ro', 'ratio AS r_over_sigma', 'ro')},
 CASE WHEN abs(r) >= 0.95 THEN 'excellent' WHEN abs(r) >= 0.9 THEN 'good' WHEN abs(r) >= 0.8 THEN 'fair' WHEN abs(r) >= 0.7 THEN 'weak' ELSE 'poor' END AS quality, abs(r) >= ro AND ratio >= 2 AND n >= 5 AS usable FROM ft""")
def _(s, d):
    return analog.analog_relationship(analog.pair_rows(*args(s, d)))


@register("j09_restore_short_series", PR + f""", {FIT}, pe AS (SELECT target, t, k0 + k1 * qa AS q, 1 / (sigma_res * sigma_res) AS w FROM pr JOIN ft USING (target, analog) WHERE qc IS NULL AND sigma_res > 1e-12),
 pa AS (SELECT target, t, count(*) AS n_total, count(*) FILTER (q >= 0) AS n_used, sum(w * q) FILTER (q >= 0) AS wq, sum(w) FILTER (q >= 0) AS w FROM pe GROUP BY 1, 2 HAVING count(*) >= 3),
 rs AS (SELECT target, t, wq / w AS q, 1 / sqrt(w) AS sigma, n_used, n_total FROM pa WHERE w >= 1e-12),
 sp AS (SELECT target, unnest(range(min(t), max(t) + 1)) AS t FROM pr GROUP BY 1),
 mi AS (SELECT sp.target, sp.t FROM sp WHERE NOT EXISTS (SELECT 1 FROM many c WHERE c.post = sp.target AND c.t = sp.t))
 SELECT post AS target, {B('t')}, {R('value AS q', 'CAST(NULL AS DOUBLE) AS sigma', 'CAST(NULL AS DOUBLE) AS delta')}, CAST(0 AS BIGINT) AS n_used, CAST(0 AS BIGINT) AS n_total, 'observed' AS note FROM many WHERE post IN (SELECT target FROM pairs)
 UNION ALL SELECT mi.target, {B('mi.t AS t')}, {R('q', 'sigma', 'sigma / abs(q) * 100 AS delta')}, {B('coalesce(n_used, 0) AS n_used', 'coalesce(n_total, 0) AS n_total')}, CASE WHEN q IS NULL THEN 'not restored' ELSE 'restored' END FROM mi LEFT JOIN rs ON rs.target = mi.target AND rs.t = mi.t""")
def _(s, d):
    # three analogs per target: the three-deviation rule cannot exclude any of them
    return analog.restore_short_series(*args(s, d)).fillna(0, ["n_used", "n_total"])


PROP = PR + f""", ks AS (SELECT target, analog, avg(CASE WHEN qa <> 0 THEN qc / qa END) AS k_mean FROM bo GROUP BY 1, 2),
 ps AS (SELECT post, avg(value) AS mean, stddev_samp(value) / avg(value) AS cv FROM many GROUP BY 1 HAVING count(*) >= 3),
 pq AS (SELECT *, 2 * cv AS cs FROM ps, {plist((75, 80, 90, 95, 97), True)}), {sqltext.pearson3('pq')}, qq AS (SELECT post, pq.p, mean * (1 + cv * z) AS q FROM pq JOIN p3z ON pq.p = p3z.p AND pq.cs = p3z.cs),
 pp AS (SELECT target, analog, p, k_mean, k_mean * q AS q FROM ks JOIN qq ON qq.post = analog)"""


@register("j10_proportional_quantiles", PROP + f" SELECT target, analog, {R('p', 'k_mean', 'q')} FROM pp")
def _(s, d):
    return analog.proportional_quantiles(*args(s, d))


@register("j11_compare_methods", PROP + f" SELECT target, analog, {R('pp.p AS p', 'qq.q AS q_statistical', 'pp.q AS q_proportional', '(pp.q - qq.q) / qq.q * 100 AS difference')} FROM pp LEFT JOIN qq ON qq.post = target AND qq.p = pp.p")
def _(s, d):
    return analog.compare_methods(*args(s, d))


@register("j12_integral_curves", with_views("annual") + f""", n0 AS (SELECT post, t, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY post) AS n, avg(value) OVER (PARTITION BY post) AS mean, stddev_samp(value) OVER (PARTITION BY post) AS sd,
   sum(value) OVER (PARTITION BY post ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM annual WINDOW w AS (PARTITION BY post ORDER BY t)),
 n1 AS (SELECT *, (run / mean - i) / (sd / mean) AS df FROM n0), n2 AS (SELECT *, lag(df) OVER (PARTITION BY post ORDER BY t) AS a, lead(df) OVER (PARTITION BY post ORDER BY t) AS b FROM n1)
 SELECT post, {B('t')}, {R('value / mean AS k', 'run / mean AS integral', 'df AS difference_integral')}, coalesce((df > a AND df > b) OR (df < a AND df < b), false) AS turning FROM n2""")
def _(s, d):
    return analog.integral_curves(view(s, d, "annual"))
