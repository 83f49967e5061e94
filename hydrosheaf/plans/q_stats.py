"""Registered queries: descriptive statistics, gaps, outliers, homogeneity."""

from pyspark.sql import functions as F

from hydrosheaf.functions import fixed
from hydrosheaf.operators import quality, stats
from hydrosheaf.plans import sqltext
from hydrosheaf.plans.catalog import B, R, register
from hydrosheaf.plans.views import table, view, with_views

# moments of the annual-like view in SQL
MOM = """m AS (SELECT post, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std,
  skewness(value) AS cs, min(value) AS min, max(value) AS max, stddev_samp(value) / avg(value) AS cv
  FROM {v} GROUP BY post)"""
LAG = """l AS (SELECT post, corr(value, pv) AS r1 FROM (SELECT post, value,
  lag(value) OVER (PARTITION BY post ORDER BY t) AS pv FROM {v}) GROUP BY post)"""


def annual_cte(*more: str, v="annual", views=("annual",)) -> str:
    return with_views(*views) + "".join(", " + x.format(v=v) for x in (MOM, *more))


@register("d01_basic_stats", annual_cte() + f""", q AS (SELECT post, quantile_cont(value, 0.5) AS median FROM annual GROUP BY post)
SELECT post, {B('n', '0 AS missing')}, {R('mean', 'std', 'cs', 'min', 'max', 'median', 'cv')} FROM m JOIN q USING (post)""")
def _(s, d):
    return stats.basic_stats(view(s, d, "annual"))


PARAMS = annual_cte(LAG) + """, p AS (SELECT m.*, r1, (n - 1) / CAST(n AS DOUBLE) AS lambda2,
  cs * (n - 2) / sqrt(n * (n - 1.0)) * pow((n - 1) / CAST(n AS DOUBLE), 1.5) AS lambda3 FROM m JOIN l USING (post))"""


@register("d02_parameters", PARAMS + f" SELECT post, {B('n')}, {R('mean', 'std', 'cs', 'min', 'max', 'r1', 'cv', 'lambda2', 'lambda3')} FROM p")
def _(s, d):
    return stats.parameters(view(s, d, "annual"))


@register("d03_pearson3_inputs", PARAMS + f" SELECT post, {B('n')}, {R('mean', 'std', 'cv', 'cs AS skew', 'r1')} FROM p")
def _(s, d):
    return stats.parameters(view(s, d, "annual")).select("post", "n", "mean", "std", "cv", F.col("cs").alias("skew"), "r1")


@register("d04_relative_errors", PARAMS + f""" SELECT post, {B('n')}, {R('mean', 'cv', 'cs', 'cv / sqrt(n) * 100 AS eps_mean',
    'sqrt(n * (1 + cv * cv) / 2) / (n + 4 * cv * cv) * 100 AS eps_cv',
    'sqrt(6.0 / n * (1 + 6 * cv * cv + 5 * pow(cv, 4))) / abs(cs) * 100 AS eps_cs')} FROM p""")
def _(s, d):
    return stats.relative_errors(stats.parameters(view(s, d, "annual"))).select(
        "post", "n", "mean", "cv", "cs", "eps_mean", "eps_cv", "eps_cs")


NORM = """, a AS (SELECT post, n, mean, std, cv, 2 * cv AS cs, cs AS cs_empirical, r1,
  CASE WHEN r1 >= 0 AND r1 < 1 THEN sqrt((1 + r1) / (1 - r1)) ELSE 1.0 END AS k_r FROM p),
  e AS (SELECT *, cv / sqrt(n) * k_r * 100 AS epsilon FROM a)"""


@register("d05_annual_runoff_stats", PARAMS + NORM + f""" SELECT post, {B('n')},
 {R('mean', 'std', 'cv', 'cs', 'cs_empirical', 'r1', 'k_r', 'epsilon')},
 CASE WHEN epsilon > 15 OR n < 10 THEN 'unreliable' WHEN n < 15 OR epsilon > 10 THEN 'reduced' ELSE 'reliable' END AS reliability,
 CAST(CASE WHEN n < 15 THEN 1 ELSE 0 END + CASE WHEN epsilon > 10 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings FROM e""")
def _(s, d):
    return stats.annual_runoff_stats(view(s, d, "annual")).select(
        "post", "n", "mean", "std", "cv", "cs", "cs_empirical", "r1", "k_r", "epsilon", "reliability",
        F.size("warnings").alias("n_warnings"))


@register("d06_max_runoff_stats", annual_cte(v="daily", views=("daily",)) + f""", e AS (SELECT *, cv / sqrt(n) * 100 AS epsilon FROM m)
 SELECT post, {B('n')}, {R('mean', 'std', 'cv', 'CASE WHEN cv <= 0.5 THEN 2 * cv ELSE 3 * cv END AS cs', 'cs AS cs_empirical', 'epsilon')},
 CASE WHEN epsilon > 15 OR n < 10 THEN 'unreliable' WHEN n < 20 THEN 'reduced' ELSE 'reliable' END AS reliability FROM e WHERE n >= 3""")
def _(s, d):
    return stats.max_runoff_stats(view(s, d, "daily")).drop("min", "max")


CAT = """cat AS (SELECT split_part(post, '-', 1) AS post, split_part(post, '-', 2) AS category, value FROM many)"""


@register("d07_category_stats", with_views("many") + ", " + CAT + f""" SELECT post, category, {B('count(*) AS n')},
 {R('CASE WHEN count(*) >= 3 THEN avg(value) END AS mean', 'CASE WHEN count(*) >= 3 THEN stddev_samp(value) END AS std',
    'CASE WHEN count(*) >= 3 THEN stddev_samp(value) / avg(value) END AS cv', 'CASE WHEN count(*) >= 3 THEN skewness(value) END AS cs',
    'min(value) AS min', 'max(value) AS max')} FROM cat GROUP BY 1, 2""")
def _(s, d):
    part = F.split("post", "-")
    v = view(s, d, "many").select(part[0].alias("post"), part[1].alias("category"), "value")
    return stats.category_stats(v, ["post", "category"])


@register("d08_length_warnings", with_views("sparse") + f""", c AS (SELECT post, count(*) AS n FROM sparse GROUP BY 1)
 SELECT post, {B('n')}, CAST((CASE WHEN n < 50 THEN 1 ELSE 0 END) + (CASE WHEN n < 25 THEN 1 ELSE 0 END)
  + (CASE WHEN n < 30 THEN 1 ELSE 0 END) + (CASE WHEN n < 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_warnings FROM c""")
def _(s, d):
    return stats.length_warnings(view(s, d, "sparse"), 0.01).select("post", "n", F.size("warnings").alias("n_warnings"))


@register("d09_module_and_layer", with_views("many") + f""", q AS (SELECT post, avg(value) AS mean FROM many GROUP BY 1),
 a AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS nation, sum(c_acctbal) / 1000 AS area_km2 FROM customer GROUP BY 1)
 SELECT post, {R('mean', 'area_km2', 'CASE WHEN area_km2 > 0 THEN mean * 1000 / area_km2 ELSE 0 END AS module',
   'CASE WHEN area_km2 > 0 THEN mean * 31.536 / 1000 ELSE 0 END AS volume',
   'CASE WHEN area_km2 > 0 THEN mean * 31536 / area_km2 ELSE 0 END AS layer',
   'CASE WHEN area_km2 > 0 THEN mean END AS discharge', digits=5)} FROM q JOIN a ON nation = split_part(post, '-', 1)""", digits=5)
def _(s, d):
    area = table(s, d, "customer").groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation")).agg(
        (F.sum("c_acctbal") / 1000).alias("area_km2"))
    q = view(s, d, "many").groupBy("post").agg(F.avg("value").alias("mean")).withColumn("nation", F.split("post", "-")[0])
    return stats.from_module(stats.module_and_layer(q.join(area, "nation"))).drop("nation")


@register("d10_correlation_matrix", with_views("many") + f""" SELECT a.post AS post_a, b.post AS post_b, {B('count(*) AS n')},
 {R("CASE WHEN count(*) >= 2 AND var_pop(a.value) > 1e-9 AND var_pop(b.value) > 1e-9 THEN corr(a.value, b.value) END AS r")}
 FROM many a JOIN many b ON a.t = b.t AND a.post < b.post GROUP BY 1, 2""")
def _(s, d):
    return stats.correlation_matrix(view(s, d, "many"))


@register("d11_histogram", with_views("annual") + f""", e AS (SELECT post, min(value) AS lo, max(value) AS hi FROM annual GROUP BY 1)
 SELECT post, {B('least(floor((value - lo) / ((hi - lo) / 15)), 14) AS bin')},
 {R('lo + least(floor((value - lo) / ((hi - lo) / 15)), 14) * ((hi - lo) / 15) AS "left"')}, {B('count(*) AS count')}
 FROM annual JOIN e USING (post) GROUP BY ALL""")
def _(s, d):
    return stats.histogram_bins(view(s, d, "annual"))


@register("d11_box_stats", with_views("annual") + f""", q AS (SELECT post, count(*) AS n, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM annual GROUP BY 1)
 SELECT post, {B('n')}, {R('q1', 'median', 'q3', 'min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS whisker_low',
  'max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high')},
 {B('count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS fliers')}
 FROM annual JOIN q USING (post) GROUP BY post, n, q1, median, q3""")
def _(s, d):
    return stats.box_stats(view(s, d, "annual"))


# --- gaps ---------------------------------------------------------------------------------
SPINE = """sp AS (SELECT post, unnest(range(min(t), max(t) + 1)) AS t FROM {v} GROUP BY post),
 full_s AS (SELECT sp.post, sp.t, {v}.value FROM sp LEFT JOIN {v} ON sp.post = {v}.post AND sp.t = {v}.t)"""


@register("q01_missing_count", with_views("sparse") + ", " + SPINE.format(v="sparse") + f"""
 SELECT post, {B('count(*) AS steps', 'count(*) - count(value) AS missing')} FROM full_s GROUP BY post""")
def _(s, d):
    return quality.missing_count(view(s, d, "sparse"))


@register("q02_fill_by_interpolation", with_views("many") + ", " + SPINE.format(v="many") + f""",
 n AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY t) AS i, count(*) OVER (PARTITION BY post) AS n FROM full_s),
 f AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER w1 AS ia, last_value(value IGNORE NULLS) OVER w1 AS va,
   first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER w2 AS ib, first_value(value IGNORE NULLS) OVER w2 AS vb FROM n
   WINDOW w1 AS (PARTITION BY post ORDER BY t ROWS UNBOUNDED PRECEDING),
          w2 AS (PARTITION BY post ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 md AS (SELECT post, quantile_cont(value, 0.5) AS median FROM many GROUP BY post)
 SELECT post, {B('t')}, {R('coalesce(value, CASE WHEN n < 10 THEN median WHEN ia IS NULL THEN vb WHEN ib IS NULL THEN va ELSE va + (vb - va) * (i - ia) / (ib - ia) END) AS value')},
  value IS NULL AS filled FROM f JOIN md USING (post)""")
def _(s, d):
    v = quality.on_spine(view(s, d, "many")).select("post", "t", "value")
    return quality.fill_by_interpolation(v)


@register("q03_fill_by_correlation", with_views("many") + f""", c AS (SELECT a.post AS target, b.post AS analog, count(*) AS n,
   corr(a.value, b.value) AS r, regr_slope(a.value, b.value) AS slope, regr_intercept(a.value, b.value) AS intercept
   FROM many a JOIN many b ON a.t = b.t AND a.post <> b.post GROUP BY 1, 2
   HAVING count(*) >= 5 AND var_pop(a.value) > 1e-9 AND var_pop(b.value) > 1e-9),
 best AS (SELECT target, arg_max(struct_pack(analog, slope, intercept), abs(r)) AS b FROM c GROUP BY 1)
 SELECT post, {B('t')}, {R('value')}, false AS filled FROM many
 UNION ALL SELECT target, {B('m.t AS t')}, {R('b.slope * m.value + b.intercept AS value')}, true FROM best JOIN many m ON m.post = b.analog
  WHERE NOT EXISTS (SELECT 1 FROM many x WHERE x.post = target AND x.t = m.t)""")
def _(s, d):
    return quality.fill_by_correlation(view(s, d, "many"))


# --- outliers and homogeneity ---------------------------------------------------------------
ENDS = """s AS (SELECT post, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, skewness(value) AS cs FROM {v} GROUP BY post),
 x AS (SELECT post, n, mean, std, cs, v[1] AS a1, v[2] AS a2, v[3] AS a3, v[n] AS z1, CASE WHEN n >= 2 THEN v[n - 1] END AS z2, CASE WHEN n >= 3 THEN v[n - 2] END AS z3 FROM s),
 dx AS (SELECT *, CASE WHEN z1 > a1 AND n >= 2 THEN (a2 - a1) / (z1 - a1) ELSE 0 END AS D1N,
   CASE WHEN z1 > a1 AND n >= 3 THEN (a3 - a1) / (z1 - a1) ELSE 0 END AS D2N,
   CASE WHEN z1 > a1 AND n >= 3 THEN (z1 - z3) / (z1 - a1) ELSE 0 END AS D3N,
   CASE WHEN z1 > a1 AND n >= 3 THEN (z1 - z2) / (z1 - a1) ELSE 0 END AS D4N,
   CASE WHEN z1 > a1 AND n >= 3 AND a2 > a1 THEN (z1 - z2) / (a2 - a1) ELSE 0 END AS D5N,
   CASE WHEN n >= 3 AND std >= 1e-12 THEN greatest(z1 - mean, mean - a1) / std ELSE 0 END AS Gn,
   CASE WHEN n >= 3 AND std >= 1e-12 THEN (z1 - z2) / std ELSE 0 END AS G1 FROM x)"""
ENDS_MANY = with_views("many") + ", " + ENDS.format(v="many")


@register("q04_dixon_criteria", ENDS_MANY + f" SELECT post, {B('n')}, {R('D1N', 'D2N', 'D3N', 'D4N', 'D5N')} FROM dx")
def _(s, d):
    return quality.dixon(quality.end_values(view(s, d, "many"))).select("post", "n", "D1N", "D2N", "D3N", "D4N", "D5N")


def _by_skew(alpha):
    lerp = sqltext.lerp
    t = fixed.DIXON_BY_SKEW
    return (f"CASE WHEN n > 30 THEN {fixed.DIXON_LONG[alpha]} WHEN n >= 3 THEN CASE WHEN cs < 0.5 THEN {lerp('n', t[(alpha, 'low')])} "
            f"WHEN cs < 1.5 THEN {lerp('n', t[(alpha, 'med')])} ELSE {lerp('n', t[(alpha, 'high')])} END END")


@register("q05_critical_values", with_views("sparse") + f""", m AS (SELECT post, count(*) AS n, skewness(value) AS cs FROM sparse GROUP BY 1)
 SELECT post, {B('n')}, {R(sqltext.lerp('n', fixed.DIXON[0.01]) + ' AS dixon', _by_skew(0.05) + ' AS dixon_by_skew',
   sqltext.lerp('n', fixed.GRUBBS_MAX[0.05]) + ' AS grubbs_max', sqltext.lerp('n', fixed.GRUBBS_GAP[0.1]) + ' AS grubbs_gap',
   'CASE WHEN n <= 10 THEN 2.03 WHEN n <= 15 THEN 2.21 WHEN n <= 20 THEN 2.32 WHEN n <= 30 THEN 2.48 ELSE 2.62 END AS grubbs_step')} FROM m""")
def _(s, d):
    n, cs = F.col("n"), F.col("cs")
    m = stats.moments(view(s, d, "sparse"))
    return m.select(
        "post", "n", quality.dixon_critical(n, 0.01).alias("dixon"), quality.dixon_critical_by_skew(n, cs).alias("dixon_by_skew"),
        quality.lerp(n, fixed.GRUBBS_MAX[0.05]).alias("grubbs_max"), quality.lerp(n, fixed.GRUBBS_GAP[0.10]).alias("grubbs_gap"),
        quality.grubbs_critical_step(n).alias("grubbs_step"))


@register("q06_grubbs_criteria", ENDS_MANY + f" SELECT post, {B('n')}, {R('Gn', 'G1')} FROM dx")
def _(s, d):
    return quality.outlier_criteria(view(s, d, "many")).select("post", "n", "Gn", "G1")


_CRIT = {k: f"({sqltext.lerp('n', fixed.DIXON[0.05])}) * {f!r}" for k, f in fixed.DIXON_FACTOR.items()}
_CRIT["Gn"] = sqltext.lerp("n", fixed.GRUBBS_MAX[0.05])
_CRIT["G1"] = sqltext.lerp("n", fixed.GRUBBS_GAP[0.05])
LONG = ENDS_MANY + ", h AS (" + " UNION ALL ".join(
    f"SELECT post, n, '{k}' AS criterion, {k} AS empirical, {c} AS critical FROM dx" for k, c in _CRIT.items()) + ")"


@register("q07_homogeneity", LONG + f" SELECT post, {B('n')}, criterion, {R('empirical', 'critical')}, empirical > critical AS significant FROM h WHERE n >= 3")
def _(s, d):
    return quality.homogeneity(view(s, d, "many"))


@register("q07_homogeneity_summary", LONG + f""" SELECT post, {B('n')}, n < 20 AS skipped,
  CASE WHEN n >= 20 THEN count(*) FILTER (empirical > critical) END AS exceeded,
  CASE WHEN n >= 20 THEN count(*) FILTER (empirical > critical) = 0 END AS homogeneous,
  CASE WHEN n >= 20 THEN count(*) FILTER (empirical > critical AND criterion IN ('D1N', 'Gn')) = 0 END AS homogeneous_basic
 FROM h GROUP BY post, n""")
def _(s, d):
    return quality.homogeneity_summary(view(s, d, "many"))


@register("q08_outliers", with_views("daily") + f""", m AS (SELECT post, avg(value) AS mean, stddev_pop(value) AS sd,
   quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM daily GROUP BY 1)
 SELECT post, {B('t')}, {R('value', 'abs(value - mean) / sd AS z')}, abs(value - mean) / sd > 3 AS by_z,
  value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS by_iqr FROM daily JOIN m USING (post)
 WHERE abs(value - mean) / sd > 3 OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def _(s, d):
    return quality.outliers(view(s, d, "daily"))


PARTS = """nb AS (SELECT post, t, value, row_number() OVER (PARTITION BY post ORDER BY t) AS i, count(*) OVER (PARTITION BY post) AS n FROM annual),
 pt AS (SELECT *, CASE WHEN i <= n // 2 THEN 1 ELSE 2 END AS part FROM nb),
 pm AS (SELECT post, count(*) FILTER (part = 1) AS n1, count(*) FILTER (part = 2) AS n2, avg(value) FILTER (part = 1) AS mean1, avg(value) FILTER (part = 2) AS mean2,
   var_samp(value) FILTER (part = 1) AS var1, var_samp(value) FILTER (part = 2) AS var2 FROM pt GROUP BY post)"""
_WELCH = "abs((mean1 - mean2) / sqrt(var1 / n1 + var2 / n2))"
_WDF = "(pow(var1 / n1 + var2 / n2, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1)))"


@register("q09_stationarity", with_views("annual") + ", " + PARTS + f""",
 w AS (SELECT *, {_WELCH} AS t_stat, {_WDF} AS t_df, greatest(var1, var2) / least(var1, var2) AS f_stat FROM pm)
 SELECT post, {B('n1', 'n2')}, {R('mean1', 'mean2', 'var1', 'var2', 't_stat', 'f_stat',
   sqltext.t_two_sided('t_stat', 't_df') + ' AS t_p', sqltext.f_upper('f_stat', '(n1 - 1.0)', '(n2 - 1.0)') + ' AS f_p')} FROM w""")
def _(s, d):
    return quality.stationarity(view(s, d, "annual")).drop("t_critical", "f_critical", "stationary")


@register("q09_stationarity_verdict")
def _(s, d):
    return quality.stationarity(view(s, d, "annual"), split_year=1940)


RANKT = """mr AS (SELECT *, rank() OVER (PARTITION BY post ORDER BY value) + (count(*) OVER (PARTITION BY post, value) - 1) / 2.0 AS r FROM pt),
 cd AS (SELECT post, value, (SELECT count(*) FROM pt b WHERE b.post = a.post AND b.part = 1 AND b.value <= a.value) / CAST(max(n1) AS DOUBLE)
   - (SELECT count(*) FROM pt b WHERE b.post = a.post AND b.part = 2 AND b.value <= a.value) / CAST(max(n2) AS DOUBLE) AS g FROM pt a JOIN pm USING (post) GROUP BY post, value),
 rk AS (SELECT post, sum(r) FILTER (part = 1) AS rank_sum FROM mr GROUP BY post),
 ks AS (SELECT post, max(abs(g)) AS ks FROM cd GROUP BY post),
 ti AS (SELECT post, sum(c * c * c - c) AS ties FROM (SELECT post, value, count(*) AS c FROM pt GROUP BY 1, 2) GROUP BY post),
 rt AS (SELECT pm.*, CAST(n1 + n2 AS DOUBLE) AS n, rank_sum, ks, ties, rank_sum - n1 * (n1 + 1) / 2.0 AS u FROM pm JOIN rk USING (post) JOIN ks USING (post) JOIN ti USING (post)),
 rz AS (SELECT *, (rank_sum - n1 * (n + 1) / 2) / sqrt(n1 * n2 * (n + 1) / 12) AS w_z,
   (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) AS u_z,
   (mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n - 2) * (1.0 / n1 + 1.0 / n2)) AS t_stat, var1 / var2 AS f_stat FROM rt)"""
_WTAIL = sqltext.normal_two_sided("w_z")
_UTAIL = f"CASE WHEN u_z > 0 THEN {sqltext.normal_two_sided('u_z')} ELSE 1.0 END"
_KS = "list_sum(list_transform(range(1, 200), lambda k: 2 * pow(-1, k - 1) * exp(-2 * k * k * ks * ks * n1 * n2 / n)))"
TWO = f"""{B('n1', 'n2', 'u')}, {R('t_stat', 'f_stat', 'rank_sum', 'w_z', 'ks', sqltext.t_two_sided('t_stat', '(n - 2)') + ' AS t_p',
   sqltext.f_upper('f_stat', '(n1 - 1.0)', '(n2 - 1.0)') + ' AS f_p', _WTAIL + ' AS w_p', _UTAIL + ' AS u_p', _KS + ' AS ks_p')}"""


@register("q10_half_split_tests", with_views("annual") + ", " + PARTS + ", " + RANKT + f" SELECT post, {TWO} FROM rz")
def _(s, d):
    return quality.two_part_tests(quality.halves(view(s, d, "annual"))).drop("homogeneous").withColumn("u", F.col("u").cast("bigint"))


@register("q11_two_part_homogeneity", with_views("annual") + ", " + PARTS.replace("i <= n // 2", "t < 1950") + ", " + RANKT + f" SELECT post, {TWO} FROM rz")
def _(s, d):
    return quality.two_part_tests(quality.halves(view(s, d, "annual"), 1950)).drop("homogeneous").withColumn("u", F.col("u").cast("bigint"))
