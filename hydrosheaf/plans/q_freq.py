"""Registered queries: exceedance curves, fits, design values."""

from pyspark.sql import functions as F

from hydrosheaf.functions import fixed
from hydrosheaf.operators import fits, freq
from hydrosheaf.operators.stats import annual_runoff_stats, parameters
from hydrosheaf.plans import sqltext
from hydrosheaf.plans.catalog import B, R, register
from hydrosheaf.plans.q_stats import NORM, PARAMS, annual_cte
from hydrosheaf.plans.views import table, view, with_views

ANN = with_views("annual")


def plist(ps, percent=False):
    s = 100.0 if percent else 1.0
    return "(VALUES " + ", ".join(f"(CAST({float(p) / s!r} AS DOUBLE))" for p in ps) + ") v(p)"


RANK = """rk AS (SELECT post, value, count(*) OVER (PARTITION BY post) AS n,
  row_number() OVER (PARTITION BY post ORDER BY value DESC) AS m FROM {v})"""
Q3 = "greatest(mean + mean * greatest(abs(cv), 0.001) * z, 0)"


def curve_sql(head: str, src: str, ps, tail: str, percent=False) -> str:
    """Join parameters ``src`` (with cs) to probabilities and to the Pearson III deviate."""
    return head + f""", pq AS (SELECT * FROM {src}, {plist(ps, percent)}), {sqltext.pearson3('pq')},
 cz AS (SELECT pq.*, z FROM pq JOIN p3z ON pq.p = p3z.p AND pq.cs = p3z.cs) {tail}"""


@register("f01_plotting_positions", ANN + ", " + RANK.format(v="annual") + f" SELECT post, {B('n', 'm')}, {R('value', '(m - 0.3) / (n + 0.4) AS p_median')} FROM rk")
def _(s, d):
    return freq.plotting_positions(view(s, d, "annual"))


@register("f02_plotting_position_formulas", with_views("daily") + ", " + RANK.format(v="daily") + f""" SELECT post, {B('n', 'm')},
 {R('value', 'm / (n + 1) AS p_weibull', '(m - 0.5) / n AS p_hazen', '(m - 0.44) / (n + 0.12) AS p_gringorten')} FROM rk""")
def _(s, d):
    return freq.plotting_positions(view(s, d, "daily"), ("weibull", "hazen", "gringorten"))


@register("f03_pearson3_quantiles", curve_sql(PARAMS, "p", fixed.P_CURVE, f"SELECT post, {R('p', Q3 + ' AS q')} FROM cz"))
def _(s, d):
    return freq.pearson3_curve(parameters(view(s, d, "annual")), fixed.P_CURVE).select("post", "p", "q")


@register("f03_module_quantiles", curve_sql(PARAMS + NORM, "e", fixed.P_KM, f"SELECT post, {R('p', 'z', '1 + cv * z AS kp', 'mean * (1 + cv * z) AS q')} FROM cz", True))
def _(s, d):
    return freq.module_quantiles(annual_runoff_stats(view(s, d, "annual"))).select("post", "p", "z", "kp", "q")


@register("f05_kritsky_menkel_quantiles", curve_sql(PARAMS + NORM, "e", fixed.P_CURVE,
    f"""SELECT post, {R('p', 'greatest(mean * (1 - 2 * cv / cs) + mean * cv * cs / 2 * (4 / (cs * cs) + z * 2 / cs), 0) AS q')} FROM cz"""))
def _(s, d):
    return freq.kritsky_menkel_curve(annual_runoff_stats(view(s, d, "annual")), fixed.P_CURVE).select("post", "p", "q")


EMP = """ep AS (SELECT post, count(*) AS n, list_sort(list(value), 'DESC') AS v FROM {v} GROUP BY post),
 em AS (SELECT *, least(greatest(p * (n + 0.4) + 0.3, 1.0), n) AS m FROM ep, {ps})"""
EMPQ = "v[CAST(floor(m) AS BIGINT)] + (v[CAST(ceil(m) AS BIGINT)] - v[CAST(floor(m) AS BIGINT)]) * (m - floor(m))"


@register("f06_curve_empirical", ANN + ", " + EMP.format(v="annual", ps=plist(fixed.P_CURVE)) + f" SELECT post, {R('p', EMPQ + ' AS q')} FROM em")
def _(s, d):
    return freq.frequency_curve(view(s, d, "annual"), "empirical")


@register("f06_curve_normal", annual_cte() + f""", pq AS (SELECT *, 1 - p AS q FROM m, {plist(fixed.P_CURVE)}), {sqltext.normal_ppf('pq')}
 SELECT post, {R('p', 'mean + std * z AS q')} FROM pq JOIN nz USING (q)""")
def _(s, d):
    return freq.frequency_curve(view(s, d, "annual"), "normal")


KM = "greatest(mean * (1 - 2 * greatest(abs(cv), 0.001) / cs0) + mean * greatest(abs(cv), 0.001) * cs / 2 * (4 / (cs * cs) + 2 / cs * z), 0)"


def km_params(src: str) -> str:
    return f"kp AS (SELECT * EXCLUDE (cs), CASE WHEN abs(cs) < 0.001 THEN 0.001 ELSE cs END AS cs0, greatest(abs(cs), 0.001) AS cs FROM {src})"


@register("f06_curve_kritsky_menkel", curve_sql(PARAMS + ", " + km_params("p"), "kp", fixed.P_CURVE, f"SELECT post, {R('p', KM + ' AS q')} FROM cz"))
def _(s, d):
    return freq.frequency_curve(view(s, d, "annual"), "kritsky_menkel")


@register("f07_design_discharges", curve_sql(PARAMS, "p", fixed.P_CURVE, f""", lv AS (SELECT post, level, p, {Q3} AS q,
  row_number() OVER (PARTITION BY post, level ORDER BY round(abs(p - level), 9), p) AS k FROM cz, {plist(fixed.P_LEVELS).replace('v(p)', 'v(level)')})
 SELECT post, {R('level', 'p', 'q')} FROM lv WHERE k = 1"""))
def _(s, d):
    return freq.design_discharges(view(s, d, "annual"))


@register("f08_best_ratio", digits=5)
def _(s, d):
    return freq.best_ratio(view(s, d, "annual"))


@register("f08_ratio_scores_daily", digits=3)
def _(s, d):
    return freq.ratio_scores(view(s, d, "daily"), lo=0.0, hi=4.0, step=0.25)


LNF = """fs AS (SELECT post, avg(value) AS mu, stddev_pop(value) AS sigma, stddev_samp(value) AS sd, avg(ln(value)) AS mu_ln, stddev_pop(ln(value)) AS sigma_ln, count(*) AS n FROM {v} GROUP BY post)"""


@register("f09_fitted_quantiles", ANN + ", " + LNF.format(v="annual") + f""", pq AS (SELECT *, 1 - p AS q FROM fs, {plist(fixed.P_CURVE)}), {sqltext.normal_ppf('pq')}
 SELECT post, {R('p', 'mu + sigma * z AS normal', 'exp(mu_ln + sigma_ln * z) AS lognormal')} FROM pq JOIN nz USING (q)""")
def _(s, d):
    return fits.fitted_quantiles(view(s, d, "annual")).drop("gamma")


@register("f09_gamma_quantiles", digits=4)
def _(s, d):
    return fits.fitted_quantiles(view(s, d, "annual")).select("post", "p", "gamma")


@register("f10_fit_pearson3", digits=3)
def _(s, d):
    return fits.fit_pearson3(view(s, d, "annual"))


@register("f10_fit_log_pearson3", digits=3)
def _(s, d):
    return fits.fit_log_pearson3(view(s, d, "annual"))


@register("f10_fit_gev", digits=3)
def _(s, d):
    return fits.fit_gev(view(s, d, "annual"))


@register("f10_fit_weibull", digits=3)
def _(s, d):
    return fits.fit_weibull(view(s, d, "annual"))


@register("f11_compare_laws", digits=3)
def _(s, d):
    return fits.compare_laws(view(s, d, "annual"))


_RATIOS = tuple(x / 2 for x in range(-2, 13))
_CVS = tuple(x / 10 for x in range(1, 21))


@register("f12_ordinates", PARAMS + NORM + f""", nd AS (SELECT post, mean, cv, cs / cv AS r, floor(cs / cv * 2) / 2 AS r0, floor(cv * 10) / 10 AS c0 FROM e),
 nc AS (SELECT post, mean, CASE WHEN cv < 0.1 THEN 0.1 ELSE c0 END AS c0, CASE WHEN cv < 0.1 THEN 0.0 ELSE (cv - c0) * 10 END AS w FROM nd),
 co AS (SELECT post, mean, round(c0, 6) AS c, 1 - w AS w FROM nc UNION ALL SELECT post, mean, round(c0 + 0.1, 6), w FROM nc),
 pq AS (SELECT *, round(2.0 * c, 9) AS cs FROM co, {plist(fixed.P_ORDINATES, True)}), {sqltext.pearson3('pq')}
 SELECT post, {R('p', 'sum(w * greatest(1 + c * z, 0)) AS k', 'sum(w * greatest(1 + c * z, 0)) * mean AS q', digits=5)}
 FROM pq JOIN p3z USING (p, cs) GROUP BY post, mean, p""", digits=5)
def _(s, d):
    t = freq.ordinate_table(s, _RATIOS, _CVS)
    p = annual_runoff_stats(view(s, d, "annual"))
    return freq.lookup_ordinates(p, t, _RATIOS, _CVS).select("post", "p", "k", "q")


# structures: suppliers; height and volume from the balance
STRUCT = """st AS (SELECT CAST(s_suppkey AS VARCHAR) AS structure, s_nationkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal / 70 END AS height,
  CASE WHEN s_acctbal < 9000 THEN abs(s_acctbal) / 5 END AS volume FROM supplier),
 sc AS (SELECT *, CASE WHEN height IS NOT NULL THEN CASE WHEN height > 100 THEN 'I' WHEN height > 50 THEN 'II' WHEN height > 15 THEN 'III' ELSE 'IV' END
   WHEN volume IS NOT NULL THEN CASE WHEN volume > 1000 THEN 'I' WHEN volume > 100 THEN 'II' WHEN volume > 10 THEN 'III' ELSE 'IV' END ELSE 'I' END AS structure_class FROM st)"""
CLASSP = "cp(structure_class, p_max_main, p_max_check, p_min_main, p_min_check) AS (VALUES " + ", ".join(
    f"('{k}', " + ", ".join(f"CAST({x} AS DOUBLE)" for x in v) + ")" for k, v in fixed.STRUCTURE_P.items()) + ")"


def structures(s, d):
    b = F.col("s_acctbal")
    t = table(s, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("structure"), "s_nationkey",
        F.when(b >= 0, b / 70).alias("height"), F.when(b < 9000, F.abs(b) / 5).alias("volume"))
    return freq.classify_structures(t)


@register("f14_structure_classes", f"WITH {STRUCT}, {CLASSP} SELECT structure, structure_class, {R('height', 'volume', 'p_max_main', 'p_max_check', 'p_min_main', 'p_min_check')} FROM sc JOIN cp USING (structure_class)")
def _(s, d):
    return structures(s, d).drop("s_nationkey")


def post_classes(s, d):
    """Every post of the annual view with the classes that occur among the structures."""
    k = F.element_at(F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (F.pmod("s_nationkey", F.lit(5)) + 1).cast("int"))
    return structures(s, d).select(k.alias("post"), "structure_class").distinct()


PC = """pc AS (SELECT DISTINCT (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[s_nationkey % 5 + 1] AS post, structure_class FROM sc)"""
CLASSCURVE = PARAMS + f""", {STRUCT}, {CLASSP}, {PC},
 pq AS (SELECT DISTINCT post, structure_class, mean, cv, cs, p FROM (SELECT p.*, structure_class, unnest([{', '.join(repr(float(x)) + '::DOUBLE' for x in fixed.P_STRUCTURE)}, p_max_main, p_min_main]) AS p
   FROM p JOIN pc USING (post) JOIN cp USING (structure_class))), {sqltext.pearson3('pq')},
 cc AS (SELECT post, structure_class, pq.p, {Q3} AS q FROM pq JOIN p3z ON pq.p = p3z.p AND pq.cs = p3z.cs)"""


@register("f13_class_curve", CLASSCURVE + f" SELECT post, structure_class, {R('p', 'q')} FROM cc")
def _(s, d):
    return freq.class_curve(view(s, d, "annual"), post_classes(s, d))


INTERP = """sg AS (SELECT *, lead(p) OVER w AS p2, lead(q) OVER w AS q2, row_number() OVER w AS k FROM cc WINDOW w AS (PARTITION BY post, structure_class ORDER BY p)),
 tg AS (SELECT post, structure_class, unnest(['max_main', 'max_check', 'min_main', 'min_check']) AS "case", unnest([p_max_main, p_max_check, p_min_main, p_min_check]) AS target FROM pc JOIN cp USING (structure_class))"""


@register("f13_class_design_points", CLASSCURVE + ", " + INTERP + f""" SELECT post, structure_class, "case", {R('target',
  'CASE WHEN target <= p THEN q WHEN p2 IS NULL THEN q ELSE q + (q2 - q) * (target - p) / (p2 - p) END AS q')} FROM tg JOIN sg USING (post, structure_class)
 WHERE (k = 1 AND target <= p) OR (target > p AND (p2 IS NULL OR target <= p2))""")
def _(s, d):
    return freq.class_design_points(view(s, d, "annual"), post_classes(s, d))


def _mixed_sql(source: str, start: str, keep: str, name: str, out: str) -> str:
    """CTEs ``name``a to ``name``: the bits of a 32-bit number ``start`` spread as the operator does it."""
    low = fits.LOW
    return f"""{name}a AS (SELECT {keep}, ({start}) & {low} AS x FROM {source}),
 {name}b AS (SELECT {keep}, (xor(x, x >> 16) * {fits.MIX[0]}) & {low} AS x FROM {name}a),
 {name}c AS (SELECT {keep}, (xor(x, x >> 15) * {fits.MIX[1]}) & {low} AS x FROM {name}b),
 {name} AS (SELECT {keep}, xor(x, x >> 15) AS {out} FROM {name}c)"""


BOOT = f"""{PARAMS}, bs AS (SELECT post, list(value ORDER BY t) AS v, count(*) AS n, avg(value) AS m FROM annual WHERE value IS NOT NULL GROUP BY post HAVING count(*) >= 3),
 br AS (SELECT post, n, ('0x' || substr(sha256('42:' || post || ':0'), 1, 8))::BIGINT AS h, unnest(range(1000)) AS rep FROM bs),
 {_mixed_sql("br", "h + rep", "post, n, rep", "bm", "s")},
 bk AS (SELECT post, n, rep, s, unnest(range(n)) AS k FROM bm),
 {_mixed_sql("bk", f"s + k * {fits.STRIDE}", "post, n, rep", "bd", "u")},
 bv AS (SELECT bd.post, rep, bs.m, v[1 + ((u * bs.n) >> 32)] - m AS x FROM bd JOIN bs USING (post)),
 bp AS (SELECT post, rep, m, count(*)::DOUBLE AS n, avg(x) AS mu, greatest(avg(x * x) - avg(x) * avg(x), 0) AS m2,
   avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) * avg(x) * avg(x) AS m3 FROM bv GROUP BY post, rep, m),
 bq AS (SELECT post, rep, m + mu AS mean, CASE WHEN m + mu <> 0 THEN sqrt(m2 * n / (n - 1)) / (m + mu) ELSE 0 END AS cv,
   CASE WHEN m2 > 1e-20 THEN m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2) ELSE 0 END AS cs FROM bp),
 every AS (SELECT post, -1 AS rep, mean, cv, cs FROM p UNION ALL SELECT post, rep, mean, cv, cs FROM bq)"""


@register("f15_bootstrap_params", BOOT + f" SELECT post, {B('rep')}, {R('mean', 'cv', 'cs')} FROM every WHERE rep >= 0")
def _(s, d):
    return fits.bootstrap_params(view(s, d, "annual")).select("post", "rep", "mean", "cv", "cs")


@register("f15_bootstrap_bands", digits=3)
def _(s, d):
    return fits.bootstrap_bands(view(s, d, "annual"))


@register("f16_normal_interval", curve_sql(PARAMS, "p", (0.01, 0.05, 0.5, 0.95), f"SELECT post, {R('p', Q3 + ' AS q', 'mean * cv / sqrt(n) AS std_error', Q3 + ' - 1.959963984540054 * mean * cv / sqrt(n) AS q_low', Q3 + ' + 1.959963984540054 * mean * cv / sqrt(n) AS q_high')} FROM cz"))
def _(s, d):
    return freq.normal_interval(view(s, d, "annual"), (0.01, 0.05, 0.5, 0.95))


@register("f17_interpolate_ln_p", CLASSCURVE + ", " + INTERP + f""" SELECT post, structure_class, "case", {R('target',
  'CASE WHEN target <= p THEN q WHEN p2 IS NULL THEN q ELSE q + (q2 - q) * (ln(target) - ln(p)) / (ln(p2) - ln(p)) END AS q')} FROM tg JOIN sg USING (post, structure_class)
 WHERE (k = 1 AND target <= p) OR (target > p AND (p2 IS NULL OR target <= p2))""")
def _(s, d):
    cls = F.col("structure_class")
    pc = post_classes(s, d)
    cases = F.explode(F.array(*[F.struct(F.lit(c).alias("case"), freq.class_probability(cls, c).alias("target")) for c in ("max_main", "max_check", "min_main", "min_check")]))
    t = pc.select("post", "structure_class", cases.alias("x")).select("post", "structure_class", "x.*")
    return freq.interpolate_curve(freq.class_curve(view(s, d, "annual"), pc), t, ["post", "structure_class"], log_p=True)


# extremes of the years before the record: the largest order per priority and status
EXT = """ex AS (SELECT o_orderpriority AS post, o_orderstatus, max(o_totalprice) / 300 AS value, count(*) AS period FROM orders GROUP BY 1, 2)"""


def extremes(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("post"), "o_orderstatus").agg(
        (F.max("o_totalprice") / 300).alias("value"), F.count(F.lit(1)).alias("period"))


@register("f18_historical_extremes", annual_cte() + f""", {EXT}, dm AS (SELECT m.post, m.n, mean, m.cv, sum(CASE WHEN ex.value > mean THEN (ex.value - mean) / (n + 1) ELSE 0 END) AS delta_mean FROM m JOIN ex USING (post) GROUP BY m.post, m.n, mean, m.cv),
 dc AS (SELECT dm.*, mean + delta_mean AS mc FROM dm), de AS (SELECT dc.post, any_value(n) AS n, any_value(mean) AS mean, any_value(cv) AS cv, any_value(delta_mean) AS delta_mean, any_value(mc) AS mc, sqrt(any_value(cv) * any_value(cv) + sum(pow((ex.value - mc) / mc, 2) / (n + 1))) AS cc FROM dc JOIN ex USING (post) GROUP BY dc.post)
 SELECT post, {B('n')}, {R('mean AS mean_raw', 'cv AS cv_raw', 'delta_mean', 'mc AS mean_corrected', 'cc AS cv_corrected')} FROM de""")
def _(s, d):
    return freq.with_historical_extremes(view(s, d, "annual"), extremes(s, d))


@register("f18_extreme_probability", f"WITH {EXT} SELECT post, o_orderstatus, {B('period')}, {R('value', '1 / (period + 0.5) AS p')} FROM ex")
def _(s, d):
    return freq.extreme_probability(extremes(s, d))


def categories(s, d):
    v = view(s, d, "many")
    part = F.split("post", "-")
    return v.select(part[0].alias("post"), part[1].alias("category"), "value")


COMP = with_views("many") + f""", cat AS (SELECT split_part(post, '-', 1) AS post, split_part(post, '-', 2) AS category, value FROM many),
 cm AS (SELECT post, category, count(*) AS n, avg(value) AS mean, stddev_samp(value) / avg(value) AS cv, skewness(value) AS cs, min(value) AS lo, max(value) AS hi FROM cat GROUP BY 1, 2),
 sp AS (SELECT post, sum(n) AS total, greatest(min(lo) * 0.5, 0) AS x0, max(hi) * 1.5 AS x1 FROM cm GROUP BY 1 HAVING sum(n) >= 5 AND count(*) >= 2),
 pq AS (SELECT * FROM cm, {plist(fixed.P_BANDS)} WHERE n >= 3), {sqltext.pearson3('pq')},
 cv0 AS (SELECT post, category, n, pq.p, {Q3} AS q FROM pq JOIN p3z ON pq.p = p3z.p AND pq.cs = p3z.cs),
 cv1 AS (SELECT *, lead(q) OVER (PARTITION BY post, category ORDER BY q, p) AS q2, lead(p) OVER (PARTITION BY post, category ORDER BY q, p) AS p2, row_number() OVER (PARTITION BY post, category ORDER BY q, p) AS k FROM cv0),
 gr AS (SELECT post, total, g, x0 + (x1 - x0) / 199 * g AS x FROM sp, range(0, 200) r(g)),
 pg AS (SELECT gr.post, g, x, total, n, CASE WHEN x < q THEN p WHEN p2 IS NULL THEN p ELSE p + (p2 - p) * (x - q) / (q2 - q) END AS p FROM gr JOIN cv1 ON gr.post = cv1.post AND ((k = 1 AND x < q) OR (x >= q AND (q2 IS NULL OR x < q2)))),
 mx AS (SELECT post, g, x, round(least(greatest(sum(least(greatest(p, 0.0001), 0.9999) * n) / total, 0.0001), 0.9999), 12) AS pc FROM pg GROUP BY post, g, x, total),
 ms AS (SELECT *, lag(x) OVER (PARTITION BY post ORDER BY g) AS px, lag(pc) OVER (PARTITION BY post ORDER BY g) AS pp, min(pc) OVER (PARTITION BY post) AS pmin FROM mx),
 hit AS (SELECT post, t.p, x + (px - x) * (t.p - pc) / (pp - pc) AS q, row_number() OVER (PARTITION BY post, t.p ORDER BY g DESC) AS k FROM ms, {plist(fixed.P_COMPOSITE).replace('v(p)', 't(p)')} WHERE pc <= t.p AND t.p < pp),
 en AS (SELECT post, arg_max(x, g) AS xt, arg_max(pc, g) AS pt, arg_min(x, g) AS xl FROM mx GROUP BY post)"""


@register("f19_composite_curve", COMP + f""" SELECT en.post, {R('t.p AS p', 'coalesce(q, CASE WHEN t.p < pt THEN xt ELSE xl END) AS q')}
 FROM en CROSS JOIN {plist(fixed.P_COMPOSITE).replace('v(p)', 't(p)')} LEFT JOIN hit ON hit.post = en.post AND hit.p = t.p AND hit.k = 1""")
def _(s, d):
    return freq.composite_curve(categories(s, d))


@register("f20_two_part_curve", ANN + f""", pt AS (SELECT post, CASE WHEN t < 1940 THEN 1 ELSE 2 END AS part, value FROM annual),
 m AS (SELECT post, part, count(*) AS n, avg(value) AS mean, stddev_samp(value) / avg(value) AS cv, 2 * stddev_samp(value) / avg(value) AS cs FROM pt GROUP BY 1, 2),
 pq AS (SELECT * FROM m, {plist(fixed.P_TWO_PART)}), {sqltext.pearson3('pq')}, cz AS (SELECT pq.*, {Q3} AS q FROM pq JOIN p3z ON pq.p = p3z.p AND pq.cs = p3z.cs)
 SELECT post, {R('p', 'max(q) FILTER (part = 1) AS q1', 'max(q) FILTER (part = 2) AS q2', 'sum(q * n) / sum(n) AS q')} FROM cz GROUP BY post, p""")
def _(s, d):
    return freq.two_part_curve(view(s, d, "annual"), 1940)


MAXP = """, x AS (SELECT post, mean, cv, CASE WHEN cv <= 0.5 THEN 2 * cv ELSE 3 * cv END AS cs FROM m WHERE n >= 3)"""


@register("f21_max_runoff_curve", curve_sql(annual_cte() + MAXP, "x", fixed.P_MAX, f"SELECT post, {R('p', Q3 + ' AS q', Q3 + ' / mean AS kp')} FROM cz", True))
def _(s, d):
    return freq.max_runoff_curve(view(s, d, "annual"))


@register("f21_min_runoff_curve", curve_sql(PARAMS + NORM, "e", fixed.P_MIN, f"SELECT post, {R('p', 'mean * (1 + cv * z) AS q')} FROM cz", True))
def _(s, d):
    return freq.min_runoff_curve(view(s, d, "annual"))


@register("f21_seasonal_curves", curve_sql(with_views("many") + """, cat AS (SELECT split_part(post, '-', 1) AS post, split_part(post, '-', 2) AS category, value FROM many),
 e AS (SELECT post, category, avg(value) AS mean, stddev_samp(value) / avg(value) AS cv, 2 * (stddev_samp(value) / avg(value)) AS cs FROM cat GROUP BY 1, 2)""",
    "e", fixed.P_SEASON, f"SELECT post, category, {R('p', 'mean * (1 + cv * z) AS q')} FROM cz", True))
def _(s, d):
    part = F.split("post", "-")
    v = view(s, d, "many").select(part[0].alias("post"), part[1].alias("category"), "t", "value")
    return freq.min_runoff_curve(v, fixed.P_SEASON, ("post", "category"))


IDX = """dim AS (SELECT o_orderpriority AS post, avg(o_totalprice) / 5000 AS gauged_mean, max(o_totalprice) / 9000 AS target_mean FROM orders GROUP BY 1)"""


@register("f22_index_year_curve", curve_sql(PARAMS + NORM + f""", {IDX}, ix AS (SELECT e.post, e.mean / gauged_mean AS mean, cv, cs, target_mean FROM e JOIN dim USING (post))""",
    "ix", fixed.P_INDEX, f"SELECT post, {R('p', Q3 + ' AS kp', Q3 + ' * target_mean AS q')} FROM cz", True))
def _(s, d):
    dim = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("post")).agg(
        (F.avg("o_totalprice") / 5000).alias("gauged_mean"), (F.max("o_totalprice") / 9000).alias("target_mean"))
    return freq.index_year_curve(view(s, d, "annual"), dim)


GOF = LNF.format(v="annual") + f""", rk AS (SELECT post, value, row_number() OVER (PARTITION BY post ORDER BY value) AS i FROM annual),
 rf AS (SELECT rk.*, n, {sqltext.normal_cdf('((value - mu) / sigma)')} AS F, {sqltext.normal_cdf('((value - mu) / sd)')} AS A FROM rk JOIN fs USING (post)),
 gs AS (SELECT post, n, max(greatest(i / n - F, F - (i - 1) / n)) AS ks, -n - sum((2 * i - 1) * ln(A) + (2 * n + 1 - 2 * i) * ln(1 - A)) / n AS ad FROM rf GROUP BY post, n),
 en AS (SELECT post, min(value) AS lo, max(value) AS hi, CAST(greatest(5, floor(sqrt(count(*)))) AS BIGINT) AS bins FROM annual GROUP BY post),
 bn AS (SELECT post, least(floor((value - lo) / ((hi - lo) / bins)), bins - 1) AS b, count(*) AS seen FROM annual JOIN en USING (post) GROUP BY 1, 2),
 be AS (SELECT post, bins, bb AS b, lo + bb * ((hi - lo) / bins) AS x0, CASE WHEN bb = bins - 1 THEN hi ELSE lo + (bb + 1) * ((hi - lo) / bins) END AS x1 FROM (SELECT *, unnest(range(0, bins)) AS bb FROM en)),
 bx AS (SELECT be.post, bins, coalesce(seen, 0) AS seen, greatest(({sqltext.normal_cdf('((x1 - mu) / sigma)')} - {sqltext.normal_cdf('((x0 - mu) / sigma)')}) * n, 1) AS e FROM be JOIN fs ON fs.post = be.post LEFT JOIN bn ON bn.post = be.post AND bn.b = be.b),
 ch AS (SELECT post, bins, sum((seen - e) * (seen - e) / e) AS chi2 FROM bx GROUP BY 1, 2)"""


@register("f23_goodness_of_fit_normal", ANN + ", " + GOF + f" SELECT post, {B('n', 'bins')}, {R('ks', 'ad', 'chi2', '1 - ' + sqltext.gammainc('((bins - 3) / 2.0)', '(chi2 / 2)') + ' AS chi2_p')} FROM gs JOIN ch USING (post)")
def _(s, d):
    return fits.goodness_of_fit(view(s, d, "annual"), "normal").drop("ks_p")


@register("f23_goodness_of_fit_gamma")
def _(s, d):
    return fits.goodness_of_fit(view(s, d, "annual"), "gamma")


@register("f23_goodness_of_fit_lognormal_daily")
def _(s, d):
    return fits.goodness_of_fit(view(s, d, "daily"), "lognormal")


def gof_sql(prelude: str, cdf) -> str:
    """KS, AD and chi-square of the annual series against ``cdf(x)`` with parameters in ``fs``."""
    return ANN + f""", {prelude}, rk AS (SELECT post, value, row_number() OVER (PARTITION BY post ORDER BY value) AS i, count(*) OVER (PARTITION BY post) AS n FROM annual),
 rf AS (SELECT rk.*, {cdf('value')} AS F FROM rk JOIN fs USING (post)),
 gs AS (SELECT post, n, max(greatest(i / n - F, F - (i - 1) / n)) AS ks, -n - sum((2 * i - 1) * ln(greatest(F, 1e-300)) + (2 * n + 1 - 2 * i) * ln(greatest(1 - F, 1e-300))) / n AS ad FROM rf GROUP BY post, n),
 en AS (SELECT post, min(value) AS lo, max(value) AS hi, count(*) AS cnt, CAST(greatest(5, floor(sqrt(count(*)))) AS BIGINT) AS bins FROM annual GROUP BY post),
 bn AS (SELECT post, least(floor((value - lo) / ((hi - lo) / bins)), bins - 1) AS b, count(*) AS seen FROM annual JOIN en USING (post) GROUP BY 1, 2),
 be AS (SELECT post, bins, cnt, bb AS b, lo + bb * ((hi - lo) / bins) AS x0, CASE WHEN bb = bins - 1 THEN hi ELSE lo + (bb + 1) * ((hi - lo) / bins) END AS x1 FROM (SELECT *, unnest(range(0, bins)) AS bb FROM en)),
 bx AS (SELECT be.post, bins, coalesce(seen, 0) AS seen, greatest(({cdf('x1')} - {cdf('x0')}) * cnt, 1) AS e FROM be JOIN fs ON fs.post = be.post LEFT JOIN bn ON bn.post = be.post AND bn.b = be.b),
 ch AS (SELECT post, bins, sum((seen - e) * (seen - e) / e) AS chi2 FROM bx GROUP BY 1, 2)
 SELECT post, {B('n', 'bins')}, {R('ks', 'ad', 'chi2')} FROM gs JOIN ch USING (post)"""


SKEW = """fs AS (SELECT post, avg(value) AS mean, stddev_samp(value) AS std, skewness(value) AS cs FROM annual GROUP BY post)"""
_P3X = "(sign(cs) * ({x} - mean) / std * 2 / abs(cs) + 4 / (cs * cs))"


def p3_cdf(x: str) -> str:
    y = _P3X.format(x=x)
    low = f"(CASE WHEN {y} > 0 THEN {sqltext.gammainc('(4 / (cs * cs))', f'greatest({y}, 1e-12)')} ELSE 0 END)"
    return f"(CASE WHEN cs > 0 THEN {low} ELSE 1 - {low} END)"


LMOM = """lr AS (SELECT post, value, row_number() OVER (PARTITION BY post ORDER BY value) / (count(*) OVER (PARTITION BY post) + 1) AS w FROM annual),
 lb AS (SELECT post, avg(value) AS b0, avg(w * value) AS b1, avg(w * w * value) AS b2 FROM lr GROUP BY post),
 lk AS (SELECT post, b0, 2 * b1 - b0 AS l2, 2 / (3 + (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0)) - ln(2) / ln(3) AS c FROM lb),
 lg AS (SELECT post, b0, l2, 7.859 * c + 2.9554 * c * c AS k FROM lk),
 la AS (SELECT *, l2 * k / ((1 - pow(2.0, -k)) * gamma(1 + k)) AS alpha FROM lg),
 fs AS (SELECT post, k, alpha, b0 - alpha * (1 - gamma(1 + k)) / k AS xi0 FROM la)"""


def gev_cdf(x: str) -> str:
    t = f"(1 - k * ({x} - xi0) / alpha)"
    return f"(CASE WHEN {t} > 0 THEN exp(-pow(greatest({t}, 1e-300), 1 / k)) WHEN k > 0 THEN 1.0 ELSE 0.0 END)"


@register("f23_goodness_of_fit_pearson3", gof_sql(SKEW, p3_cdf))
def _(s, d):
    return fits.goodness_of_fit(view(s, d, "annual")).drop("ks_p", "chi2_p")


@register("f23_goodness_of_fit_gev", gof_sql(LMOM, gev_cdf))
def _(s, d):
    return fits.goodness_of_fit(view(s, d, "annual"), "gev").drop("ks_p", "chi2_p")


@register("f24_qq_points_gev", ANN + f""", {LMOM}, rk AS (SELECT post, value, row_number() OVER (PARTITION BY post ORDER BY value) AS i, count(*) OVER (PARTITION BY post) AS n FROM annual)
 SELECT post, {B('i')}, {R('value AS empirical', 'xi0 + alpha / k * (1 - pow(-ln(i / (n + 1)), k)) AS theoretical')} FROM rk JOIN fs USING (post)""")
def _(s, d):
    return fits.qq_points(view(s, d, "annual"), "gev")


@register("f24_pp_points_pearson3", ANN + f""", {SKEW}, rk AS (SELECT post, value, row_number() OVER (PARTITION BY post ORDER BY value) AS i, count(*) OVER (PARTITION BY post) AS n FROM annual)
 SELECT post, {B('i')}, {R('i / (n + 1) AS p_empirical', p3_cdf('value') + ' AS p_theoretical')} FROM rk JOIN fs USING (post)""")
def _(s, d):
    return fits.pp_points(view(s, d, "annual"), "pearson3")


RATIO = ANN + ", " + RANK.format(v="annual") + """, mm AS (SELECT post, avg(value) AS mean, stddev_samp(value) / avg(value) AS cv FROM annual GROUP BY post HAVING count(*) >= 5),
 rr AS (SELECT rk.post, value, (m - 0.3) / (n + 0.4) AS p, mean, cv, -2 + j * 0.5 AS ratio, (-2 + j * 0.5) * cv AS cs FROM rk JOIN mm USING (post), (SELECT unnest(range(0, 17)) AS j))"""
_SCORES = f"SELECT post, {R('ratio', 'sum((value - q) * (value - q)) AS ss', 'any_value(mean) AS mean', 'any_value(cv) AS cv', digits=4)}, {B('count(*) AS points')} FROM sc GROUP BY post, ratio"


@register("f08_ratio_scores", RATIO + f""", pq AS (SELECT p, cs FROM rr WHERE abs(cs) >= 1e-6), {sqltext.pearson3('pq')}, nq AS (SELECT DISTINCT 1 - p AS q FROM rr WHERE abs(cs) < 1e-6), {sqltext.normal_ppf('nq')},
 sc AS (SELECT rr.*, CASE WHEN abs(rr.cs) < 1e-6 THEN mean + mean * cv * nz.z ELSE greatest(mean + mean * greatest(abs(cv), 0.001) * p3z.z, 0) END AS q
   FROM rr LEFT JOIN p3z ON rr.p = p3z.p AND rr.cs = p3z.cs LEFT JOIN nz ON nz.q = 1 - rr.p AND abs(rr.cs) < 1e-6) {_SCORES}""", digits=4)
def _(s, d):
    return freq.ratio_scores(view(s, d, "annual"), step=0.5)


# the grid keeps off zero: near it the curve is a normal law in all but name, and SQL's series grow long
_OFF = RATIO.replace("-2 + j * 0.5", "-1.75 + j * 0.5").replace("range(0, 17)", "range(0, 16)")
_KMR = "greatest(mean + 2 * mean * cv * (1 / cs - 1 / cs0) + mean * cv * z, 0)"


@register("f08_ratio_scores_kritsky_menkel", _OFF + f""", {km_params('rr')}, pq AS (SELECT p, cs FROM kp), {sqltext.pearson3('pq')},
 kz AS (SELECT kp.*, z FROM kp JOIN p3z ON kp.p = p3z.p AND kp.cs = p3z.cs), sc AS (SELECT *, {_KMR} AS q FROM kz)
 SELECT post, {R('ratio', 'sqrt(sum((value - q) * (value - q)) / count(*)) / any_value(mean) AS error')}, {B('count(*) AS points')} FROM sc GROUP BY post, ratio""")
def _(s, d):
    found = freq.ratio_scores(view(s, d, "annual"), lo=-1.75, hi=5.75, step=0.5, curve="kritsky_menkel")
    return found.select("post", "ratio", "points", (F.sqrt(F.col("ss") / F.col("points")) / F.col("mean")).alias("error"))


RKI = "rk AS (SELECT post, value, row_number() OVER (PARTITION BY post ORDER BY value) AS i FROM annual)"


@register("f24_qq_points", ANN + ", " + LNF.format(v="annual") + f""", {RKI}, pq AS (SELECT post, value, i, mu, sigma, i / (n + 1) AS q FROM rk JOIN fs USING (post)), {sqltext.normal_ppf('pq')}
 SELECT post, {B('i')}, {R('value AS empirical', 'mu + sigma * z AS theoretical')} FROM pq JOIN nz USING (q)""")
def _(s, d):
    return fits.qq_points(view(s, d, "annual"))


@register("f24_pp_points", ANN + ", " + LNF.format(v="annual") + f""", {RKI} SELECT post, {B('i')}, {R('i / (n + 1) AS p_empirical', sqltext.normal_cdf('((value - mu) / sigma)') + ' AS p_theoretical')} FROM rk JOIN fs USING (post)""")
def _(s, d):
    return fits.pp_points(view(s, d, "annual"))


@register("f24_qq_points_gamma")
def _(s, d):
    return fits.qq_points(view(s, d, "annual"), "gamma")


def _lmom(w):
    return ANN + f""", rk AS (SELECT post, value, row_number() OVER (PARTITION BY post ORDER BY value) / (count(*) OVER (PARTITION BY post) + 1) AS w FROM annual),
 b AS (SELECT post, count(*) AS n, avg(value) AS b0, avg({w} * value) AS b1, avg({w} * {w} * value) AS b2 FROM rk GROUP BY post),
 l AS (SELECT post, n, b0, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM b)
 SELECT post, {B('n')}, {R('b0 AS mean', 'l2 / b0 AS cv', 'l3 / l2 / (l2 / b0) AS cs', 'b0 AS lambda1', 'l2 AS lambda2', 'l3 AS lambda3', 'l3 / l2 AS tau3')} FROM l"""


@register("f25_l_moments", _lmom("(1 - w)"))
def _(s, d):
    return freq.l_moments(view(s, d, "annual"), as_reference=True)


@register("f25_l_moments_ascending", _lmom("w"))
def _(s, d):
    return freq.l_moments(view(s, d, "annual"))


@register("f26_curve_variants", digits=5)
def _(s, d):
    return freq.curve_variants(view(s, d, "annual"))
