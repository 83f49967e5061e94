"""Registered queries: water balance, snow, catchments, structures, ice, channels, storage."""

from pyspark.sql import functions as F

from hydrosheaf.functions import fixed
from hydrosheaf.operators import channel, tables
from hydrosheaf.plans import sqltext
from hydrosheaf.plans.catalog import B, R, register
from hydrosheaf.plans.views import table, view, with_views

FOR = with_views("forcing")


def case(key, values, default=None):
    items = values.items() if isinstance(values, dict) else enumerate(values, 1)
    q = lambda k: f"'{k}'" if isinstance(k, str) else k
    body = " ".join(f"WHEN {q(k)} THEN CAST({v} AS DOUBLE)" for k, v in items)
    return f"CASE {key} {body}" + (f" ELSE CAST({default} AS DOUBLE)" if default is not None else "") + " END"


# --- water balance ------------------------------------------------------------------------------
@register("w01_water_balance", FOR + f""", w AS (SELECT post, t, p / 10 AS p, pet AS e, runoff AS r FROM forcing), x AS (SELECT *, p - e - r AS residual FROM w)
 SELECT post, {B('t')}, {R('p', 'e', 'r', 'residual', 'abs(residual) / p * 100 AS residual_percent')}, abs(residual) / p * 100 <= 5 AS balanced FROM x""")
def _(s, d):
    f = view(s, d, "forcing").select("post", "t", (F.col("p") / 10).alias("p"), F.col("pet").alias("e"), F.col("runoff").alias("r"))
    return tables.water_balance(f)


@register("w02_runoff_coefficient", FOR + f""", m AS (SELECT post, avg(p) AS mean_p, avg(runoff) AS mean_r FROM forcing GROUP BY 1)
 SELECT post, {R('mean_p', 'mean_r', 'mean_r / mean_p AS coefficient')}, mean_r / mean_p BETWEEN 0 AND 1 AS valid FROM m""")
def _(s, d):
    return tables.runoff_coefficients(view(s, d, "forcing").select("post", "p", F.col("runoff").alias("r")))


# station days: one row per order, all months of the year; temperature, wind and humidity from its columns
STATION = """sd AS (SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS day, o_custkey % 400 / 10.0 AS tw, o_orderkey % 350 / 10.0 - 5 AS ta, o_custkey % 7 AS wind, o_orderkey % 100 / 100.0 AS humidity, month(o_orderdate) AS mon FROM orders)"""


@register("w03_evaporation", f"WITH {STATION}, ev AS (SELECT station, day, greatest(0.21 * (6.11 * pow(10, 7.5 * tw / (237.3 + tw)) - 6.11 * pow(10, 7.5 * ta / (237.3 + ta))) * (1 + 0.54 * wind), 0) AS e1, greatest(0.0018 * (25 + ta) * (25 + ta) * (1 - humidity) * (1 + 0.72 * wind) * CASE WHEN mon = 2 THEN 28 WHEN mon IN (4, 6, 9, 11) THEN 30 ELSE 31 END, 0) AS e2 FROM sd) "
          + f"SELECT station, strftime(day, '%Y-%m-%d') AS day, {B('count(*) AS n')}, {R('avg(e1) AS dalton', 'avg(e2) AS monthly', 'avg(e1) * 0.68 AS lake', digits=4)} FROM ev GROUP BY 1, 2", digits=4)
def _(s, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    e = table(s, d, "orders").select(
        F.col("o_orderpriority").alias("station"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.month("o_orderdate").alias("mon"),
        (c % 400 / 10.0).alias("tw"), (o % 350 / 10.0 - 5).alias("ta"), (c % 7).alias("wind"), (o % 100 / 100.0).alias("humidity"))
    e = e.withColumn("e1", tables.evaporation_dalton(F.col("tw"), F.col("ta"), F.col("wind"))).withColumn(
        "e2", tables.evaporation_monthly(F.col("ta"), F.col("humidity"), F.col("wind"), F.col("mon")))
    return e.groupBy("station", "day").agg(F.count(F.lit(1)).alias("n"), F.avg("e1").alias("dalton"), F.avg("e2").alias("monthly"), tables.pan_to_lake(F.avg("e1")).alias("lake"))


@register("w04_infiltration", f"""WITH x AS (SELECT l_orderkey AS storm, l_quantity AS rain, 10 + l_tax * 400 AS k, l_discount * 10 AS m FROM lineitem), y AS (SELECT *, k * (1 - 0.8 * m) AS ke FROM x), z AS (SELECT *, greatest(ke, 0) AS k_eff FROM y)
 SELECT storm, {B('count(*) AS hours')}, {R('sum(least(rain, k_eff)) AS infiltration', 'sum(greatest(rain - k_eff, 0)) AS surface', 'avg(CASE WHEN rain > 0 THEN least(rain, k_eff) / rain ELSE 0 END) AS ratio')} FROM z GROUP BY storm""")
def _(s, d):
    x = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("storm"), F.col("l_quantity").alias("rain"), (10 + F.col("l_tax") * 400).alias("k"), (F.col("l_discount") * 10).alias("moisture"))
    return tables.infiltration(x).groupBy("storm").agg(F.count(F.lit(1)).alias("hours"), F.sum("infiltration").alias("infiltration"), F.sum("surface").alias("surface"), F.avg("ratio").alias("ratio"))


SITES = """si AS (SELECT p_partkey AS site, p_size % 9 + 1 AS zone, p_retailprice / 40 - 20 AS t, p_size * 3.0 AS height, p_retailprice / 10 AS area_km2, p_brand AS basin, p_type FROM part)"""


def sites(s, d):
    p = F.col("p_retailprice")
    return table(s, d, "part").select(
        F.col("p_partkey").alias("site"), (F.col("p_size") % 9 + 1).alias("zone"), (p / 40 - 20).alias("t"), (F.col("p_size") * 3.0).alias("height"),
        (p / 10).alias("area_km2"), F.col("p_brand").alias("basin"), "p_type")


@register("w05_melt_and_snow_water", f"WITH {SITES} SELECT site, {R(case('zone', [a for a, _ in fixed.MELT_ZONE]) + ' * greatest(t, 0) AS melt', 'height * (' + case('zone', [b for _, b in fixed.MELT_ZONE]) + ') / 1000 AS swe')} FROM si")
def _(s, d):
    z = F.col("zone")
    return sites(s, d).select("site", tables.melt_rate(z, F.col("t")).alias("melt"), tables.snow_water(F.col("height"), tables.pick(z, [b for _, b in fixed.MELT_ZONE])).alias("swe"))


# daily temperature from the daily series; the store is 40 times its mean
SNOW = with_views("daily") + """, tp AS (SELECT post, t, value / 10 - 8 AS value, row_number() OVER (PARTITION BY post ORDER BY t) AS i FROM daily),
 w0 AS (SELECT post, avg(value) * 40 AS w0, max(value) AS area_km2 FROM daily GROUP BY 1),
 pt AS (SELECT tp.post, t, i, w0, area_km2, {a} * greatest(value, 0) AS pot, sum({a} * greatest(value, 0)) OVER (PARTITION BY tp.post ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM tp JOIN w0 ON w0.post = tp.post),
 ml AS (SELECT *, greatest(w0 - c, 0) AS remaining, greatest(w0 - (c - pot), 0) - greatest(w0 - c, 0) AS melt FROM pt)"""


def snow(s, d, **kw):
    v = view(s, d, "daily")
    st = v.groupBy("post").agg((F.avg("value") * 40).alias("w0"), F.max("value").alias("area_km2"))
    t = v.withColumn("value", F.col("value") / 10 - 8)
    return tables.snowmelt(t, st.select("post", "w0"), **kw), st.select("post", "area_km2")


@register("w06_snowmelt", SNOW.format(a="3.5 * 0.85") + f" SELECT post, {B('t', 'i')}, {R('w0', 'melt', 'remaining')} FROM ml")
def _(s, d):
    return snow(s, d)[0]


@register("w06_snow_free_day", SNOW.format(a="3.5 * 0.85") + f" SELECT post, {R('sum(melt) AS total_melt', 'min(remaining) AS w_final')}, {B('coalesce(min(CASE WHEN remaining <= 0 THEN i - 1 END), count(*)) AS snow_free_day')} FROM ml GROUP BY post")
def _(s, d):
    return tables.snow_free(snow(s, d)[0])


@register("w06_melt_hydrograph", SNOW.format(a="3.5") + f" SELECT post, {B('t')}, {R('melt', 'remaining', 'melt * area_km2 * 0.7 / (3.6 * 24) AS q')} FROM ml")
def _(s, d):
    m, area = snow(s, d, net=1.0)
    return tables.melt_hydrograph(m, area)


@register("w07_seasonal_snow", f"""WITH x AS (SELECT o_orderkey AS season, o_totalprice / 2000 AS w0, o_custkey % 90 / 1.0 AS p, o_orderkey % 17 / 4.0 - 1 AS t, o_custkey % 500 + 1.0 AS area_km2 FROM orders), y AS (SELECT *, least(3.5 * greatest(t, 0) * 30, w0) AS melt FROM x)
 SELECT season, {R('melt', 'greatest(melt - 0.3 * p, 0) AS runoff', 'greatest(w0 - melt + p, 0) AS w_final', '(CASE WHEN 3.5 * t * 10 > w0 THEN w0 / 10 ELSE 3.5 * t END) * area_km2 * 0.7 / (3.6 * 24) AS q_peak')} FROM y""")
def _(s, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    x = table(s, d, "orders").select(k.alias("season"), (F.col("o_totalprice") / 2000).alias("w0"), (c % 90 / 1.0).alias("p"), (k % 17 / 4.0 - 1).alias("t"), (c % 500 + 1.0).alias("area_km2"))
    return tables.seasonal_snow(x).select("season", "melt", "runoff", "w_final", "q_peak")


UNIT = (0.1, 0.35, 0.3, 0.15, 0.1)


@register("w08_hydrograph_convolution", with_views("hourly") + ", uh(k, u) AS (VALUES " + ", ".join(f"({k}, {u})" for k, u in enumerate(UNIT)) + f") SELECT post AS event, {B('t + k AS t')}, {R('sum(value * u) AS q')} FROM hourly, uh GROUP BY 1, 2")
def _(s, d):
    rain = view(s, d, "hourly").select(F.col("post").alias("event"), "t", F.col("value").alias("r"))
    shape = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(x)).alias("u")) for k, x in enumerate(UNIT)]))
    unit = rain.select("event").distinct().select("event", shape.alias("x")).select("event", "x.k", "x.u")
    return tables.hydrograph_convolution(rain, unit)


@register("w09_flood_volume", with_views("hourly") + f""", n AS (SELECT post, value, lead(value) OVER (PARTITION BY post ORDER BY t) AS nv FROM hourly)
 SELECT post, {R('sum((value + nv) / 2 * 3600) AS volume_m3', 'sum((value + nv) / 2 * 3600) / 1e9 AS volume_km3')} FROM n GROUP BY post""", digits=6)
def _(s, d):
    return tables.flood_volume(view(s, d, "hourly"))


# --- catchments ---------------------------------------------------------------------------------
def idf_sql(t, T, zone="zone"):
    c = lambda j: case(zone, [z[j] for z in fixed.IDF_ZONE])
    return f"(({c(0)}) * pow(greatest({T}, 1.0), {c(3)}) / pow(greatest({t}, 0.1) + ({c(1)}), {c(2)}))"


@register("l01_idf_curve", f"WITH {SITES} SELECT site, {R('d AS duration', 'rp AS period', idf_sql('d', 'rp') + ' * 60 AS intensity', idf_sql('d', 'rp') + ' * d AS depth')} FROM si, (VALUES "
          + ", ".join(f"({float(x)})" for x in fixed.IDF_DURATIONS) + ") v(d), (VALUES (2.0), (10.0), (100.0)) w(rp)")
def _(s, d):
    return tables.idf_curve(sites(s, d).select("site", "zone")).drop("zone")


SUB = SITES + """, su AS (SELECT *, height / 40 + 0.5 AS length_km, 0.001 + p.site % 13 / 1000.0 AS slope, CASE p_type WHEN 'ECONOMY' THEN 0.25 WHEN 'SMALL' THEN 0.5 WHEN 'PROMO' THEN 0.7 WHEN 'MEDIUM' THEN 0.9 WHEN 'LARGE' THEN 0.1 ELSE 0.75 END AS alpha FROM si p),
 tc AS (SELECT *, 0.0195 * pow(length_km, 0.77) * pow(slope, -0.385) AS tc FROM su)"""
SURFACE = {"ECONOMY": "park", "SMALL": "residential", "PROMO": "dense_urban", "MEDIUM": "asphalt", "LARGE": "marsh", "STANDARD": "rock"}


def subcatchments(s, d):
    alpha = tables.pick(F.col("p_type"), {k: fixed.SURFACE_ALPHA[v] for k, v in SURFACE.items()})
    return sites(s, d).withColumn("length_km", F.col("height") / 40 + 0.5).withColumn("slope", 0.001 + F.col("site") % 13 / 1000.0).withColumn("alpha", alpha)


@register("l02_rational_method", f"WITH {SUB} SELECT site, {R('tc', idf_sql('tc', '10.0') + ' * 60 * area_km2 * alpha / 3.6 AS q', case('zone', fixed.RATIONAL_F_MAX) + ' AS f_max')}, area_km2 <= {case('zone', fixed.RATIONAL_F_MAX)} AND tc >= 5 AS valid FROM tc")
def _(s, d):
    return tables.rational_method(subcatchments(s, d)).select("site", "tc", "q", F.col("f_max").cast("double").alias("f_max"), "valid")


@register("l02_rational_basin", f"WITH {SUB} SELECT basin, {B('count(*) AS n')}, {R('sum(' + idf_sql('tc', '10.0') + ' * 60 * area_km2 * alpha / 3.6) AS q')} FROM tc GROUP BY basin")
def _(s, d):
    return tables.rational_method(subcatchments(s, d)).groupBy("basin").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


@register("l03_runoff_coefficient_tables", f"WITH {SUB} SELECT basin, {R('sum(area_km2 * alpha) / sum(area_km2) AS alpha', 'avg(' + case('zone', fixed.ZONE_ALPHA) + ') AS zone_alpha')} FROM su GROUP BY basin")
def _(s, d):
    x = subcatchments(s, d)
    return x.groupBy("basin").agg((F.sum(F.col("area_km2") * F.col("alpha")) / F.sum("area_km2")).alias("alpha"), F.avg(tables.pick(F.col("zone"), fixed.ZONE_ALPHA)).alias("zone_alpha"))


REGNAMES = tuple(fixed.REGION) + ("unknown",)
CATCH = "ca AS (SELECT c_custkey AS site, abs(c_acctbal) + 1 AS area_km2, (" + str(list(REGNAMES)) + ")[c_nationkey % 10 + 1] AS region FROM customer)"


def regq(j):
    return case("region", {k: v[j] for k, v in fixed.REGION.items()}, fixed.REGION["central_russia"][j])


@register("l04_regional_regression", f"WITH {CATCH}, q AS (SELECT *, ({regq(0)}) * pow(area_km2, {regq(1)}) AS qm, ({regq(2)}) * pow(area_km2, {regq(3)}) AS q2, ({regq(4)}) * pow(area_km2, {regq(5)}) AS q10, ({regq(6)}) * pow(area_km2, {regq(7)}) AS q100 FROM ca) "
          + f"SELECT site, region, {R('qm AS q_mean', 'qm * 1000 / area_km2 AS module', 'qm * 31.536 AS volume', '(' + regq(8) + ') * pow(area_km2, ' + regq(9) + ') AS q_min_winter', 'q2 AS peak_2', 'q2 * pow(q10 / q2, 3.0 / 8) AS peak_5', 'q10 * pow(q100 / q10, 40.0 / 90) AS peak_50', 'q100 AS peak_200')} FROM q")
def _(s, d):
    names = F.array(*[F.lit(r) for r in REGNAMES])
    c = table(s, d, "customer").select(F.col("c_custkey").alias("site"), (F.abs("c_acctbal") + 1).alias("area_km2"), F.element_at(names, (F.col("c_nationkey") % 10 + 1).cast("int")).alias("region"))
    r = tables.regional_runoff(c)
    for p in (2, 5, 50, 200):
        r = r.withColumn(f"peak_{p}", tables.regional_peak(r, F.lit(float(p))))
    return r.drop("area_km2")


STRUCT = """ss AS (SELECT s_suppkey AS structure, s_nationkey, greatest(s_acctbal, 0) / 2000 AS head, 5 + s_suppkey % 20 AS crest, ['sharp_crested', 'broad_crested', 'ogee', 'other'][s_nationkey % 4 + 1] AS weir, CASE WHEN s_suppkey % 3 = 0 THEN 4.0 ELSE 0.0 END AS gate_area FROM supplier),
 dq AS (SELECT c_nationkey, avg(c_acctbal) / 40 AS q_design FROM customer GROUP BY 1),
 cp AS (SELECT ss.*, q_design, CASE WHEN gate_area > 0 THEN CASE WHEN head > 0 THEN 0.62 * gate_area * sqrt(2 * 9.81 * head) ELSE 0 END WHEN head > 0 THEN (CASE weir WHEN 'sharp_crested' THEN 1.84 WHEN 'broad_crested' THEN 1.5 WHEN 'ogee' THEN 2.2 ELSE 1.84 END) * crest * pow(head, 1.5) ELSE 0 END AS capacity FROM ss JOIN dq ON c_nationkey = s_nationkey)"""


@register("l05_spillway_check", f"WITH {STRUCT} SELECT structure, weir, {R('head', 'q_design', 'capacity', 'CASE WHEN q_design > 0 THEN (capacity - q_design) / q_design * 100 ELSE 0 END AS margin')}, capacity >= q_design AS sufficient FROM cp")
def _(s, d):
    k = F.col("s_suppkey")
    weirs = F.array(*[F.lit(x) for x in ("sharp_crested", "broad_crested", "ogee", "other")])
    st = table(s, d, "supplier").select(
        k.alias("structure"), "s_nationkey", (F.greatest("s_acctbal", F.lit(0.0)) / 2000).alias("head"), (5 + k % 20).alias("crest"),
        F.element_at(weirs, (F.col("s_nationkey") % 4 + 1).cast("int")).alias("weir"), F.when(k % 3 == 0, 4.0).otherwise(0.0).alias("gate_area"))
    dq = table(s, d, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 40).alias("q_design"))
    return tables.spillway_check(st.join(dq, F.col("c_nationkey") == F.col("s_nationkey"))).select("structure", "weir", "head", "q_design", "capacity", "margin", "sufficient")


RES = """rs AS (SELECT s_suppkey AS reservoir, abs(s_acctbal) / 3000 AS volume_km3, abs(s_acctbal) / 50 + 1 AS q_mean, s_suppkey % 700 AS runoff_mm, s_nationkey * 40.0 AS area_km2, ['weak', 'moderate', 'strong', 'rocky'][s_nationkey % 4 + 1] AS soil FROM supplier),
 rg AS (SELECT *, (CASE soil WHEN 'weak' THEN 0.05 WHEN 'moderate' THEN 0.15 WHEN 'strong' THEN 0.4 ELSE 0.15 END) * runoff_mm * area_km2 / 1000 AS g FROM rs)"""


@register("l06_reservoir_sediment", f"WITH {RES} SELECT reservoir, soil, {R('CASE WHEN volume_km3 <= 0 THEN 0 ELSE least(greatest(1 - 0.057 * pow(volume_km3, 0.58) / pow(q_mean, 0.14), 0), 1) END AS trap', 'g AS sediment', 'CASE WHEN g > 0 THEN volume_km3 * 1e9 / (g * 1e6 / 1.3) END AS lifetime')}, coalesce(CASE WHEN g > 0 THEN volume_km3 * 1e9 / (g * 1e6 / 1.3) > 100 END, true) AS long_lived FROM rg")
def _(s, d):
    b, k, nk = F.abs("s_acctbal"), F.col("s_suppkey"), F.col("s_nationkey")
    soils = F.array(*[F.lit(x) for x in ("weak", "moderate", "strong", "rocky")])
    r = table(s, d, "supplier").select(
        k.alias("reservoir"), (b / 3000).alias("volume_km3"), (b / 50 + 1).alias("q_mean"), (k % 700).alias("runoff_mm"), (nk * 40.0).alias("area_km2"), F.element_at(soils, (nk % 4 + 1).cast("int")).alias("soil"))
    return tables.reservoir_sediment(r).select("reservoir", "soil", "trap", "sediment", "lifetime", "long_lived")


ZN = tuple(fixed.ICE_ZONE)
ICE = "ic AS (SELECT p_partkey AS site, (" + str(list(ZN)) + ")[p_size % 6 + 1] AS ice_zone, -p_retailprice / 60 AS t_january, 50 + p_size * 0.4 AS latitude, p_size * 7.0 AS width, p_size / 25.0 AS velocity, p_retailprice / 100 AS h_normal, p_size / 60.0 AS snow, p_size / 10.0 AS depth FROM part)"


def ice_sites(s, d):
    z, p = F.col("p_size"), F.col("p_retailprice")
    return table(s, d, "part").select(
        F.col("p_partkey").alias("site"), F.element_at(F.array(*[F.lit(x) for x in ZN]), (z % 6 + 1).cast("int")).alias("ice_zone"), (-p / 60).alias("t_january"),
        (50 + z * 0.4).alias("latitude"), (z * 7.0).alias("width"), (z / 25.0).alias("velocity"), (p / 100).alias("h_normal"), (z / 60.0).alias("snow"), (z / 10.0).alias("depth"))


def icecol(j):
    return case("ice_zone", {k: v[j] for k, v in fixed.ICE_ZONE.items()})


THICK = f"th AS (SELECT *, (0.6 * ({icecol(8)}) * sqrt(abs(t_january)) + 0.4 * (({icecol(0)}) + ({icecol(1)})) / 2) * (1 + 0.005 * greatest(latitude - 55, 0)) AS thickness FROM ic)"


@register("l07_ice_thickness", f"""WITH {ICE}, {THICK} SELECT site, ice_zone, {R('thickness', '0.8 * thickness AS thickness_low', '1.2 * thickness AS thickness_high',
   'least((CASE WHEN snow <= 0.05 THEN 0.6 WHEN snow <= 0.15 THEN 0.7 WHEN snow <= 0.3 THEN 0.8 WHEN snow <= 0.5 THEN 0.9 ELSE 1.0 END) * sqrt(-t_january / (1 + 0.04 * velocity * velocity)), 0.95 * depth) AS by_frost', icecol(6) + ' AS coefficient')} FROM th""")
def _(s, d):
    t = tables.ice_thickness(ice_sites(s, d))
    return t.select("site", "ice_zone", "thickness", "thickness_low", "thickness_high",
                    tables.ice_thickness_by_frost(-F.col("t_january"), F.col("depth"), F.col("velocity"), F.col("snow")).alias("by_frost"),
                    tables.pick(F.col("ice_zone"), {k: v[6] for k, v in fixed.ICE_ZONE.items()}).alias("coefficient"))


@register("l08_ice_jam", f"""WITH {ICE}, {THICK}, jm AS (SELECT *, T, (CASE WHEN width < 50 THEN 2.8 WHEN width < 100 THEN 2.2 WHEN width < 200 THEN 1.7 ELSE 1.2 END) * sqrt(thickness / width) * pow(greatest(velocity / 0.5, 0.1), 0.3) * (CASE WHEN width > 150 THEN 0.85 ELSE 1.0 END) AS rise FROM th, (VALUES (10.0), (100.0)) v(T))
 SELECT site, {R('T AS period', 'rise', sqltext.lerp('width', fixed.JAM_PROBABILITY) + ' AS jam_probability', sqltext.lerp('T', fixed.JAM_KP) + ' AS k_p', 'h_normal + rise * (' + sqltext.lerp('T', fixed.JAM_KP) + ') AS level')},
 CASE WHEN rise > 2 THEN 'dangerous' WHEN rise > 1 THEN 'significant' WHEN rise > 0.5 THEN 'moderate' ELSE 'minor' END AS severity FROM jm""")
def _(s, d):
    t = tables.ice_thickness(ice_sites(s, d)).withColumn("period", F.explode(F.array(F.lit(10.0), F.lit(100.0))))
    return tables.ice_jam(t, F.col("period")).select("site", "period", "rise", "jam_probability", "k_p", "level", "severity")


@register("l09_design_hydrograph_times", f"WITH {SITES} SELECT site, {R('0.3 * pow(area_km2, 0.3) * (CASE WHEN zone IN (5, 6) THEN 0.7 ELSE 1.0 END) * (CASE WHEN area_km2 > 500 THEN 1.3 ELSE 1.0 END) AS t_peak', '2.5 * 0.3 * pow(area_km2, 0.3) * (CASE WHEN zone IN (5, 6) THEN 0.8 ELSE 1.0 END) * (CASE WHEN area_km2 > 500 THEN 1.2 ELSE 1.0 END) AS t_base')} FROM si")
def _(s, d):
    return tables.design_hydrograph_times(sites(s, d)).select("site", "t_peak", "t_base")


# --- ice dates: days of the dearest and the cheapest order of a nation's year --------------------
DATES = """da AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS post, CAST(year(o_orderdate) AS BIGINT) AS year,
  CAST(dayofyear(arg_max(o_orderdate, struct_pack(o_totalprice, o_orderkey))) AS BIGINT) AS freeze_up, CAST(dayofyear(arg_min(o_orderdate, struct_pack(o_totalprice, o_orderkey))) AS BIGINT) AS breakup FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
DUR = "CASE WHEN freeze_up <= breakup THEN breakup - freeze_up ELSE 366 - freeze_up + breakup END"


def ice_dates(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.struct("o_totalprice", "o_orderkey")
    return o.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("post"), F.year("o_orderdate").cast("bigint").alias("year")).agg(
        F.dayofyear(F.max_by("o_orderdate", k)).cast("bigint").alias("freeze_up"), F.dayofyear(F.min_by("o_orderdate", k)).cast("bigint").alias("breakup"))


def _ice(c):
    s = f"coalesce(stddev_samp({c}), 0)"
    return R(f"avg({c}) AS {c}_mean", f"{s} AS {c}_std", f"greatest(1, avg({c}) - {s}) AS {c}_early", f"least(366, avg({c}) + {s}) AS {c}_late") + ", " + B(f"min({c}) AS {c}_min", f"max({c}) AS {c}_max")


@register("c01_ice_cover_stats", f"WITH {DATES} SELECT post, {B('count(*) AS years')}, {_ice('freeze_up')}, {_ice('breakup')}, {R(f'avg({DUR}) AS duration_mean', f'coalesce(stddev_samp({DUR}), 0) AS duration_std')}, {B(f'min({DUR}) AS duration_min', f'max({DUR}) AS duration_max')} FROM da GROUP BY post")
def _(s, d):
    return tables.ice_cover_stats(ice_dates(s, d))


@register("c02_ice_duration", f"WITH {DATES} SELECT post, year, freeze_up, breakup, {B(DUR + ' AS duration')} FROM da")
def _(s, d):
    return ice_dates(s, d).withColumn("duration", tables.ice_duration(F.col("freeze_up"), F.col("breakup")))


def _dates(c):
    return f"""WITH {DATES}, mm AS (SELECT post, count(*) AS n, avg({c}) AS mean, coalesce(stddev_samp({c}), 0) AS std, min({c}) AS mn, max({c}) AS mx, quantile_cont({c}, 0.05) AS p5, quantile_cont({c}, 0.95) AS p95 FROM da GROUP BY 1),
 bn AS (SELECT post, round_even({c} / 10.0, 0) * 10 AS bin, count(*) AS c FROM da GROUP BY 1, 2), mo AS (SELECT post, bin, row_number() OVER (PARTITION BY post ORDER BY c DESC, bin) AS k FROM bn)
 SELECT mm.post, {B('n')}, {R('mean', 'std', 'greatest(1, mean - std) AS early', 'least(366, mean + std) AS late', 'mn AS min', 'mx AS max', 'mx - mn AS range', 'CASE WHEN n >= 5 THEN bin ELSE mean END AS mode', 'p5', 'p95')},
  CASE WHEN mean < 90 THEN 'early' WHEN mean > 120 THEN 'late' ELSE 'middle' END AS timing FROM mm JOIN mo ON mo.post = mm.post AND k = 1"""


@register("c03_freeze_date_analysis", _dates("freeze_up"))
def _(s, d):
    return tables.date_analysis(ice_dates(s, d), "freeze_up")


@register("c03_breakup_date_analysis", _dates("breakup"))
def _(s, d):
    return tables.date_analysis(ice_dates(s, d), "breakup")


# --- channels: a brand is a profile, its parts are the points -------------------------------------
POINTS = """pt AS (SELECT p_brand AS profile, p_partkey * 0.5 AS b0, 30 + abs(p_size - 25) / 5.0 AS h, CASE p_type WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 3 ELSE 0 END AS code, CASE WHEN p_size > 30 THEN p_size / 1000.0 END AS n, CASE WHEN p_size < 10 THEN p_size * 2.0 END AS alpha FROM part),
 pn AS (SELECT *, b0 - min(b0) OVER (PARTITION BY profile) AS b FROM pt),
 mk AS (SELECT profile, min(b) AS b_min, max(b) AS b_max, min(h) AS h_min, min(h) FILTER (code = 3) AS thalweg, coalesce(min(b) FILTER (code = 2), min(b)) AS lb, CASE WHEN count(DISTINCT b) FILTER (code = 2) > 1 THEN max(b) FILTER (code = 2) ELSE max(b) END AS rb FROM pn GROUP BY 1)"""
LEVELS = (30.3, 31.1, 32.5, 33.7, 35.5)
LV = "(VALUES " + ", ".join(f"(CAST({x} AS DOUBLE))" for x in LEVELS) + ") lv(z)"


def points(s, d):
    z = F.col("p_size")
    return table(s, d, "part").select(
        F.col("p_brand").alias("profile"), (F.col("p_partkey") * 0.5).alias("b"), (30 + F.abs(z - 25) / 5.0).alias("h"),
        F.when(F.col("p_type") == "STANDARD", 2).when(F.col("p_type") == "PROMO", 3).otherwise(0).alias("code"),
        F.when(z > 30, z / 1000.0).alias("n"), F.when(z < 10, z * 2.0).alias("alpha_deg"))


def levels(s, d):
    return points(s, d).select("profile").distinct().withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in LEVELS])))


def wet(src, keys, out):
    k = ", ".join(keys)
    return f"""{out}0 AS (SELECT {k}, z, b, h, row_number() OVER w AS i, lead(b) OVER w AS b1, lead(h) OVER w AS h1 FROM {src}, {LV} WINDOW w AS (PARTITION BY {k}, z ORDER BY b)),
 {out}1 AS (SELECT *, min(CASE WHEN h <= z THEN i END) OVER (PARTITION BY {k}, z) AS s, min(CASE WHEN h <= z AND h1 > z THEN i END) OVER (PARTITION BY {k}, z) AS e FROM {out}0),
 {out}2 AS (SELECT *, CASE WHEN h <= z AND h1 <= z THEN 1.0 WHEN h <= z THEN (z - h) / (h1 - h) WHEN h1 <= z THEN (z - h1) / (h - h1) ELSE 0.0 END AS f FROM {out}1 WHERE h1 IS NOT NULL AND i >= s - 1 AND (e IS NULL OR i <= e)),
 {out}3 AS (SELECT {k}, z, sum(0.5 * (greatest(z - h, 0) + greatest(z - h1, 0)) * (b1 - b) * f) AS area, sum((b1 - b) * f) AS width, sum(sqrt(pow(b1 - b, 2) + pow(h1 - h, 2)) * f) AS chi FROM {out}2 GROUP BY {k}, z),
 {out} AS (SELECT {k}, z, coalesce(area, 0) AS area, coalesce(width, 0) AS width, coalesce(chi, 0) AS chi FROM (SELECT DISTINCT {k}, z FROM {out}0) LEFT JOIN {out}3 USING ({k}, z))"""


@register("h01_wet_geometry", f"WITH {POINTS}, {wet('pn', ['profile'], 'g')} SELECT profile, {R('z AS level', 'area', 'width', 'chi AS perimeter')} FROM g")
def _(s, d):
    return channel.geometry(points(s, d), levels(s, d))


@register("h01_area_curve", f"""WITH {POINTS}, lg AS (SELECT profile, h_min + k * 0.5 AS level FROM (SELECT profile, min(h) AS h_min, max(h) AS h_max FROM pt GROUP BY 1) m, range(0, 40) r(k) WHERE k < ceil((h_max + 0.5 - h_min) / 0.5 - 1e-9)),
 sg AS (SELECT profile, level, b, h, row_number() OVER w AS i, lead(b) OVER w AS b1, lead(h) OVER w AS h1 FROM pn JOIN lg USING (profile) WINDOW w AS (PARTITION BY profile, level ORDER BY b)),
 s1 AS (SELECT *, min(CASE WHEN h <= level THEN i END) OVER (PARTITION BY profile, level) AS s, min(CASE WHEN h <= level AND h1 > level THEN i END) OVER (PARTITION BY profile, level) AS e FROM sg),
 s2 AS (SELECT *, CASE WHEN h <= level AND h1 <= level THEN 1.0 WHEN h <= level THEN (level - h) / (h1 - h) WHEN h1 <= level THEN (level - h1) / (h - h1) ELSE 0.0 END AS f FROM s1 WHERE h1 IS NOT NULL AND i >= s - 1 AND (e IS NULL OR i <= e))
 SELECT profile, {R('level', 'sum(0.5 * (greatest(level - h, 0) + greatest(level - h1, 0)) * (b1 - b) * f) AS area', 'sum((b1 - b) * f) AS width')} FROM s2 GROUP BY profile, level""")
def _(s, d):
    p = points(s, d)
    return channel.geometry(p, channel.level_grid(p, 0.5)).select("profile", "level", "area", "width")


COMP = f"""{POINTS}, cm AS (SELECT profile, b, h, unnest(['left', 'channel', 'right']) AS compartment FROM pn), cq AS (SELECT cm.* FROM cm JOIN mk USING (profile) WHERE (compartment = 'left' AND b <= lb AND b_min < lb) OR (compartment = 'channel' AND b BETWEEN lb AND rb AND lb < rb) OR (compartment = 'right' AND b >= rb AND rb < b_max)),
 {wet('cq', ['profile', 'compartment'], 'c')}, cz AS (SELECT c.profile, compartment, z, CASE WHEN z <= h_min THEN 0 ELSE area END AS area, CASE WHEN z <= h_min THEN 0 ELSE width END AS width, CASE WHEN z <= h_min THEN 0 ELSE chi END AS chi FROM c JOIN mk USING (profile))"""


@register("h02_compartments", f"WITH {COMP} SELECT profile, compartment, {R('z AS level', 'area', 'width', 'chi AS perimeter')} FROM cz")
def _(s, d):
    return channel.compartments(points(s, d), levels(s, d))


@register("h03_composite_discharge", f"""WITH {COMP}, {wet('pn', ['profile'], 'g')}, mq AS (SELECT *, CASE compartment WHEN 'channel' THEN 0.025 ELSE 0.035 END AS n FROM cz),
 mt AS (SELECT profile, z, compartment, area, n, CASE WHEN area > 0 AND chi > 0 THEN area / n * pow(area / chi, 2.0 / 3.0) * sqrt(0.0005) ELSE 0 END AS q FROM mq),
 ms AS (SELECT profile, z, sum(q) AS q, coalesce(max(q) FILTER (compartment = 'left'), 0) AS q_left, coalesce(max(q) FILTER (compartment = 'channel'), 0) AS q_channel, coalesce(max(q) FILTER (compartment = 'right'), 0) AS q_right, sum(area * n) AS an FROM mt GROUP BY 1, 2)
 SELECT ms.profile, {R('ms.z AS level', 'q', 'q_left', 'q_channel', 'q_right', 'area', 'CASE WHEN area > 0 THEN an / area ELSE 0.025 END AS n_weighted')} FROM ms JOIN g ON g.profile = ms.profile AND g.z = ms.z""")
def _(s, d):
    p = points(s, d)
    dims = p.select("profile").distinct().select("profile", F.lit(0.0005).alias("slope"), F.lit(0.025).alias("n_channel"), F.lit(0.035).alias("n_left"), F.lit(0.035).alias("n_right"))
    return channel.composite_discharge(p, levels(s, d), dims)


@register("h04_profile_marks", f"WITH {POINTS} SELECT profile, {R('b_min', 'b_max', 'h_min', 'thalweg', 'lb AS left_bound', 'rb AS right_bound')} FROM mk")
def _(s, d):
    return channel.marks(channel.normalise(points(s, d)))


# query positions: the middle between every point and its own level shift
CARRY = f"""WITH {POINTS}, qq AS (SELECT DISTINCT profile, b0 + h / 100 AS b FROM pt), nx AS (SELECT qq.profile, qq.b, min(pt.b0) AS nb FROM qq LEFT JOIN pt ON pt.profile = qq.profile AND pt.b0 > qq.b GROUP BY 1, 2),
 un AS (SELECT nx.profile, nx.b, arg_max(pt.n, pt.b0) AS n, arg_max(pt.alpha, pt.b0) AS alpha FROM nx LEFT JOIN pt ON pt.profile = nx.profile AND pt.b0 <= coalesce(nb, 1e18) GROUP BY 1, 2)"""


def positions(s, d):
    return points(s, d).select("profile", (F.col("b") + F.col("h") / 100).alias("b"))


@register("h05_roughness_at", CARRY + f" SELECT profile, {R('b', 'coalesce(n, 0.025) AS n')} FROM un")
def _(s, d):
    return channel.roughness_at(points(s, d), positions(s, d))


@register("h05_cos_alpha_at", CARRY + f" SELECT profile, {R('b', 'cos(radians(coalesce(alpha, 0))) AS cos_alpha')} FROM un")
def _(s, d):
    return channel.cos_alpha_at(points(s, d), positions(s, d))


LQ = """lq AS (SELECT l_returnflag || l_linestatus AS post, sqrt(l_extendedprice) / 10 + l_quantity / 100 AS level, l_extendedprice / 100 AS q, l_orderkey * 10 + l_linenumber AS t FROM lineitem),
 l0 AS (SELECT post, count(*) AS n, min(level) - 0.01 AS h0 FROM lq WHERE q > 0 GROUP BY 1 HAVING count(*) >= 3),
 lc AS (SELECT post, n, h0, exp(regr_intercept(ln(q), ln(level - h0))) AS a, regr_slope(ln(q), ln(level - h0)) AS b, regr_r2(ln(q), ln(level - h0)) AS r2 FROM lq JOIN l0 USING (post) WHERE q > 0 GROUP BY 1, 2, 3)"""


def level_obs(s, d):
    return table(s, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("post"), (F.sqrt("l_extendedprice") / 10 + F.col("l_quantity") / 100).alias("level"), (F.col("l_extendedprice") / 100).alias("q"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"))


@register("h06_rating_curve", f"WITH {LQ} SELECT post, {B('n')}, {R('h0', 'a', 'b', 'r2')} FROM lc")
def _(s, d):
    return channel.rating_curve(level_obs(s, d))


@register("h07_discharge_from_level", f"WITH {LQ} SELECT post, {B('t')}, {R('level', 'CASE WHEN level > h0 THEN a * pow(level - h0, b) ELSE 0 END AS q', digits=5)} FROM lq JOIN lc USING (post)", digits=5)
def _(s, d):
    o = level_obs(s, d)
    return channel.discharge_from_level(o, channel.rating_curve(o))


@register("h07_level_from_discharge", f"WITH {LQ} SELECT post, {B('t')}, {R('q', 'CASE WHEN q > 0 THEN h0 + pow(q / a, 1 / b) ELSE h0 END AS level', digits=5)} FROM lq JOIN lc USING (post)", digits=5)
def _(s, d):
    o = level_obs(s, d)
    return channel.level_from_discharge(o, channel.rating_curve(o))


# --- storage ------------------------------------------------------------------------------------
REG = with_views("annual") + """, an AS (SELECT post, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY post) AS n, avg(value) OVER (PARTITION BY post) AS mean, sum(value) OVER (PARTITION BY post ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM annual WINDOW w AS (PARTITION BY post ORDER BY t)),
 ad AS (SELECT an.*, f, mean * f AS demand FROM an, (VALUES {f}) v(f)), ab AS (SELECT *, run - i * demand AS bal FROM ad),
 ag AS (SELECT post, f, demand, mean, -min(bal) AS deficit, avg(CASE WHEN round(bal, 9) >= 0 THEN 100.0 ELSE 0 END) AS g, avg(CASE WHEN value >= demand THEN 100.0 ELSE 0 END) AS h FROM ab GROUP BY 1, 2, 3, 4)"""
REGC = R("demand", "mean", "CASE WHEN demand <= mean THEN deficit END AS max_deficit", "CASE WHEN demand <= mean THEN deficit * (365.25 * 86400) / 1e9 END AS volume_km3", "CASE WHEN demand > mean THEN h ELSE g END AS guarantee")


@register("v01_multi_year_regulation", REG.format(f="(0.7), (0.95), (1.1)") + f" SELECT post, {REGC} FROM ag")
def _(s, d):
    v = view(s, d, "annual")
    m = F.avg("value")
    dm = v.groupBy("post").agg(F.array(m * 0.7, m * 0.95, m * 1.1).alias("d")).select("post", F.explode("d").alias("demand"))
    return tables.multi_year_regulation(v, dm)


@register("v02_storage_yield", REG.format(f="(0.5), (0.6), (0.7), (0.8), (0.9)") + f" SELECT post, {R('f AS fraction')}, {REGC} FROM ag")
def _(s, d):
    return tables.storage_yield(view(s, d, "annual"), (0.5, 0.6, 0.7, 0.8, 0.9))


@register("v03_level_volume", f"""WITH lv AS (SELECT p_brand AS post, p_partkey * 0.01 AS t, p_retailprice / 97 AS value FROM part), ll AS (SELECT *, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM lv WINDOW w AS (PARTITION BY post ORDER BY t))
 SELECT post, {R('t', 'value', 'sum(coalesce((value + pv) / 2 * (t - pt), 0)) OVER (PARTITION BY post ORDER BY t ROWS UNBOUNDED PRECEDING) AS volume', digits=5)} FROM ll""", digits=5)
def _(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("post"), (F.col("p_partkey") * 0.01).alias("t"), (F.col("p_retailprice") / 97).alias("value"))
    return tables.level_volume(p)


@register("v04_annual_regulation", with_views("monthly") + f""", mm AS (SELECT post, month, avg(value) AS value FROM monthly GROUP BY 1, 2), pa AS (SELECT post, avg(value) * 0.9 AS demand, 2.0 AS volume_km3 FROM mm GROUP BY 1),
 dv AS (SELECT mm.post, month, value, demand, volume_km3, (value - demand) * ({case('month', fixed.MONTH_DAYS)}) * 86400 / 1e9 AS dv FROM mm JOIN pa ON pa.post = mm.post), bl AS (SELECT *, sum(dv) OVER (PARTITION BY post ORDER BY month) AS balance FROM dv)
 SELECT post, {B('month')}, {R('value', 'demand', 'volume_km3', 'dv', 'balance', 'balance / volume_km3 * 100 AS percent_full')} FROM bl""")
def _(s, d):
    mm = view(s, d, "monthly").groupBy("post", "month").agg(F.avg("value").alias("value"))
    pa = mm.groupBy("post").agg((F.avg("value") * 0.9).alias("demand"), F.lit(2.0).alias("volume_km3"))
    return tables.annual_regulation(mm, pa)
