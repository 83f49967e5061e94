"""Water balance, snow, catchment, structure, ice and storage jobs over tables of many rows.

The guide tables are a handful of fixed rows, so a lookup is a CASE column inside generated
code, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosheaf.functions import fixed
from hydrosheaf.functions.special import lerp
from hydrosheaf.plans.ordering import block_of, quantiles, running, sequence, spread, value_ranks

lit = F.lit


def pick(key: Column, values, default=None) -> Column:
    """Value of a fixed table by key: dict or sequence numbered from one."""
    items = values.items() if isinstance(values, dict) else enumerate(values, 1)
    e = None
    for k, v in items:
        e = F.when(key == k, lit(v)) if e is None else e.when(key == k, lit(v))
    return e if default is None else e.otherwise(lit(default))


# --- water balance --------------------------------------------------------------------------
def water_balance(df: DataFrame) -> DataFrame:
    """Residual P - E - R - dS - dG of each (basin, year) row, in mm and percent of P."""
    zero = lambda c: F.coalesce(F.col(c), lit(0.0)) if c in df.columns else lit(0.0)
    res = F.col("p") - F.col("e") - F.col("r") - zero("ds") - zero("dg")
    pct = F.when(F.col("p") != 0, F.abs(res) / F.col("p") * 100).otherwise(lit(0.0))
    return df.withColumn("residual", res).withColumn("residual_percent", pct).withColumn("balanced", pct <= 5)


def runoff_coefficients(df: DataFrame, keys=("post",)) -> DataFrame:
    """Ratio of mean runoff to mean precipitation with a validity flag."""
    m = df.groupBy(*keys).agg(F.avg("p").alias("mean_p"), F.avg("r").alias("mean_r"))
    k = F.when(F.col("mean_p") == 0, lit(0.0)).otherwise(F.col("mean_r") / F.col("mean_p"))
    return m.withColumn("coefficient", k).withColumn("valid", (k >= 0) & (k <= 1))


def _vapour(t: Column) -> Column:
    return 6.11 * F.pow(lit(10.0), 7.5 * t / (237.3 + t))


def evaporation_dalton(tw: Column, ta: Column, wind: Column, a: float = 0.21) -> Column:
    return F.greatest(a * (_vapour(tw) - _vapour(ta)) * (1 + 0.54 * wind), lit(0.0))


def evaporation_monthly(t: Column, humidity: Column, wind: Column, month: Column) -> Column:
    """0.0018 (25 + t)^2 (1 - a)(1 + 0.72 U) times the days of the month; null for a outside 0..1."""
    base = 0.0018 * (25 + t) * (25 + t) * (1 - humidity) * (1 + 0.72 * wind)
    days = pick(month, fixed.MONTH_DAYS, 1)
    return F.when((humidity >= 0) & (humidity <= 1), F.greatest(base * days, lit(0.0)))


def pan_to_lake(pan: Column, coefficient: float = 0.68) -> Column:
    if not 0.5 <= coefficient <= 0.85:
        raise ValueError("pan coefficient must lie in 0.50..0.85")
    return pan * coefficient


def infiltration(df: DataFrame, rain="rain", permeability="k", moisture="moisture") -> DataFrame:
    k = F.greatest(F.col(permeability) * (1 - 0.8 * F.col(moisture)), lit(0.0))
    i = F.col(rain)
    return df.withColumn("k_eff", k).withColumn("infiltration", F.least(i, k)).withColumn(
        "surface", F.greatest(i - k, lit(0.0))).withColumn("ratio", F.when(i > 0, F.least(i, k) / i).otherwise(lit(0.0)))


# --- snow -----------------------------------------------------------------------------------
def melt_rate(zone: Column, t: Column) -> Column:
    return pick(zone, [a for a, _ in fixed.MELT_ZONE], fixed.MELT_ZONE[2][0]) * F.greatest(t, lit(0.0))


def snow_water(height_cm: Column, density: Column) -> Column:
    """H rho / 1000 as in the reference (H in cm, density in kg/m3)."""
    return height_cm * density / 1000


def snowmelt(df: DataFrame, store: DataFrame, a: float = 3.5, net: float = 0.85) -> DataFrame:
    """Degree-day melt limited by the store, in closed form from one running sum.

    ``df``: post, t, value = air temperature; ``store``: post, w0.  Use ``net=1`` for the
    hydrograph form.
    """
    seq = sequence(df).select("post", "t", "value", "i", "blk")
    # null temperature melts nothing, as does frost
    pot = a * net * F.greatest(F.coalesce("value", lit(0.0)), lit(0.0))
    d = spread(running(seq, pot, "potential"), store)
    left = F.greatest(F.col("w0") - F.col("potential"), lit(0.0))
    before = F.greatest(F.col("w0") - (F.col("potential") - pot), lit(0.0))
    return d.select("post", "t", "i", "w0", (before - left).alias("melt"), left.alias("remaining"))


def snow_free(melt: DataFrame) -> DataFrame:
    """Total melt, final store and the first row (from zero) without snow; the row count if none."""
    return melt.groupBy("post").agg(
        F.sum("melt").alias("total_melt"), F.min("remaining").alias("w_final"),
        F.coalesce(F.min(F.when(F.col("remaining") <= 0, F.col("i") - 1)), F.count(lit(1))).alias("snow_free_day"))


def melt_hydrograph(melt: DataFrame, area: DataFrame, alpha: float = 0.7, hours: float = 24.0) -> DataFrame:
    d = spread(melt.withColumn("blk", F.floor(F.col("i") / 4096)), area)
    return d.select("post", "t", "melt", "remaining", (F.col("melt") * F.col("area_km2") * alpha / (3.6 * hours)).alias("q"))


def seasonal_snow(df: DataFrame, a: float = 3.5, days: int = 30) -> DataFrame:
    """Season rows w0, p, t, area_km2: melt, runoff (melt - 0.3 P), final store and peak flow."""
    m = F.least(a * F.greatest("t", lit(0.0)) * days, F.col("w0"))
    peak = F.when(a * F.col("t") * 10 > F.col("w0"), F.col("w0") / 10).otherwise(a * F.col("t"))
    return df.withColumn("melt", m).withColumn("runoff", F.greatest(m - 0.3 * F.col("p"), lit(0.0))).withColumn(
        "w_final", F.greatest(F.col("w0") - m + F.col("p"), lit(0.0))).withColumn(
        "q_peak", peak * F.col("area_km2") * 0.7 / (3.6 * 24))


# --- events ---------------------------------------------------------------------------------
def hydrograph_convolution(rain: DataFrame, unit: DataFrame) -> DataFrame:
    """Rain (event, t, r) through the event's unit hydrograph (event, k, u): q_t = sum r u, t = tau + k.

    A unit hydrograph has a few ordinates; each rain row fans out to them and the sums are
    formed map-side.  Rain meets the ordinates by (event, time block), so a long event is split.
    """
    u = unit.groupBy("event").agg(F.collect_list(F.struct("k", "u")).alias("us"))
    d = spread(rain.withColumn("blk", block_of(F.col("t"))), u, ["event"]).select("event", "t", "r", F.explode("us").alias("x"))
    return d.groupBy("event", (F.col("t") + F.col("x.k")).alias("t")).agg(F.sum(F.col("r") * F.col("x.u")).alias("q"))


def flood_volume(df: DataFrame, dt_hours: float = 1.0) -> DataFrame:
    """Trapezoid volume (m3) of each event's hydrograph."""
    seq = sequence(df)
    part = F.when(F.col("next_t").isNotNull(), (F.col("value") + F.col("next")) / 2 * dt_hours * 3600)
    return seq.groupBy("post").agg(F.sum(part).alias("volume_m3")).withColumn("volume_km3", F.col("volume_m3") / 1e9)


# --- catchments -----------------------------------------------------------------------------
def idf_intensity(t: Column, period: Column, zone: Column) -> Column:
    col = lambda j: pick(zone, [z[j] for z in fixed.IDF_ZONE], fixed.IDF_ZONE[2][j])
    return col(0) * F.pow(F.greatest(period, lit(1.0)), col(3)) / F.pow(F.greatest(t, lit(0.1)) + col(1), col(2))


def idf_curve(sites: DataFrame, periods=(2, 10, 100)) -> DataFrame:
    """Intensity (mm/h) and depth (mm) of each site, duration and return period."""
    grid = F.explode(F.array(*[F.struct(lit(float(d)).alias("duration"), lit(float(p)).alias("period"))
                               for d in fixed.IDF_DURATIONS for p in periods]))
    d = sites.withColumn("g", grid).select("*", "g.*").drop("g")
    i = idf_intensity(F.col("duration"), F.col("period"), F.col("zone")) * 60
    return d.withColumn("intensity", i).withColumn("depth", i * F.col("duration") / 60)


def concentration_time(length: Column, slope: Column, method="kirpich") -> Column:
    k, a, b = (0.93, 0.57, -0.33) if method == "babushkin" else (0.0195, 0.77, -0.385)
    return F.when((length > 0) & (slope > 0), k * F.pow(length, lit(a)) * F.pow(slope, lit(b)))


def rational_method(df: DataFrame, period: float = 10.0) -> DataFrame:
    """Q = i F alpha / 3.6 per subcatchment (basin, area_km2, alpha, length_km, slope, zone)."""
    tc = concentration_time(F.col("length_km"), F.col("slope"))
    d = df.withColumn("tc", tc)
    i = idf_intensity(F.col("tc"), lit(float(period)), F.col("zone")) * 60
    fmax = pick(F.col("zone"), fixed.RATIONAL_F_MAX, 50)
    return d.withColumn("q", i * F.col("area_km2") * F.col("alpha") / 3.6).withColumn("f_max", fmax).withColumn(
        "valid", (F.col("area_km2") <= fmax) & (F.col("tc") >= 5))


def regional_runoff(df: DataFrame) -> DataFrame:
    """Mean flow, module, volume and winter minimum from area and region (default the first)."""
    a = F.col("area_km2")
    col = lambda j: pick(F.col("region"), {k: v[j] for k, v in fixed.REGION.items()}, fixed.REGION["central_russia"][j])
    q = col(0) * F.pow(a, col(1))
    return df.withColumn("q_mean", q).withColumn("module", F.when(a > 0, q * 1000 / a).otherwise(lit(0.0))).withColumn(
        "volume", q * 31.536).withColumn("q_min_winter", col(8) * F.pow(a, col(9)))


def regional_peak(df: DataFrame, period: Column) -> Column:
    a = F.col("area_km2")
    col = lambda j: pick(F.col("region"), {k: v[j] for k, v in fixed.REGION.items()}, fixed.REGION["central_russia"][j])
    q2, q10, q100 = (col(j) * F.pow(a, col(j + 1)) for j in (2, 4, 6))
    return F.when(period <= 2, q2).when(period <= 10, q2 * F.pow(q10 / q2, (period - 2) / 8)).otherwise(
        q10 * F.pow(q100 / q10, F.least((period - 10) / 90, lit(1.0))))


def design_hydrograph_times(df: DataFrame) -> DataFrame:
    f, z = F.col("area_km2"), F.col("zone")
    quick, big = z.isin(5, 6), f > 500
    t = 0.3 * F.pow(f, lit(0.3))
    return df.withColumn("t_peak", t * F.when(quick, 0.7).otherwise(1.0) * F.when(big, 1.3).otherwise(1.0)).withColumn(
        "t_base", 2.5 * t * F.when(quick, 0.8).otherwise(1.0) * F.when(big, 1.2).otherwise(1.0))


# --- structures -----------------------------------------------------------------------------
def free_overfall(head: Column, length: Column, cd: Column, submergence: Column | float = 1.0) -> Column:
    return F.when(head > 0, cd * length * F.pow(head, lit(1.5)) * submergence).otherwise(lit(0.0))


def weir_flow(head: Column, length: Column, kind: Column) -> Column:
    return free_overfall(head, length, pick(kind, fixed.WEIR_CD, 1.84))


def orifice_flow(head: Column, area: Column, cd: float = 0.62) -> Column:
    return F.when(head > 0, cd * area * F.sqrt(2 * 9.81 * head)).otherwise(lit(0.0))


def spillway_check(df: DataFrame) -> DataFrame:
    """Capacity against the design flood: gate area > 0 uses the orifice, else the weir by type."""
    cap = F.when(F.col("gate_area") > 0, orifice_flow(F.col("head"), F.col("gate_area"))).otherwise(
        weir_flow(F.col("head"), F.col("crest"), F.col("weir")))
    d = df.withColumn("capacity", cap)
    return d.withColumn("margin", F.when(F.col("q_design") > 0, (cap - F.col("q_design")) / F.col("q_design") * 100).otherwise(lit(0.0))).withColumn(
        "sufficient", cap >= F.col("q_design"))


def reservoir_sediment(df: DataFrame, density: float = 1.3) -> DataFrame:
    """Trap efficiency, sediment inflow and life time (null = unlimited) of each reservoir."""
    v, q = F.col("volume_km3"), F.col("q_mean")
    trap = F.when((v <= 0) | (q <= 0), lit(0.0)).otherwise(F.least(F.greatest(1 - 0.057 * F.pow(v, lit(0.58)) / F.pow(q, lit(0.14)), lit(0.0)), lit(1.0)))
    g = pick(F.col("soil"), fixed.EROSION, 0.15) * F.col("runoff_mm") * F.col("area_km2") / 1000
    life = F.when(g > 0, v * 1e9 / (g * 1e6 / density))
    return df.withColumn("trap", trap).withColumn("sediment", g).withColumn("lifetime", life).withColumn(
        "long_lived", F.coalesce(life > 100, lit(True)))


# --- ice ------------------------------------------------------------------------------------
def ice_thickness(df: DataFrame) -> DataFrame:
    """Zone estimate 0.6 A sqrt|T| + 0.4 table middle, widened by latitude, with 20 % bounds."""
    z = F.col("ice_zone")
    col = lambda j: pick(z, {k: v[j] for k, v in fixed.ICE_ZONE.items()}, fixed.ICE_ZONE["moderate"][j])
    w = (0.6 * col(8) * F.sqrt(F.abs("t_january")) + 0.4 * (col(0) + col(1)) / 2) * (1 + 0.005 * F.greatest(F.col("latitude") - 55, lit(0.0)))
    return df.withColumn("thickness", w).withColumn("thickness_low", 0.8 * w).withColumn("thickness_high", 1.2 * w)


def ice_thickness_by_frost(frost_sum: Column, depth: Column, velocity: Column, snow: Column) -> Column:
    """K sqrt(frost sum / (1 + 0.04 V^2)), at most 0.95 of the depth; null without frost."""
    k = F.when(snow <= 0.05, 0.6).when(snow <= 0.15, 0.7).when(snow <= 0.3, 0.8).when(snow <= 0.5, 0.9).otherwise(1.0)
    return F.when(frost_sum > 0, F.least(k * F.sqrt(frost_sum / (1 + 0.04 * velocity * velocity)), 0.95 * depth))


def ice_jam(df: DataFrame, period: Column) -> DataFrame:
    """Rise of level by a jam, its probability, severity and the level at a return period."""
    b, t, v = F.col("width"), F.col("thickness"), F.col("velocity")
    c = F.when(b < 50, 2.8).when(b < 100, 2.2).when(b < 200, 1.7).otherwise(1.2)
    rise = c * F.sqrt(t / b) * F.pow(F.greatest(v / 0.5, lit(0.1)), lit(0.3)) * F.when(b > 150, 0.85).otherwise(1.0)
    d = df.filter((b > 0) & (t > 0)).withColumn("rise", rise).withColumn("jam_probability", lerp(b, fixed.JAM_PROBABILITY)).withColumn(
        "k_p", lerp(period, fixed.JAM_KP))
    r = F.col("rise")
    return d.withColumn("severity", F.when(r > 2, "dangerous").when(r > 1, "significant").when(r > 0.5, "moderate").otherwise("minor")).withColumn(
        "level", F.col("h_normal") + r * F.col("k_p"))


def ice_duration(freeze: Column, breakup: Column) -> Column:
    """Days of ice cover; null when a day of year lies outside 1..366."""
    ok = (freeze >= 1) & (freeze <= 366) & (breakup >= 1) & (breakup <= 366)
    return F.when(ok, F.when(freeze <= breakup, breakup - freeze).otherwise(366 - freeze + breakup))


def ice_cover_stats(df: DataFrame) -> DataFrame:
    """Mean, deviation, early and late day of freeze-up and breakup, and cover duration."""
    dur = ice_duration(F.col("freeze_up"), F.col("breakup"))
    agg = []
    for c in ("freeze_up", "breakup"):
        m, s = F.avg(c), F.coalesce(F.stddev_samp(c), lit(0.0))
        agg += [m.alias(c + "_mean"), s.alias(c + "_std"), F.greatest(lit(1.0), m - s).alias(c + "_early"),
                F.least(lit(366.0), m + s).alias(c + "_late"), F.min(c).alias(c + "_min"), F.max(c).alias(c + "_max")]
    return df.groupBy("post").agg(
        F.count(lit(1)).alias("years"), *agg, F.avg(dur).alias("duration_mean"),
        F.coalesce(F.stddev_samp(dur), lit(0.0)).alias("duration_std"), F.min(dur).alias("duration_min"), F.max(dur).alias("duration_max"))


def date_analysis(df: DataFrame, col: str) -> DataFrame:
    """Statistics of a day of year with its ten-day mode (lowest on a tie) and timing class."""
    d = df.filter(F.col(col).isNotNull()).select("post", F.col(col).cast("double").alias("value"))
    m = d.groupBy("post").agg(
        F.count(lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    mode = d.groupBy("post", F.bround("value", -1).alias("bin")).agg(F.count(lit(1)).alias("c")).groupBy("post").agg(
        F.max(F.struct("c", (-F.col("bin")).alias("b"))).alias("x"))
    q = quantiles(value_ranks(d), {"p5": 0.05, "p95": 0.95}).drop("n")
    e = m.join(mode, "post").join(q, "post")
    mean = F.col("mean")
    return e.select(
        "post", "n", "mean", "std", F.greatest(lit(1.0), mean - F.col("std")).alias("early"), F.least(lit(366.0), mean + F.col("std")).alias("late"),
        "min", "max", (F.col("max") - F.col("min")).alias("range"), F.when(F.col("n") >= 5, -F.col("x.b")).otherwise(mean).alias("mode"), "p5", "p95",
        F.when(mean < 90, "early").when(mean > 120, "late").otherwise("middle").alias("timing"))


# --- storage --------------------------------------------------------------------------------
def multi_year_regulation(df: DataFrame, demands: DataFrame) -> DataFrame:
    """Required volume and guarantee of each (post, demand); null volume when demand exceeds the mean."""
    seq = sequence(df).select("post", "value", "i", "n", "run", "total", "blk")
    d = spread(seq, demands)
    bal = F.col("run") - F.col("i") * F.col("demand")
    g = d.groupBy("post", "demand").agg(
        F.first("n").alias("n"), (F.first("total") / F.first("n")).alias("mean"), (-F.min(bal)).alias("_deficit"),
        (F.avg((F.round(bal, 9) >= 0).cast("double")) * 100).alias("_g"), (F.avg((F.col("value") >= F.col("demand")).cast("double")) * 100).alias("_h"))
    over = F.col("demand") > F.col("mean")
    return g.select(
        "post", "demand", "mean", F.when(~over, F.col("_deficit")).alias("max_deficit"),
        F.when(~over, F.col("_deficit") * (365.25 * 86400) / 1e9).alias("volume_km3"), F.when(over, F.col("_h")).otherwise(F.col("_g")).alias("guarantee"))


def storage_yield(df: DataFrame, fractions=(0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """Volume and guarantee over a grid of demands given as shares of the mean flow."""
    m = df.groupBy("post").agg(F.avg("value").alias("_m"))
    grid = m.select("post", F.explode(F.array(*[F.struct(lit(f).alias("fraction"), (F.col("_m") * f).alias("demand")) for f in fractions])).alias("x"))
    grid = grid.select("post", "x.*")
    return multi_year_regulation(df, grid.select("post", "demand")).join(grid, ["post", "demand"])


def level_volume(df: DataFrame) -> DataFrame:
    """Cumulative trapezoid volume over (post, t = level, value = area)."""
    seq = sequence(df)
    dv = F.coalesce((F.col("value") + F.col("prev")) / 2 * (F.col("t") - F.col("prev_t")), lit(0.0))
    return running(seq, dv, "volume").select("post", "t", "value", "volume")


def annual_regulation(monthly: DataFrame, params: DataFrame) -> DataFrame:
    """Monthly balance of twelve mean flows against a demand; months of fixed length."""
    from pyspark.sql import Window as W

    d = monthly.join(params, "post")
    dv = (F.col("value") - F.col("demand")) * pick(F.col("month"), fixed.MONTH_DAYS) * 86400 / 1e9
    w = W.partitionBy("post").orderBy("month").rowsBetween(W.unboundedPreceding, 0)  # twelve rows
    return d.withColumn("dv", dv).withColumn("balance", F.sum("dv").over(w)).withColumn(
        "percent_full", F.when(F.col("volume_km3") > 0, F.col("balance") / F.col("volume_km3") * 100).otherwise(lit(0.0)))
