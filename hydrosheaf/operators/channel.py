"""Cross-sections and rating curves.

A profile is the point table (profile, b, h, code, n, alpha_deg) with one point per b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosheaf.plans.ordering import block_of, fill_edges, sequence, spread

THALWEG, FLOODPLAIN_EDGE = 3, 2


def normalise(points: DataFrame) -> DataFrame:
    """Shift b to start at zero."""
    d = points.withColumn("blk", block_of(F.col("b")))
    z = points.groupBy("profile").agg(F.min("b").alias("_b0"))
    return spread(d, z, ["profile"]).withColumn("b", F.col("b") - F.col("_b0")).drop("_b0", "blk")


def marks(points: DataFrame) -> DataFrame:
    """Ends, thalweg level and floodplain bounds of each profile (b already shifted).

    Without marks the channel is the whole profile; one mark is the left bound.
    """
    edge = F.when(F.col("code") == FLOODPLAIN_EDGE, F.col("b"))
    return points.groupBy("profile").agg(
        F.min("b").alias("b_min"), F.max("b").alias("b_max"), F.min("h").alias("h_min"),
        F.min(F.when(F.col("code") == THALWEG, F.col("h"))).alias("thalweg"),
        F.coalesce(F.min(edge), F.min("b")).alias("left_bound"),
        F.when(F.countDistinct(edge) > 1, F.max(edge)).otherwise(F.max("b")).alias("right_bound"))


def wet_section(points: DataFrame, levels: DataFrame, keys) -> DataFrame:
    """Area, width and wetted perimeter of the first contiguous wet run below each level.

    ``levels``: (keys[0], level).  Segments come from neighbouring points; the run is bounded by
    two minima per (section, level), so no ordered pass over the fan-out is needed.
    """
    keys = list(keys)
    seq = sequence(points.select(*keys, F.col("b").alias("t"), F.col("h").alias("value")), keys, width=256)
    h0, h1, b0, b1 = F.col("value"), F.col("next"), F.col("t"), F.col("next_t")
    d = spread(seq.select(*keys, "t", "value", "i", "next", "next_t", "blk"), levels, [keys[0]])
    z = F.col("level")
    first = d.groupBy(*keys, "level").agg(
        F.min(F.when(h0 <= z, F.col("i"))).alias("_s"), F.min(F.when((h0 <= z) & (h1 > z), F.col("i"))).alias("_e"))
    e = spread(d, first, [*keys, "level"]).filter(h1.isNotNull() & (F.col("i") >= F.col("_s") - 1) & (F.col("_e").isNull() | (F.col("i") <= F.col("_e"))))
    db, dh = b1 - b0, h1 - h0
    # share of the segment that lies under water
    share = F.when((h0 <= z) & (h1 <= z), F.lit(1.0)).when(h0 <= z, (z - h0) / dh).when(h1 <= z, (z - h1) / -dh).otherwise(F.lit(0.0))
    d0, d1 = F.greatest(z - h0, F.lit(0.0)), F.greatest(z - h1, F.lit(0.0))
    g = e.groupBy(*keys, "level").agg(
        F.sum(0.5 * (d0 + d1) * db * share).alias("area"), F.sum(db * share).alias("width"), F.sum(F.hypot(db, dh) * share).alias("perimeter"))
    names = points.select(*keys).distinct().join(levels, keys[0])
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return names.join(g, [*keys, "level"], "left").select(*keys, "level", zero("area"), zero("width"), zero("perimeter"))


def geometry(points: DataFrame, levels: DataFrame) -> DataFrame:
    return wet_section(normalise(points), levels, ["profile"])


def level_grid(points: DataFrame, dh: float = 0.1) -> DataFrame:
    """Levels from the lowest to the highest point in steps of ``dh``."""
    m = points.groupBy("profile").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    k = F.explode(F.sequence(F.lit(0), F.ceil((F.col("b") + dh - F.col("a")) / dh - 1e-9).cast("int") - 1))
    return m.withColumn("k", k).select("profile", (F.col("a") + F.col("k") * dh).alias("level"))


def compartments(points: DataFrame, levels: DataFrame) -> DataFrame:
    """The same geometry for left floodplain, channel and right floodplain.

    The bounds are points of the profile, so a bound point belongs to both sides.
    """
    pts = normalise(points)
    m = marks(pts)
    b = F.col("b")
    d = spread(pts.withColumn("blk", block_of(b)), m, ["profile"])
    side = F.array_compact(F.array(
        F.when((b <= F.col("left_bound")) & (F.col("b_min") < F.col("left_bound")), "left"),
        F.when((b >= F.col("left_bound")) & (b <= F.col("right_bound")) & (F.col("left_bound") < F.col("right_bound")), "channel"),
        F.when((b >= F.col("right_bound")) & (F.col("right_bound") < F.col("b_max")), "right")))
    parts = d.select("profile", "b", "h", F.explode(side).alias("compartment"))
    g = wet_section(parts, levels, ["profile", "compartment"])
    low = m.select("profile", "h_min")
    dry = F.col("level") <= F.col("h_min")
    g = g.join(low, "profile")
    return g.select("profile", "compartment", "level", *[F.when(dry, 0.0).otherwise(F.col(c)).alias(c) for c in ("area", "width", "perimeter")])


def manning(area: Column, perimeter: Column, n: Column, slope: Column) -> Column:
    ok = (area > 0) & (perimeter > 0) & (n > 0) & (slope > 0)
    return F.when(ok, area / n * F.pow(area / perimeter, F.lit(2.0 / 3.0)) * F.sqrt(slope)).otherwise(F.lit(0.0))


def composite_discharge(points: DataFrame, levels: DataFrame, dims: DataFrame) -> DataFrame:
    """Discharge by compartment with its own roughness, and the area-weighted roughness.

    ``dims``: profile, slope, n_channel, n_left, n_right.
    """
    g = compartments(points, levels).join(dims, "profile")
    n = F.when(F.col("compartment") == "left", F.col("n_left")).when(F.col("compartment") == "right", F.col("n_right")).otherwise(F.col("n_channel"))
    g = g.withColumn("n", n).withColumn("q", manning(F.col("area"), F.col("perimeter"), n, F.col("slope")))
    side = lambda s, c: F.coalesce(F.max(F.when(F.col("compartment") == s, F.col(c))), F.lit(0.0))
    t = g.groupBy("profile", "level").agg(
        F.sum("q").alias("q"), side("left", "q").alias("q_left"), side("channel", "q").alias("q_channel"), side("right", "q").alias("q_right"),
        F.sum(F.col("area") * F.col("n")).alias("_an"), F.max("n_channel").alias("_nc"))
    whole = geometry(points, levels).select("profile", "level", "area")
    return t.join(whole, ["profile", "level"]).select(
        "profile", "level", "q", "q_left", "q_channel", "q_right", "area",
        F.when(F.col("area") > 0, F.col("_an") / F.col("area")).otherwise(F.col("_nc")).alias("n_weighted"))


def carried(points: DataFrame, queries: DataFrame, col: str, default: Column | float) -> DataFrame:
    """Value of ``col`` carried along b to each query position (profile, b).

    As in the reference, the first point beyond the position already counts when it gives a value.
    """
    p = points.select("profile", "b", F.lit(0).alias("kind"), F.col(col).cast("double").alias("v"))
    q = queries.select("profile", "b", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v")).distinct()
    u = p.unionByName(q).withColumn("blk", block_of(F.col("b"))).withColumn("o", F.struct("b", "kind"))
    u = fill_edges(u, F.when((F.col("kind") == 0) & F.col("v").isNotNull(), F.struct("v")), ["profile"], "o").withColumnRenamed("left", "seen").drop("right")
    u = fill_edges(u, F.when(F.col("kind") == 0, F.struct("b", "v")), ["profile"], "o")
    return u.filter(F.col("kind") == 1).select("profile", "b", F.coalesce(F.col("right.v"), F.col("seen.v"), F.lit(default)).alias(col))


def roughness_at(points: DataFrame, queries: DataFrame, default: float = 0.025) -> DataFrame:
    return carried(points, queries, "n", default)


def cos_alpha_at(points: DataFrame, queries: DataFrame) -> DataFrame:
    return carried(points, queries, "alpha_deg", 0.0).select("profile", "b", F.cos(F.radians("alpha_deg")).alias("cos_alpha"))


def rating_curve(df: DataFrame) -> DataFrame:
    """Q = a (H - H0)^b by least squares of logarithms, H0 = lowest level - 0.01; (post, level, q)."""
    d = df.filter(F.col("q") > 0).withColumn("blk", block_of(F.col("level")))
    z = d.groupBy("post").agg(F.count(F.lit(1)).alias("n"), (F.min("level") - 0.01).alias("h0")).filter(F.col("n") >= 3)
    e = spread(d, z)
    x, y = F.log(F.col("level") - F.col("h0")), F.log("q")
    return e.groupBy("post", "n", "h0").agg(
        F.exp(F.regr_intercept(y, x)).alias("a"), F.regr_slope(y, x).alias("b"), F.regr_r2(y, x).alias("r2"))


def discharge_from_level(levels: DataFrame, curves: DataFrame) -> DataFrame:
    d = spread(levels.withColumn("blk", block_of(F.col("level"))), curves.select("post", "h0", "a", "b"))
    above = F.col("level") - F.col("h0")
    return d.select("post", "t", "level", F.when(above > 0, F.col("a") * F.pow(above, F.col("b"))).otherwise(F.lit(0.0)).alias("q"))


def level_from_discharge(flows: DataFrame, curves: DataFrame) -> DataFrame:
    d = spread(flows.withColumn("blk", block_of(F.col("t"))), curves.select("post", "h0", "a", "b"))
    return d.select("post", "t", "q", F.when(F.col("q") > 0, F.col("h0") + F.pow(F.col("q") / F.col("a"), 1 / F.col("b"))).otherwise(F.col("h0")).alias("level"))
