"""Series derived from the given tables, once for Spark and once as SQL text.

``VIEWS`` holds the SQL common table expressions; :func:`view` gives the same table in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    # total quantity per day and flag pair
    "daily": """daily AS (SELECT l_returnflag || l_linestatus AS post,
        CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t,
        CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)""",
    # the same per supplier: short, with many missing days
    "sparse": """sparse AS (SELECT CAST(l_suppkey AS VARCHAR) AS post,
        CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t,
        CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)""",
    # a month plays the year
    "annual": """annual AS (SELECT o_orderpriority AS post,
        CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) + 1900 AS BIGINT) AS t,
        round(sum(o_totalprice), 2) / 9973 AS value FROM orders GROUP BY 1, 2)""",
    # many posts, with gaps where no order fell in the month
    "many": """many AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) || '-' || o_orderstatus AS post,
        CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) + 1900 AS BIGINT) AS t,
        round(sum(o_totalprice), 2) / 9973 AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
    # target post with three analogs: the next three nations, same status
    "pairs": """pairs AS (SELECT 'N' || CAST(n AS VARCHAR) || '-' || s AS target,
        'N' || CAST((n + k) % 25 AS VARCHAR) || '-' || s AS analog, CAST(k AS BIGINT) AS k
        FROM (SELECT DISTINCT c_nationkey AS n, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey),
        (VALUES (1), (2), (3)) v(k))""",
    "hourly": """hourly AS (SELECT event_type AS post,
        CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t,
        round(sum(value), 2) / 9.97 AS value FROM events GROUP BY 1, 2)""",
    # monthly sums: quantity as rain, a share of the price as demand of the air
    "forcing": """forcing AS (SELECT l_returnflag || l_linestatus AS post,
        CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS BIGINT) AS t,
        CAST(sum(l_quantity) AS DOUBLE) AS p,
        round(sum(l_extendedprice * l_discount), 4) / 997.3 AS pet,
        round(sum(l_extendedprice * l_tax), 4) / 997.3 AS runoff FROM lineitem GROUP BY 1, 2)""",
    "monthly": """monthly AS (SELECT l_returnflag || l_linestatus AS post,
        CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month,
        CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2, 3)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lag = lambda c, y0: ((F.year(c) - y0) * 12 + F.month(c)).cast("bigint")
    if name in ("daily", "sparse", "forcing", "monthly"):
        li = table(spark, sf_dir, "lineitem")
        post = F.concat("l_returnflag", "l_linestatus")
        if name == "sparse":
            post = F.col("l_suppkey").cast("string")
        qty = F.sum("l_quantity").cast("double")
        if name in ("daily", "sparse"):
            day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01")).cast("bigint")
            return li.groupBy(post.alias("post"), day.alias("t")).agg(qty.alias("value"))
        if name == "monthly":
            return li.groupBy(
                post.alias("post"),
                F.year("l_shipdate").cast("bigint").alias("year"),
                F.month("l_shipdate").cast("bigint").alias("month"),
            ).agg(qty.alias("value"))
        price = F.col("l_extendedprice")
        return li.groupBy(post.alias("post"), lag("l_shipdate", 1995).alias("t")).agg(
            qty.alias("p"),
            (F.round(F.sum(price * F.col("l_discount")), 4) / 997.3).alias("pet"),
            (F.round(F.sum(price * F.col("l_tax")), 4) / 997.3).alias("runoff"),
        )
    if name in ("annual", "many"):
        o = table(spark, sf_dir, "orders")
        post = F.col("o_orderpriority")
        if name == "many":
            c = table(spark, sf_dir, "customer")
            o = o.join(c, o.o_custkey == c.c_custkey)
            post = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("o_orderstatus"))
        t = (lag("o_orderdate", 1995) + 1900).cast("bigint")
        return o.groupBy(post.alias("post"), t.alias("t")).agg(
            (F.round(F.sum("o_totalprice"), 2) / 9973).alias("value")
        )
    if name == "pairs":
        o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
        label = lambda k: F.concat(F.lit("N"), k.cast("string"), F.lit("-"), F.col("s"))
        posts = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("n"), F.col("o_orderstatus").alias("s")).distinct()
        return posts.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
            label(F.col("n")).alias("target"),
            label((F.col("n") + F.col("k")) % 25).alias("analog"),
            F.col("k").cast("bigint").alias("k"),
        )
    if name == "hourly":
        e = table(spark, sf_dir, "events")
        return e.groupBy(
            F.col("event_type").alias("post"),
            (F.datediff(F.to_date("ts"), F.lit("1970-01-01")) * 24 + F.hour("ts")).cast("bigint").alias("t"),
        ).agg((F.round(F.sum("value"), 2) / 9.97).alias("value"))
    raise KeyError(name)


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(VIEWS[n] for n in names)
