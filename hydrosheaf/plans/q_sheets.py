"""Registered queries: ingest operators on tables derived from the given ones.

File readers and sinks (csv, tab text, xlsx, report folders) are covered by tests, since a
query has no files of its own.
"""

from pyspark.sql import functions as F

from hydrosheaf.plans.catalog import B, R, register
from hydrosheaf.plans.views import table, view, with_views
from hydrosheaf.sources import sheets

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def wide(s, d):
    """The annual view as a text table with a year column, one column per post and a note."""
    w = view(s, d, "annual").groupBy("t").pivot("post", list(PRIORITIES)).agg(F.first("value"))
    return w.select(F.col("t").cast("string").alias("Год"), *[F.col(p).cast("string").alias(p) for p in PRIORITIES], F.lit("note").alias("remark"))


@register("s01_wide_to_series", with_views("annual") + f" SELECT post, {B('t')}, {R('value')} FROM annual")
def _(s, d):
    w = wide(s, d)
    year, posts = sheets.load_wide(w)
    return sheets.to_series(w, year, posts).filter("value is not null")


@register("s02_series_of_post", with_views("annual") + f" SELECT post, {B('t')}, {R('value')} FROM annual WHERE post = '2-HIGH'")
def _(s, d):
    w = wide(s, d)
    return sheets.series_of(sheets.to_series(w, *sheets.load_wide(w)), "2-HIGH")


GAUGE = """gr AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS river, o_orderstatus AS gauge, CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice / 997 AS q, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey),
 gf AS (SELECT river || '_' || gauge AS post, year, arg_min(q, k) AS q FROM gr GROUP BY 1, 2), gk AS (SELECT post FROM gf GROUP BY 1 HAVING count(*) >= 3)"""


def gauges(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return sheets.gauge_series(o.select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("river"), F.col("o_orderstatus").alias("gauge"),
        F.year("o_orderdate").alias("year"), (F.col("o_totalprice") / 997).alias("q"), F.col("o_orderkey").alias("row")))


@register("s04_gauge_series", f"WITH {GAUGE} SELECT post, {B('year AS t')}, {R('q AS value')} FROM gf WHERE post IN (SELECT post FROM gk)")
def _(s, d):
    return gauges(s, d).select("post", "t", "value")


@register("s04_gauge_summary", f"WITH {GAUGE} SELECT post, {B('count(*) AS n')}, min(year) || '-' || max(year) AS period FROM gf WHERE post IN (SELECT post FROM gk) GROUP BY post")
def _(s, d):
    return sheets.gauge_summary(gauges(s, d))


UNITS = (", м³/с", " (мм/год)", "; м", " | km2", ", л/с", "")
W = r"[^\p{L}\p{N}_]"
COMP = "|".join(u.replace("/", r"\s*/\s*") for u in sheets.COMPOUND_UNITS)
SING = "|".join(sheets.SINGLE_UNITS)


def clean_sql(x):
    s = f"translate(lower(trim({x})), '³²', '32')"
    unit = lambda t, u: f"regexp_replace(regexp_replace({t}, '(^|{W})({u})($|{W})', '\\1 \\3', 'g'), '(^|{W})({u})($|{W})', '\\1 \\3', 'g')"
    s = unit(s, COMP)
    s = f"regexp_replace({s}, '[(),;:|/]+', ' ', 'g')"
    s = unit(s, SING)
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


HEADERS = "hd AS (SELECT p_partkey, p_brand AS file, p_type AS sheet, CAST(p_partkey // 25 AS BIGINT) AS row, p_size AS col, upper(p_name) || ([" + ", ".join(f"'{u}'" for u in UNITS) + "])[p_size % 6 + 1] AS text FROM part)"


def headers(s, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("p_size") % 6 + 1).cast("int"))
    return table(s, d, "part").select(
        "p_partkey", F.col("p_brand").alias("file"), F.col("p_type").alias("sheet"), F.floor(F.col("p_partkey") / 25).alias("row"), F.col("p_size").alias("col"),
        F.concat(F.upper("p_name"), unit).alias("text"))


@register("s05_clean_column_names", f"WITH {HEADERS} SELECT {B('p_partkey')}, text, {clean_sql('text')} AS name FROM hd")
def _(s, d):
    return headers(s, d).select("p_partkey", "text", sheets.clean_name(F.col("text")).alias("name"))


KEYS6 = ("ring", "red widget", "bolt")


@register("s06_find_sheet", f"""WITH sh AS (SELECT p_brand AS file, p_name AS sheet, min(p_partkey) AS sheet_no FROM part GROUP BY 1, 2),
 sc AS (SELECT *, greatest({", ".join(f"CASE WHEN contains(replace(lower(sheet), ' ', ''), '{k.replace(' ', '')}') THEN {len(k.replace(' ', ''))} ELSE 0 END" for k in KEYS6)}) AS score FROM sh),
 sb AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, sheet_no) AS k FROM sc WHERE score > 0) SELECT file, sheet, {B('sheet_no', 'score')} FROM sb WHERE k = 1""")
def _(s, d):
    t = table(s, d, "part").groupBy(F.col("p_brand").alias("file"), F.col("p_name").alias("sheet")).agg(F.min("p_partkey").alias("sheet_no"))
    return sheets.find_sheets(t, KEYS6)


HIT = " OR ".join(f"(nm = '{k}' OR (contains(nm, '{k}') AND length(nm) <= {len(k) + 3}))" for k in ("red", "small ring", "bolt"))


@register("s07_header_rows", f"WITH {HEADERS}, hc AS (SELECT *, {clean_sql('text')} AS nm FROM hd) SELECT file, sheet, {B('coalesce(min(CASE WHEN row < 15 AND (' + HIT + ') THEN row END), -1) AS header_row')} FROM hc GROUP BY 1, 2")
def _(s, d):
    return sheets.header_rows(headers(s, d), ("red", "small ring", "bolt"))


# cells of a data sheet: the order key is the row; price, status and priority are its columns
CELL8 = """ce AS (SELECT o_orderpriority AS file, o_orderstatus AS sheet, o_orderkey AS row, unnest([0, 1, 2, 3]) AS col, unnest(['Год', 'Расход Q, м³/с', 'note', 'Базовый расход, м³/с']) AS name,
  unnest([CAST(year(o_orderdate) AS VARCHAR), CAST(o_totalprice AS VARCHAR), o_orderstatus, CAST(o_custkey AS VARCHAR)]) AS text FROM orders)"""


@register("s08_numeric_columns", f"""WITH {CELL8}, cc AS (SELECT file, sheet, col, name, count(TRY_CAST(text AS DOUBLE)) AS numbers FROM ce GROUP BY ALL HAVING count(TRY_CAST(text AS DOUBLE)) >= 3),
 cs AS (SELECT *, greatest(CASE WHEN contains(lower(name), 'расход') THEN 6 ELSE 0 END, CASE WHEN contains(lower(name), 'базовый') THEN 7 ELSE 0 END) AS score, contains(lower(name), 'год') AS yr FROM cc),
 cr AS (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY CASE WHEN score > 0 THEN 2 WHEN NOT yr THEN 1 ELSE 0 END DESC, score DESC, col) AS k FROM cs) SELECT file, sheet, {B('col')}, name FROM cr WHERE k = 1""")
def _(s, d):
    names = F.array(*[F.lit(x) for x in ("Год", "Расход Q, м³/с", "note", "Базовый расход, м³/с")])
    texts = F.array(F.year("o_orderdate").cast("string"), F.col("o_totalprice").cast("string"), F.col("o_orderstatus"), F.col("o_custkey").cast("string"))
    c = table(s, d, "orders").select(
        F.col("o_orderpriority").alias("file"), F.col("o_orderstatus").alias("sheet"), F.col("o_orderkey").alias("row"), F.posexplode(F.arrays_zip(names.alias("name"), texts.alias("text"))).alias("col", "x"))
    return sheets.numeric_columns(c.select("file", "sheet", "row", "col", F.col("x").getField("name").alias("name"), F.col("x").getField("text").alias("text")), ("расход", "базовый"))


@register("s09_merge_post", with_views("annual", "forcing") + f""", a AS (SELECT post, t, value AS base FROM annual), b AS (SELECT CASE post WHEN 'AF' THEN '1-URGENT' WHEN 'NO' THEN '5-LOW' ELSE post END AS post, t + 1890 AS t, p / 10 AS extra FROM forcing)
 SELECT coalesce(a.post, b.post) AS post, {B('coalesce(a.t, b.t) AS t')}, {R('base', 'extra')} FROM a FULL JOIN b ON a.post = b.post AND a.t = b.t""")
def _(s, d):
    a = view(s, d, "annual").select("post", "t", F.col("value").alias("base"))
    post = F.when(F.col("post") == "AF", "1-URGENT").when(F.col("post") == "NO", "5-LOW").otherwise(F.col("post"))
    b = view(s, d, "forcing").select(post.alias("post"), (F.col("t") + 1890).alias("t"), (F.col("p") / 10).alias("extra"))
    return sheets.merge_post(a, b, ["post", "t"])


@register("s12_granularity", with_views("daily", "annual") + f""", u AS (SELECT 'daily ' || post AS source, year(DATE '1970-01-01' + CAST(t AS INTEGER)) AS year FROM daily UNION ALL SELECT 'annual ' || post, t FROM annual)
 SELECT source, {B('count(DISTINCT year) AS years', 'count(*) AS "rows"')}, CASE WHEN count(DISTINCT year) >= 3 AND count(DISTINCT year) >= 0.8 * count(*) THEN 'annual' ELSE 'daily' END AS kind FROM u GROUP BY 1""")
def _(s, d):
    from hydrosheaf.operators.flow import day

    a = view(s, d, "daily").select(F.concat(F.lit("daily "), F.col("post")).alias("source"), F.year(day(F.col("t"))).cast("bigint").alias("year"))
    b = view(s, d, "annual").select(F.concat(F.lit("annual "), F.col("post")).alias("source"), F.col("t").alias("year"))
    return sheets.granularity(a.unionByName(b))
