"""Tables and workbooks to tidy series, and results to files.

A workbook becomes rows of the cell table (file, sheet, sheet_no, row, col, text): one task per
file, a file being the unit a person can open.  Everything after that is column work.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "file string, sheet string, sheet_no int, row int, col int, text string"
YEAR_NAMES = ("год", "year", "years", "дата", "date")
DAILY_NAMES = ("q", "расход", "value")          # preferred names of a daily value
DAILY_SHEETS = ("Работа8", "FDC", "Кривая")     # keywords of its sheet

# fixed values: units removed from column names, compound ones first
COMPOUND_UNITS = ("мм/год", "м3/с", "м/с", "л/с", "км2/с", "m3/s", "m/s")
SINGLE_UNITS = ("м3", "мм", "см", "км2", "км", "л", "м", "с", "m3", "mm", "m")

# fixed values: sheet keywords of the template's datasets
DATASETS = {
    "posts": ("Данные", "Гидропост", "Лист1"),
    "annual": ("Норма годового стока", "Работа1"),
    "monthly": ("Внутригодовое распределение", "Работа2"),
    "minimum": ("Минимальный сток", "Работа3"),
    "maximum": ("Максимальный сток", "Работа4"),
    "rating": ("КриваяQH", "Кривая"),
    "ice": ("Ледовые явления", "Работа5"),
    "balance": ("Водный баланс", "Работа6"),
    "catchment": ("Ливневый сток", "Работа7"),
    "duration": ("FDC", "Работа8"),
    "structure": ("Гидротехнические расчёты", "Работа9"),
    "ecology": ("Экология и базовый сток", "Работа10"),
}


# --- wide tables ----------------------------------------------------------------------------
def load_wide(df: DataFrame) -> tuple[str, list[str]]:
    """Year column (by name, else the first) and the columns that read fully as numbers."""
    names = df.columns
    year = next((c for c in names if c.strip().lower() in YEAR_NAMES), names[0])
    others = [c for c in names if c != year]
    text = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    bad = df.agg(*[F.count_if((text(c) != "") & F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)").isNull()).alias(f"c{j}") for j, c in enumerate(others)])
    row = bad.first()  # one row, one number per column
    return year, [c for j, c in enumerate(others) if row[j] == 0]


def to_series(df: DataFrame, year: str, posts: list[str]) -> DataFrame:
    """Wide table to (post, t, value); cells that are not numbers become null."""
    num = lambda c, t: F.expr(f"try_cast(trim(cast(`{c}` as string)) as {t})")
    wide = df.select(num(year, "bigint").alias("t"), *[num(c, "double").alias(c) for c in posts])
    return wide.unpivot(["t"], posts, "post", "value").select("post", "t", "value")


def series_of(series: DataFrame, post: str) -> DataFrame:
    return series.filter((F.col("post") == post) & F.col("value").isNotNull() & F.col("t").isNotNull())


def _time(text: Column) -> Column:
    """A whole number, or the days of a date since 1970."""
    return F.coalesce(text.try_cast("bigint"), F.unix_date(text.try_cast("date")))


def read_daily_csv(spark: SparkSession, path: str, sep: str = ",", prefer=DAILY_NAMES) -> DataFrame:
    """Daily values of csv files of one header: (post, t, value), a post being a file without its ending.

    One pass counts the numbers of every column; then the chosen column alone is read, with that of the year
    or date.  Without such a column ``t`` is the number of the row in its file, from 1.  Cells that are no
    numbers are null values; files without a column of three numbers give no rows.
    """
    wide = spark.read.csv(path, header=True, sep=sep)
    names = wide.columns
    text = lambda c: F.trim(F.col("`" + c.replace("`", "``") + "`"))
    counts = wide.agg(*[F.count(text(c).try_cast("double")).alias(f"c{j}") for j, c in enumerate(names)]).first()
    found = spark.createDataFrame([("", "", j, c, counts[j]) for j, c in enumerate(names)], "file string, sheet string, col int, name string, numbers bigint") if names else None
    best = _chosen(found, prefer).first() if names else None
    if best is None:
        return spark.createDataFrame([], "post string, t bigint, value double")
    year = next((c for c in names if c.strip().lower() in YEAR_NAMES and c != best["name"]), None)
    file = F.col("_metadata.file_name")
    rows = wide.select(F.regexp_replace(file, r"\.[^.]*$", "").alias("post"), text(names[best["col"]]).try_cast("double").alias("value"),
                       *([_time(text(year)).alias("t")] if year else []), F.monotonically_increasing_id().alias("_at"))
    if not year:                    # a file is the unit a person can open
        rows = rows.withColumn("t", F.row_number().over(Window.partitionBy("post").orderBy("_at")).cast("bigint"))
    return rows.filter(F.col("t").isNotNull()).select("post", "t", "value")


def daily_of_cells(cells: DataFrame, prefer=DAILY_NAMES, keywords=DAILY_SHEETS) -> DataFrame:
    """Daily values of workbooks as cells: (post, t, value), a post being a file without folder and ending.

    The sheet is the one its keywords name, else the first; its header the row of a year or value name, else
    the first row; the column that of the same choice as in csv files.
    """
    sheets = cells.select("file", "sheet", "sheet_no").distinct()
    first = sheets.groupBy("file").agg(F.min(F.struct("sheet_no", "sheet")).alias("f"))
    chosen = first.join(find_sheets(sheets, keywords).select("file", F.col("sheet").alias("s")), "file", "left").select("file", F.coalesce("s", "f.sheet").alias("sheet"))
    mine = cells.join(chosen, ["file", "sheet"], "left_semi")
    header = header_rows(mine, (*YEAR_NAMES, *prefer)).withColumn("header_row", F.greatest("header_row", F.lit(0)))
    rows = body(mine, header)
    value = rows.join(numeric_columns(rows, prefer).select("file", "sheet", "col"), ["file", "sheet", "col"]).select(
        "file", "row", F.trim("text").try_cast("double").alias("value"))
    times = rows.filter(F.lower(F.trim("name")).isin(*YEAR_NAMES)).groupBy("file", "row").agg(F.min(F.struct("col", _time(F.trim("text")).alias("t"))).alias("b")).select("file", "row", F.col("b.t").alias("t"))
    dated = times.filter(F.col("t").isNotNull()).select("file").distinct().withColumn("dated", F.lit(True))
    at = F.row_number().over(Window.partitionBy("file").orderBy("row")).cast("bigint")
    d = value.withColumn("_at", at).join(times, ["file", "row"], "left").join(dated, "file", "left")
    d = d.withColumn("t", F.when(F.col("dated"), F.col("t")).otherwise(F.col("_at")))
    return d.filter(F.col("t").isNotNull()).select(F.regexp_replace(F.regexp_replace("file", ".*/", ""), r"\.[^.]*$", "").alias("post"), "t", "value")


def read_tab_years(spark: SparkSession, path: str, posts: list[str]) -> DataFrame:
    """Tab text of a year and one column per post; header and broken lines drop out."""
    lines = spark.read.text(path)
    parts = F.split("value", "\t")
    num = lambda j, t: F.expr(f"try_cast(trim(get(_p, {j})) as {t})")
    d = lines.withColumn("_p", parts).withColumn("t", num(0, "bigint")).filter(F.col("t").isNotNull())
    bad = [(F.trim(F.coalesce(F.get("_p", F.lit(j + 1)), F.lit(""))) != "") & num(j + 1, "double").isNull() for j in range(len(posts))]
    for b in bad:
        d = d.filter(~b)
    wide = d.select("t", *[num(j + 1, "double").alias(p) for j, p in enumerate(posts)])
    return wide.unpivot(["t"], posts, "post", "value").select("post", "t", "value")


def merge_post(wide: DataFrame, extra: DataFrame, on: str | list[str] = "t") -> DataFrame:
    """Full outer merge of another table on the year, or on post and year."""
    return wide.join(extra, on, "full")


def granularity(df: DataFrame) -> DataFrame:
    """annual when there are at least three distinct years and 0.8 distinct years per row."""
    g = df.groupBy("source").agg(F.countDistinct("year").alias("years"), F.count(F.lit(1)).alias("rows"))
    return g.withColumn("kind", F.when((F.col("years") >= 3) & (F.col("years") >= 0.8 * F.col("rows")), "annual").otherwise("daily"))


def gauge_series(rows: DataFrame, order: str = "row") -> DataFrame:
    """(river, gauge, year, q) rows: first value of a year, series of three years and more."""
    d = rows.filter(F.col("year").isNotNull() & F.col("q").isNotNull())
    one = d.groupBy("river", "gauge", "year").agg(F.min(F.struct(order, "q")).alias("_b"))
    one = one.select("river", "gauge", F.concat_ws("_", "river", "gauge").alias("post"), F.col("year").cast("bigint").alias("t"), F.col("_b.q").alias("value"))
    keep = one.groupBy("post").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 3)
    return one.join(keep.select("post"), "post", "left_semi")


def gauge_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("post").agg(
        F.count(F.lit(1)).alias("n"), F.concat_ws("-", F.min("t").cast("string"), F.max("t").cast("string")).alias("period"))


# --- names ----------------------------------------------------------------------------------
_EDGE = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")


def clean_name(c: Column) -> Column:
    """Lower case without units: 'Расход Q, м³/с' -> 'расход q'."""
    s = F.translate(F.lower(F.trim(c)), "³²", "32")
    compound = "|".join(u.replace("/", r"\s*/\s*") for u in COMPOUND_UNITS)
    s = F.regexp_replace(s, f"{_EDGE[0]}({compound}){_EDGE[1]}", " ")
    s = F.regexp_replace(s, r"[(),;:|/]+", " ")
    s = F.regexp_replace(s, f"{_EDGE[0]}({'|'.join(SINGLE_UNITS)}){_EDGE[1]}", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _longest(text: Column, keywords) -> Column:
    """Length of the longest keyword contained in the text, zero if none."""
    hits = [F.when(text.contains(k), F.lit(len(k))).otherwise(F.lit(0)) for k in keywords]
    return F.greatest(*hits) if len(hits) > 1 else hits[0]


def find_sheets(sheets: DataFrame, keywords) -> DataFrame:
    """Per file the sheet with the longest keyword, the earliest on a tie (file, sheet, sheet_no)."""
    keys = [k.strip().lower().replace(" ", "") for k in keywords if k.strip()]
    plain = F.regexp_replace(F.lower("sheet"), " ", "")
    d = sheets.withColumn("score", _longest(plain, keys)).filter(F.col("score") > 0)
    best = d.groupBy("file").agg(F.max(F.struct("score", (-F.col("sheet_no")).alias("k"), "sheet")).alias("b"))
    return best.select("file", F.col("b.sheet").alias("sheet"), (-F.col("b.k")).alias("sheet_no"), F.col("b.score").alias("score"))


def header_rows(cells: DataFrame, keys=("год", "year", "years"), max_scan: int = 15) -> DataFrame:
    """First row below ``max_scan`` with a cell that is a key, or holds one and little more; else -1."""
    name = clean_name(F.col("text"))
    hit = F.lit(False)
    for k in keys:
        hit = hit | (name == k) | (name.contains(k) & (F.length(name) <= len(k) + 3))
    near = (F.col("row") < max_scan) & hit & (name != "")
    return cells.groupBy("file", "sheet").agg(F.coalesce(F.min(F.when(near, F.col("row"))), F.lit(-1)).alias("header_row"))


def body(cells: DataFrame, header: DataFrame) -> DataFrame:
    """Cells below the header row with their column name: (file, sheet, row, col, name, text)."""
    d = cells.join(header.filter(F.col("header_row") >= 0), ["file", "sheet"])
    names = d.filter(F.col("row") == F.col("header_row")).select("file", "sheet", "col", F.col("text").alias("name"))
    return d.filter(F.col("row") > F.col("header_row")).drop("header_row").join(names, ["file", "sheet", "col"])


def numeric_columns(cells: DataFrame, prefer=("value", "q", "расход")) -> DataFrame:
    """Chosen column per (file, sheet): preferred name, else numeric and not a year, else numeric."""
    count = F.count(F.expr("try_cast(trim(text) as double)"))
    return _chosen(cells.groupBy("file", "sheet", "col", "name").agg(count.alias("numbers")), prefer)


def _chosen(counts: DataFrame, prefer) -> DataFrame:
    """The column of each sheet from the counts of numbers per column."""
    name = clean_name(F.col("name"))
    d = counts.filter(F.col("numbers") >= 3)
    score = _longest(name, [p.lower() for p in prefer])
    year = name.contains("год") | name.contains("year")
    rank = F.when(score > 0, F.lit(2)).when(~year, F.lit(1)).otherwise(F.lit(0))
    d = d.withColumn("_b", F.struct(rank.alias("r"), score.alias("s"), (-F.col("col")).alias("c"), "name"))
    return d.groupBy("file", "sheet").agg(F.max("_b").alias("b")).select("file", "sheet", (-F.col("b.c")).alias("col"), F.col("b.name").alias("name"))


# --- workbooks ------------------------------------------------------------------------------
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_cells(content: bytes) -> list[tuple]:
    """(sheet, sheet_no, row, col, text) of every filled cell of an xlsx file."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().iter(_NS + "si"):
                shared.append("".join(t.text or "" for t in si.iter(_NS + "t")))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        book = ElementTree.parse(z.open("xl/workbook.xml")).getroot()
        for no, sh in enumerate(book.iter(_NS + "sheet")):
            target = rels[sh.get(_REL)].lstrip("/")
            path = target if target.startswith("xl/") else "xl/" + target
            for c in ElementTree.parse(z.open(path)).getroot().iter(_NS + "c"):
                kind, v = c.get("t"), c.find(_NS + "v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(_NS + "t"))
                elif v is None or v.text is None:
                    continue
                else:
                    text = shared[int(v.text)] if kind == "s" else v.text
                ref = c.get("r")
                out.append((sh.get("name"), no, int(re.search(r"\d+", ref).group()) - 1, _column_number(ref), text))
    return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def parse(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = [(name, *r) for r in workbook_cells(content)]
                yield pd.DataFrame(rows, columns=["file", "sheet", "sheet_no", "row", "col", "text"])

    return files.mapInPandas(parse, CELLS)


def gauge_cells(cells: DataFrame) -> DataFrame:
    """River-gauge workbooks to rows: one long sheet (header River in A4) or a sheet per gauge (B1, B2)."""
    at = lambda r, c: F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.trim("text")))
    head = cells.filter((F.col("row") < 5)).groupBy("file", "sheet", "sheet_no").agg(
        at(3, 0).alias("a4"), at(0, 1).alias("b1"), at(1, 1).alias("b2"), F.count_if(F.col("row") == 4).alias("w5"))
    flag = head.groupBy("file").agg(F.max(F.when((F.col("sheet_no") == 0) & F.lower("a4").isin("river", "река") & (F.col("w5") >= 4), 1).otherwise(0)).alias("long"))
    v = lambda c: F.max(F.when(F.col("col") == c, F.trim("text")))
    rows = cells.filter(F.col("row") >= 4).groupBy("file", "sheet", "sheet_no", "row").agg(*[v(c).alias(f"c{c}") for c in range(4)])
    d = rows.join(head.drop("a4", "w5", "sheet_no"), ["file", "sheet"]).join(flag, "file")
    long = F.col("long") == 1
    num = lambda a, b, t: F.when(long, F.expr(f"try_cast({a} as {t})")).otherwise(F.expr(f"try_cast({b} as {t})"))
    d = d.select(
        F.when(long, F.col("c0")).otherwise(F.col("b1")).alias("river"), F.when(long, F.col("c1")).otherwise(F.col("b2")).alias("gauge"),
        num("c2", "c0", "double").cast("bigint").alias("year"), num("c3", "c1", "double").alias("q"), F.struct("file", "sheet_no", "row").alias("row"))
    return d.filter("river is not null and gauge is not null and river <> '' and gauge <> ''")


def ingest_workbooks(cells: DataFrame, datasets=None, header_keys=("год", "year", "years", "h", "q", "параметр")) -> DataFrame:
    """Route every sheet to a dataset: (dataset, file, sheet, row, name, text, value)."""
    datasets = datasets or DATASETS
    sheets = cells.select("file", "sheet", "sheet_no").distinct()
    chosen = None
    for name, keys in datasets.items():
        c = find_sheets(sheets, keys).select("file", "sheet", F.lit(name).alias("dataset"))
        chosen = c if chosen is None else chosen.unionByName(c)
    b = body(cells, header_rows(cells, header_keys))
    return b.join(chosen, ["file", "sheet"]).select(
        "dataset", "file", "sheet", "row", clean_name(F.col("name")).alias("name"), "text", F.expr("try_cast(trim(text) as double)").alias("value"))


# --- sinks ----------------------------------------------------------------------------------
def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path, sep="\t")


def write_report(tables: dict[str, DataFrame], path: str, partition: str | None = None) -> None:
    """A report is a folder of tables: info, statistics, curve, quantiles, source, ..."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if partition and partition in df.columns:
            w = w.partitionBy(partition)
        w.parquet(f"{path}/{name}")
