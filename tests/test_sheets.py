import zipfile

import pandas as pd
from pyspark.sql import functions as F

from hydrosheaf.sources import sheets as sh


def column(k):
    return chr(65 + k)


def write_xlsx(path, book):
    """A minimal workbook: {sheet: {(row, col): value}} with inline strings."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        names = list(book)
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                   + "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   + "".join(f'<Relationship Id="rId{k + 1}" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(names))) + "</Relationships>")
        for k, n in enumerate(names):
            rows = {}
            for (r, c), v in book[n].items():
                rows.setdefault(r, []).append((c, v))
            xml = ""
            for r in sorted(rows):
                cells = ""
                for c, v in sorted(rows[r]):
                    ref = f"{column(c)}{r + 1}"
                    cells += f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{esc(v)}</t></is></c>'
                xml += f'<row r="{r + 1}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {ns}><sheetData>{xml}</sheetData></worksheet>")


def test_clean_names(spark):
    want = {"H, м": "h", "Q, м³/с": "q", "Расход Q, м³/с": "расход q", "Базовый сток, м³/с": "базовый сток", "Год": "год",
            "Осадки, мм/год": "осадки", "Q_max, м³/с": "q_max", "Qэкологический, м³/с": "qэкологический"}
    df = spark.createDataFrame([(k,) for k in want], "n string").withColumn("c", sh.clean_name(F.col("n")))
    assert {r.n: r.c for r in df.collect()} == want


def test_find_sheet(spark):
    names = ["Данные", "КриваяQH", "Работа8 (FDC)", "Работа10"]
    df = spark.createDataFrame([("f", n, k) for k, n in enumerate(names)], "file string, sheet string, sheet_no int")
    pick = lambda *k: sh.find_sheets(df, k).first().sheet
    assert pick("Работа8", "FDC", "Кривая") == "Работа8 (FDC)"
    assert pick("Кривая", "КриваяQH", "H-Q") == "КриваяQH"
    assert pick("Работа10", "Экология", "Базовый") == "Работа10"


def test_workbook_to_tidy(spark, tmp_path):
    book = {
        "Данные": {(0, 0): "Название", (2, 0): "Год", (2, 1): "Ангара", **{(3 + k, 0): 2000 + k for k in range(4)}, **{(3 + k, 1): 10.5 + k for k in range(4)}},
        "Работа10": {(0, 0): "Экология", (2, 0): "Год", (2, 1): "Базовый сток, м³/с", **{(3 + k, 0): 1980 + k for k in range(3)}, (3, 1): 79.1, (4, 1): 84.8, (5, 1): 46.0},
    }
    write_xlsx(tmp_path / "a.xlsx", book)
    write_xlsx(tmp_path / "b.xlsx", {"Данные": book["Данные"]})
    cells = sh.read_workbooks(spark, str(tmp_path)).cache()
    head = {(r.file[-6:], r.sheet): r.header_row for r in sh.header_rows(cells).collect()}
    assert head == {("a.xlsx", "Данные"): 2, ("a.xlsx", "Работа10"): 2, ("b.xlsx", "Данные"): 2}
    t = sh.ingest_workbooks(cells)
    base = t.filter((F.col("dataset") == "ecology") & (F.col("name") == "базовый сток")).orderBy("row").collect()
    assert [r.value for r in base] == [79.1, 84.8, 46.0]
    assert t.filter("dataset = 'posts'").select("file").distinct().count() == 2
    num = sh.numeric_columns(sh.body(cells, sh.header_rows(cells)), ("базовый", "сток")).filter("sheet = 'Работа10'").first()
    assert num.col == 1


def test_gauge_workbooks_both_layouts(spark, tmp_path):
    rows = [("Ob", "G1", 2000 + k, 5.0 + k) for k in range(4)] + [("Ob", "G1", 2001, 99.0), ("Ob", "G2", 2000, 1.0), ("Ob", "G1", "bad", 3)]
    long = {(3, 0): "River", (3, 1): "Gauge", (3, 2): "Year", (3, 3): "Q"}
    for k, r in enumerate(rows):
        for c, v in enumerate(r):
            long[(4 + k, c)] = v
    per = {(0, 1): "Lena", (1, 1): "L7", (4, 0): 1990, (4, 1): 2.0, (5, 0): 1991, (5, 1): 3.0, (6, 0): 1992, (6, 1): 4.0}
    write_xlsx(tmp_path / "long.xlsx", {"S": long})
    write_xlsx(tmp_path / "per.xlsx", {"L": per})
    s = sh.gauge_series(sh.gauge_cells(sh.read_workbooks(spark, str(tmp_path))))
    got = {r.post: (r.n, r.period) for r in sh.gauge_summary(s).collect()}
    assert got == {"Ob_G1": (4, "2000-2003"), "Lena_L7": (3, "1990-1992")}
    assert s.filter("post = 'Ob_G1' and t = 2001").first().value == 6.0


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "y.txt").write_text("Годы\t1\t2\n2000\t1.5\t\n2001\tx\t2\n2002\t3\t4\n", encoding="utf-8")
    got = sh.read_tab_years(spark, str(tmp_path / "y.txt"), ["a", "b"]).orderBy("t", "post").collect()
    assert [(r.post, r.t, r.value) for r in got] == [("a", 2000, 1.5), ("b", 2000, None), ("a", 2002, 3.0), ("b", 2002, 4.0)]
    pd.DataFrame({"Год": [1, 2, 3], "Q": [4.0, 5.0, 6.0], "note": ["u", "v", "w"]}).to_csv(tmp_path / "d.csv", index=False)
    w = spark.read.csv(str(tmp_path / "d.csv"), header=True)
    assert sh.load_wide(w) == ("Год", ["Q"])
    s = sh.to_series(w, "Год", ["Q"])
    sh.write_tsv(s, str(tmp_path / "out.tsv"))
    assert spark.read.csv(str(tmp_path / "out.tsv"), sep="\t", header=True).count() == 3
    sh.write_report({"source": s, "stats": s.groupBy("post").count()}, str(tmp_path / "rep"), "post")
    assert spark.read.parquet(str(tmp_path / "rep" / "source")).count() == 3


def test_daily_csv_takes_the_column_of_the_value(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    for post, shift in (("north", 0), ("south", 100)):
        lines = ["Дата,H,Q м3/с,note"] + [f"2001-01-{k:02d},{k},{k + shift + 0.5},n{k}" for k in range(1, 8)] + ["2001-01-08,1,bad,x", "no day,2,5,x"]
        (tmp_path / "csv" / f"{post}.csv").write_text("\n".join(lines), encoding="utf-8")
    got = sorted(tuple(r) for r in sh.read_daily_csv(spark, str(tmp_path / "csv")).collect())
    want = [(p, 11322 + k, k + s + 0.5 if k < 8 else None) for p, s in (("north", 0), ("south", 100)) for k in range(1, 9)]
    assert got == want
    (tmp_path / "plain.csv").write_text("name;a`b;year\n" + "\n".join(f"x;{k};{1990 + k}" for k in range(4)))
    got = sorted(tuple(r) for r in sh.read_daily_csv(spark, str(tmp_path / "plain.csv"), ";").collect())
    assert got == [("plain", 1990 + k, float(k)) for k in range(4)]
    (tmp_path / "bare.csv").write_text("a,level\n" + "\n".join(f"x,{k}" for k in (5, 3, 4)))
    assert sorted(tuple(r) for r in sh.read_daily_csv(spark, str(tmp_path / "bare.csv")).collect()) == [("bare", 1, 5.0), ("bare", 2, 3.0), ("bare", 3, 4.0)]
    (tmp_path / "none.csv").write_text("a,b\nx,1\ny,2")
    assert sh.read_daily_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_daily_workbook_takes_the_same_column(spark, tmp_path):
    head = {(2, 0): "Год", (2, 1): "H, м", (2, 2): "Q, м3/с"}
    rows = {(3 + k, c): v for k in range(5) for c, v in enumerate((2000 + k, 1 + k, 10.5 + k))}
    write_xlsx(tmp_path / "post.xlsx", {"Данные": {(0, 0): "x"}, "Работа8": {(0, 0): "Таблица"} | head | rows})
    write_xlsx(tmp_path / "bare.xlsx", {"Sheet": {(0, 0): "q"} | {(1 + k, 0): 3 * k for k in range(4)}})
    cells = sh.read_workbooks(spark, str(tmp_path / "*.xlsx"))
    got = sorted(tuple(r) for r in sh.daily_of_cells(cells).collect())
    assert got == [("bare", 1 + k, 3.0 * k) for k in range(4)] + [("post", 2000 + k, 10.5 + k) for k in range(5)]
