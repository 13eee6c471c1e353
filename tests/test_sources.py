"""Cells of files in mixed encodings and dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.plans import files as plan
from offerlens.sources import cells

FILES = {
    "a.csv": "name,qty\r\n\"pipe, long\",3\r\n\"two\nlines\",4\r\n".encode("utf-8-sig"),
    "b.csv": "Коммерческое предложение;;;\n;;;\n№;Товар;Кол-во;Цена за ед.\n1;Кабель ВВГ;1 200;15,50 руб.\n;;;\n2;Труба;3;\n3;;;\n;;;\n;;;\n;;;\n;;;\n4;After the end;1;1\n".encode("cp1251"),
    "sub/c.csv": "Наименование\tСумма\nщит\t1,234.50\n".encode(),
    "d.csv": b"",
    "e.csv": b"\x98\xff;\x98\n1;2\n",
    "f.txt": b"not a table",
}


def folder(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_cells(spark, tmp_path):
    c = cells.read_cells(spark, folder(tmp_path)).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    got = {(r.file, r.row): r.cells for r in c.collect()}
    assert [got["a.csv", i] for i in (1, 2, 3)] == [["name", "qty"], ["pipe, long", "3"], ["two\nlines", "4"]]
    assert got["b.csv", 4] == ["1", "Кабель ВВГ", "1 200", "15,50 руб."] and got["c.csv", 2] == ["щит", "1,234.50"]
    assert {r.file: r.encoding for r in c.collect()} == {"a.csv": "utf-8-sig", "b.csv": "cp1251", "c.csv": "utf-8-sig", "e.csv": "replaced"}
    assert ("d.csv", 1) not in got and got["e.csv", 2] == ["1", "2"]


def test_headers_and_items(spark, tmp_path):
    c = cells.read_cells(spark, folder(tmp_path)).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    h = cells.header_rows(c)
    assert {r.file: (r.header_row, r.score, r["at"]) for r in h.collect()} == {
        "a.csv": (1, 5, {"name": 0, "quantity": 1}),
        "b.csv": (3, 8, {"name": 1, "quantity": 2, "unit_price": 3}),
        "c.csv": (1, 6, {"name": 0, "total_price": 1}),
    }
    got = sorted((r.file, r.row, r.name, r.quantity, r.unit_price, r.total_price, r.confidence) for r in cells.items(c, h).collect())
    assert got == [
        ("a.csv", 2, "pipe, long", 3.0, None, None, 0.7),
        ("a.csv", 3, "two\nlines", 4.0, None, None, 0.7),
        ("b.csv", 4, "Кабель ВВГ", 1200.0, 15.5, 18600.0, 0.9),
        ("b.csv", 6, "Труба", 3.0, None, None, 0.7),
        ("c.csv", 2, "щит", None, None, 1234.5, 0.75),
    ]
    assert cells.items(c.limit(0), h).count() == 0


def test_a_file_of_many_rows_and_long_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name|qty\n" + "".join(f"item {i}|{i}\n" for i in range(20_000)) + "y" * 300_000 + "|1\n")
    c = cells.read_cells(spark, str(tmp_path))
    assert c.count() == 20_002 and c.agg(F.max("row")).first()[0] == 20_002
    assert cells.items(c, cells.header_rows(c)).count() == 20_001


def test_vendor_rows(spark):
    rows = [
        ("f", 2, {"legal_name": " ООО А ", "inn": "ИНН 77 01", "website": "WWW.Shop.example/a/?q", "email": " A@B.ru ", "phone": "8 (495) 123-45-67"}),
        ("f", 3, {"display_name": "Б", "inn": ""}),
        ("f", 4, {"legal_name": " ", "inn": "7702"}),
        ("g", 2, {"legal_name": "В", "inn": "7701", "phone": "12"}),
    ]
    df = spark.createDataFrame(rows, "file string, row long, fields map<string,string>")
    got = {(r.file, r.row): r for r in plan.imported(df, F.lit("list")).collect()}
    a = got["f", 2]
    assert (a.key, a.action, a.website, a.email, a.phone) == ("7701", "created", "https://shop.example/a", "a@b.ru", "+7 495 123-45-67")
    assert got["f", 3].key.startswith("NOINN-") and got["f", 3].synthetic and got["f", 3].legal_name == "Б"
    assert (got["f", 4].action, got["g", 2].action, got["g", 2].phone) == ("skipped", "updated", "12")


def test_files_of_all_dialects_in_one_pass(spark, tmp_path):
    texts = ["plain", 'a "quote"', "a,b;c\td", " spaced ", "", "Цена №1", "two\nlines"]
    rows = [(f, i, x, y) for f in range(5) for i, (x, y) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True))] + [(1, 99, "末", "x")]
    df = spark.createDataFrame(rows, "file long, pos int, a string, b string").repartition(3)
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    cells.write_files(df, str(tmp_path / "out"), "file", ["pos"], ((",", "UTF-8"), (";", "windows-1251"), ("\t", "UTF-8")))
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before
    c = cells.read_cells(spark, str(tmp_path / "out"), "*.txt").withColumn("file", F.regexp_extract("file", "file=([0-9]+)", 1).cast("long"))
    got = {f: [tuple(r.cells) for r in c.filter(F.col("file") == f).orderBy("row").collect()] for f in range(5)}
    want = {f: [(x, y) for g, _, x, y in rows if g == f] for f in range(5)}
    want[1][-1] = ("?", "x")  # CP1251 has no such sign
    assert got == want
    assert {(r.file, r.encoding) for r in c.select("file", "encoding").distinct().collect()} == {(f, "cp1251" if f in (1, 4) else "utf-8-sig") for f in range(5)}


def test_quotes_are_read_once(spark, monkeypatch):
    from offerlens.plans import QUERIES

    seen, header_rows = [], cells.header_rows
    monkeypatch.setattr(cells, "header_rows", lambda c: seen.append(c) or header_rows(c))
    assert QUERIES["scan_spreadsheet_multisheet"](spark, "/root/testdata/sf0.001").count() > 0
    assert all(f.endswith(".parquet") for f in seen[0].inputFiles())
