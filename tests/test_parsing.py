"""Cells of quotes and texts of documents against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from offerlens.functions import parsing, strings
from offerlens.operators import chunks


def values(spark, function, cells):
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, v string").select("i", function(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows)]


@pytest.mark.parametrize(
    "function, wanted",
    [
        (parsing.locale_number, {"1 234,56 руб.": 1234.56, "1,234.56": 1234.56, "1.234,56": 1234.56, "12.345.678": 12345678.0, "12,345": 12345.0, "0,5": 0.5, "-17.5": -17.5, "n/a": None, "": None, None: None, "1 500 USD": 1500.0}),
        (parsing.first_number, {"12 345,5 руб": 12345.5, "от 30 до 45": 30.0, "x": None, None: None}),
        (lambda v: parsing.digits(v, 4), {"15 дней": 15, "12345": 1234, "": None, None: None}),
        (parsing.vat_rate, {"НДС 20%": 20.0, "7,5 %": 7.5, "без НДС": 0.0, "Without VAT": 0.0, "-": None}),
        (parsing.currency, {"100 руб": "RUB", "5 ₽": "RUB", "$7": "USD", "9 eur": "EUR", "9": None}),
        (parsing.yes_no, {"Да, включено": True, "нет": False, "pending": False, "?": None, "": None}),
        (parsing.phone, {"8 (495) 123-45-67": "+7 495 123-45-67", "+7 495 1234567": "+7 495 123-45-67", "4951234567": "+7 495 123-45-67", "12-34": "12-34", " ": None, None: None}),
        (parsing.canonical_signal, {" Щит учёта-1 ": "SCHIT_UCHETA_1", "": "", None: None}),
        (lambda v: parsing.header_name(parsing.header(v)), {"Цена за ед.": "unit_price", "Кол-во": "quantity", "№": None, "Наименование товара": "name", "": None, None: None}),
        (parsing.iso_date, {"2024-03-15T09:30:00+03:00": "15.03.2024 09:30:00 +03:00", "2024-01-02": "02.01.2024", "02.01.2024": "02.01.2024"}),
        (parsing.company, {'ООО "Ромашка"': "ромашка", None: None}),
        (strings.normal_title, {"Кабель ВВГнг(А) 3х1,5 / 100": "кабель ввгнг а 3х1 5 / 100"}),
        (strings.normal_url, {"HTTP://www.X.org": "http://x.org/", "https://x.org/a/?UTM_Source=1&b=2&from=z#f": "https://x.org/a?b=2"}),
        (strings.decimal_of, {"1 234,50 ₽": pytest.approx(1234.5), "abc": None, "1.2.3": None}),
        (strings.is_private, {"http://127.0.0.1/a": True, "http://127.0.0.2/": False, "http://[::1]:80/": True, "http://172.31.1.1": True, "http://172.32.1.1": False, "ftp://a.b": True, "https://a.b": False}),
    ],
)
def test_cells(spark, function, wanted):
    got = values(spark, function, list(wanted))
    assert [float(x) if type(x).__name__ == "Decimal" else x for x in got] == list(wanted.values())


def test_chunks_overlap_and_end_at_words(spark):
    text = ". ".join(f"Sentence number {i} has some words in it" for i in range(120))
    found = list(chunks.spans(text, 300, 50, 40))
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(e - s <= 300 and len(p) >= 40 and p == text[s:e].strip() for s, e, p in found)
    assert all(a[1] - 50 <= b[0] <= a[1] for a, b in zip(found, found[1:]))
    assert list(chunks.spans("too short")) == []


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 200), (4, "word\n \n" * 200), (5, "x" * 4000)], "doc_id long, text string")
    rows = chunks.chunked(docs, "doc_id", "text", size=400, overlap=0, least=100).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {3, 4, 5} and [r.text for r in by[3]] == [r.text for r in by[4]]
    assert all([r.chunk_index for r in v] == list(range(len(v))) and len({r.text_hash for r in v}) == len(v) for v in by.values())
    old = chunks.chunked(docs.filter("doc_id = 3"), "doc_id", "text", size=400, overlap=0, least=100)
    new = chunks.chunked(docs.filter("doc_id <= 3").replace({"word " * 200: "other " * 200}, subset="text"), "doc_id", "text", size=400, overlap=0, least=100)
    assert chunks.new_chunks(old, old).count() == 0
    assert {r.text for r in chunks.upserted(old, new).collect()} >= {r.text for r in new.collect()}
