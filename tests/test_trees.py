"""XML and HTML of any shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.plans import notices
from offerlens.sources import trees


def test_nodes(spark):
    docs = [
        (1, '<a xmlns="u"><x:b xmlns:x="v" x:k="1">one<c> two </c>three</x:b><b/></a>'),
        (2, "<a><b>never closed</a>"),
        (3, None),
        (4, "  "),
        (5, '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'),
        (None, "<a>&lt;&#65;<![CDATA[<i>]]></a>"),
        (6, "<a>" * 3000 + "deep" + "</a>" * 3000),
    ]
    df = trees.nodes(spark.createDataFrame(docs, "id int, x string"), "id", "x", ("b",))
    got = {(r.id, r.node): r for r in df.collect()}
    assert [(r.tag, r.path, r.text, r.whole, r.scopes) for r in (got[1, i] for i in range(4))] == [
        ("a", "/a", "", "one two three", []),
        ("b", "/a/b", "one", "one two three", [1]),
        ("c", "/a/b/c", " two ", " two ", [1]),
        ("b", "/a/b", "", "", [3]),
    ]
    assert got[1, 1].attributes == {"k": "1"} and not got[2, None].ok and not got[5, None].ok
    assert {i for i, _ in got} == {1, 2, 5, 6, None} and got[None, 0].text == "<A<i>" and got[6, 2999].text == "deep"
    assert trees.nodes(spark.createDataFrame([], "id int, x string"), "id", "x").count() == 0


def test_first_values(spark):
    docs = [(1, "<r><b> </b><c>second</c><b>first</b><b>later</b><d>\n 5 \n</d></r>"), (2, "<r><d/></r>")]
    tree = trees.nodes(spark.createDataFrame(docs, "id int, x string"), "id", "x")
    got = {r.id: (r.f, r.g) for r in trees.first_values(tree, ["id"], {"f": ("b", "c"), "g": ("z", "d")}).collect()}
    assert got == {1: ("first", "5"), 2: (None, None)}


def test_html_pieces(spark):
    page = '<p>x</p><DIV id=1 class="a registry-entry b">one</DIV><div class="registry-entry__x">no</div><div class="registry-entry">two'
    rows = [(page, ['<DIV id=1 class="a registry-entry b">one</DIV><div class="registry-entry__x">no</div>', '<div class="registry-entry">two']), ('<div class="notice__item">n', ['<div class="notice__item">n']), ("<p>none</p>", []), ("", [])]
    df = spark.createDataFrame([(r[0],) for r in rows], "h string").select(trees.cards(F.col("h")).alias("c"))
    assert [r.c for r in df.collect()] == [r[1] for r in rows]
    pairs = '<div class="t">A :</div>\n<div class="v"> <b>1</b>&nbsp;2<span>3</span></div><div class="t">a</div><div class="v">other</div><div class="t"></div><div class="v">x</div>'
    assert spark.createDataFrame([(pairs,)], "h string").select(trees.label_pairs(F.col("h"), "t", "v")).first()[0] == {"a": "1 23"}
    times = [("05.03.2024 9:30 (МСК)", "2024-03-05 09:30:00"), ("2024-03-05", "2024-03-05 00:00:00"), ("31.02.2024", None), ("soon", None), (None, None)]
    got = spark.createDataFrame(times, "t string, w string").select(F.date_format(trees.public_time(F.col("t")), "yyyy-MM-dd HH:mm:ss"), "w").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_addresses_and_kinds(spark):
    rows = [("https://zakupki.gov.ru/a", True), ("http://x.ZAKUPKI.gov.ru:80/a", True), ("/files/1", True), ("//evil.example/x", False), ("https://zakupki.gov.ru.evil.example/", False), ("https://zakupki.gov.ru@evil.example/", False), ("ftp://zakupki.gov.ru/", False), (None, False)]
    got = spark.createDataFrame(rows, "u string, w boolean").select(notices.safe_url(F.col("u")).isNotNull(), "w").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    kinds = [("Обоснование НМЦК.xlsx", "estimate"), ("Техническое задание", "technical_specification"), ("Проект контракта", "contract_draft"), ("Форма заявки", "form"), ("scan.pdf", "attachment")]
    assert [r[0] for r in spark.createDataFrame([(k,) for k, _ in kinds], "n string").select(notices.attachment_kind(F.col("n"))).collect()] == [w for _, w in kinds]
