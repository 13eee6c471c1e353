"""Entity matching against sequential walks over the same rows."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from offerlens.functions import sources
from offerlens.plans import matching
from offerlens.plans.registry import Tables

DATA = Path("/root/testdata/sf0.001")


def test_words_contraries_and_scores(spark):
    rows = [
        ("Бикрост ТКП 4,5", "рулон бикрост", True),
        ("модуль питания", "Модуль управления", False),  # one word, and a generic one
        ("модуль питания", "модуль питания б/у", True),
        ("пластина грудной клетки", "пластина плечевая клетки", False),
        ("пластина лучевая", "пластина лучевая правая", True),
        ("образец ткани мягкой", "электрод для ткани мягкой", False),
        ("кот", "кот", False),
        (None, "бикрост", False),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").select("*", sources.compatible(sources.words(F.col("a")), sources.words(F.col("b"))).alias("got"))
    assert [r.got for r in df.collect()] == [r[2] for r in rows]
    q = spark.createDataFrame([("A b ", " a B", 2, 5.0, 5.0, "ШТ", "шт"), ("a", "b", 1, 0.0, 0.0, "", ""), ("a", "b", 1, None, 1.0, None, "x")], "n string, m string, o int, q double, r double, u string, v string")
    assert [r[0] for r in q.select(sources.match_score(*(F.col(c) for c in ("o", "n", "m", "q", "r", "u", "v")))).collect()] == [125, 10, 10]
    assert [r[0] for r in spark.createDataFrame([("шт.",), (" Рул",), ("усл. ед.",), ("КГ",), (None,)], "u string").select(sources.unit_name(F.col("u"))).collect()] == ["штука", "рулон", "условная единица", "кг", None]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_one_to_one_is_the_sequential_greedy(spark):
    t = Tables(spark, str(DATA))
    edges = [tuple(r) for r in matching.scored_pairs(t).select("case", "document", "fragment", "item", "position", "score").collect()]
    best = {}
    for e in edges:
        best.setdefault(e[:3], []).append((e[5], e[3]))
    tied = {k for k, v in best.items() if len({i for s, i in v if s == max(v)[0]}) > 1}
    used, want = set(), set()
    for c, d, f, i, p, s in sorted(edges, key=lambda e: (-e[5], e[4], e[3], e[2])):
        if (c, d, f) not in tied and ("f", c, d, f) not in used and ("i", c, d, i) not in used:
            used |= {("f", c, d, f), ("i", c, d, i)}
            want.add((c, d, f, i, s, "high" if s >= 100 else "medium"))
    assert {tuple(r) for r in matching.join_source_graph_1to1(t).collect()} == want and tied


def test_find_or_create(spark):
    r = random.Random(11)
    rows = [(n, r.choice([None, "", " 7 ", *"123456"]), r.choice("abcdefgh")) for n in range(80)]
    by_inn, by_name, want = {}, {}, {}
    for n, inn, name in rows:
        inn = (inn or "").strip()
        found = by_inn.get(inn) if inn else None
        found = by_name.get(name) if found is None else found
        if found is None:
            found = n
            by_name[name] = n
            if inn:
                by_inn[inn] = n
        want[n] = (found, found == n)
    got = matching.find_or_create(spark.createDataFrame(rows, "i int, inn string, name string").repartition(3), "i", "inn", "name")
    assert {x.id: (x.customer, x.created) for x in got.collect()} == want


def test_name_key(spark):
    rows = [("ООО «Ромашка-Щит»", "ooo romashka schit"), ("  A&B  co.", "a b co"), (None, None)]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(matching.name_key(F.col("a"))).collect()] == [r[1] for r in rows]


def above_join(df):
    """What the physical plan does after the join of items with fragments."""
    return df._jdf.queryExecution().executedPlan().toString().partition("SortMergeJoin")[0]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pairs_of_a_case_pass_no_shuffle(spark, monkeypatch):
    t = Tables(spark, str(DATA))
    assert "Exchange" not in above_join(matching.match_compatible(t)) and "Exchange" not in above_join(matching.match_fragment_score(t))
    assert above_join(matching.resolve_field_sources(t)).count("Exchange") == 1  # a row an item
    written, keep = [], matching.assignment.kept
    monkeypatch.setattr(matching.assignment, "kept", lambda df, name: written.append(above_join(df)) or keep(df, name))
    assert matching.join_source_graph_1to1(t).count() and "Exchange" not in written[0]


def test_ties(spark):
    rows = [("f", "a", 5), ("f", "b", 5), ("g", "a", 5), ("g", "b", 4), ("h", "a", 5), ("h", "a", 5), ("i", None, 5), ("i", "a", 5), (None, "a", 5), (None, "b", 5)]
    got = matching.assignment.without_ties(spark.createDataFrame(rows, "f string, i string, s int"), ["f"], ["i"], "s")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows[2:]))
