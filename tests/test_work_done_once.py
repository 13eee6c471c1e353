"""Steps that plans must not repeat or send around: seen in the plans, with their results."""

from __future__ import annotations

from pathlib import Path

import pytest

from offerlens import plans
from offerlens.operators import chunks, graphs
from offerlens.sources import trees

DATA = Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@tables
def test_a_header_is_made_once(spark):
    assert executed(plans.QUERIES["str_match_header"](spark, str(DATA))).count("regexp_replace(") == 2


@tables
def test_nodes_are_not_grouped_again(spark):
    for name in ("scan_notice_xml", "scan_soap_xml"):
        assert "Exchange" not in executed(plans.QUERIES[name](spark, str(DATA))).partition("MapInArrow")[0]
    assert "lawName" not in executed(plans.QUERIES["scan_soap_xml"](spark, str(DATA))).rpartition("Exchange")[2]  # XML is written after the shuffle


@tables
def test_pages_are_cut_once(spark):
    whole = executed(plans.QUERIES["scan_html_cards"](spark, str(DATA)))
    assert whole.count("split(") == 3 and "Union" not in whole  # a class of cards each
    assert executed(plans.QUERIES["html_label_pairs"](spark, str(DATA))).count("split(") == 3


def test_picked_values(spark):
    docs = [(1, "<r><b> </b><c>second</c><b>first</b><b>later</b><d>\n 5 \n</d><s><b>in</b><s><c>deep</c></s></s></r>"), (2, "<r><d/></r>"), (3, "<r>"), (4, None), (5, " ")]
    df, pick = spark.createDataFrame(docs, "id int, x string"), trees.picker({"f": ("b", "c"), "g": ("z", "d")})
    got = [tuple(r) for r in trees.mapped(df, "id", "x", lambda found: [pick(found)], ("f", "g")).collect()]
    assert sorted(got) == [(1, "first", "5"), (2, None, None)]
    inner = trees.mapped(df, "id", "x", lambda found: map(pick, trees.within(found).values()), ("f", "g"), ("s",))
    assert sorted(r.f for r in inner.collect()) == ["deep", "in"]


def test_pointers_are_not_sent_through_the_driver(spark):
    got = graphs.roots(spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 4)], "node long, parent long"))
    assert "Broadcast" not in executed(got)
    assert sorted((r.node, r.root, r.on_cycle) for r in got.collect()) == [(1, 3, False), (2, 3, False), (3, 3, False), (4, None, True), (5, None, True), (6, None, False)]


def test_a_text_of_many_chunks(spark):
    texts = [(1, " ".join(f"word{i}" for i in range(60_000))), (2, "same words " * 400), (3, None), (4, "x " * 200)] + [(i, f"text {i} " * 40) for i in range(5, 200)]
    got = chunks.chunked(spark.createDataFrame(texts, "id long, t string").coalesce(1), "id", "t").collect()
    for i, text in texts:
        want = list(dict.fromkeys(p for _, _, p in chunks.spans((text or "").strip())))
        assert [r.text for r in sorted((r for r in got if r.id == i), key=lambda r: r.chunk_index)] == want and (i > 1 or len(want) > 300)
