"""Items and fragments of cases, assigned in numpy: against the pairs of the plans, walked by windows."""

from __future__ import annotations

import random
from functools import partial
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from offerlens.operators import casewise
from offerlens.plans import matching
from offerlens.plans.registry import Tables

DATA = Path("/root/testdata/sf0.001")
NODE, OTHER = ["case", "document", "fragment"], ["case", "document", "item"]


def walked(t):
    edges = matching.assignment.without_ties(matching.scored_pairs(t), NODE, ["item"], "score").selectExpr("*", "-score minus")
    taken = matching.assignment.greedy_one_to_one(edges, NODE, OTHER, ["minus", "position", "item", "fragment"])
    return sorted(map(tuple, taken.select(*NODE, "item", "score").collect()))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Lines that repeat, parts of one key, names that are null, long, alike or contrary, amounts and units that are null, empty or no number."""
    r, path = random.Random(8), tmp_path_factory.mktemp("odd")
    words = ["модуль", "питания", "Пластина", "грудной", "плечевая", "лучевая", "недлительный", "длительный", "ржаной", "образец", "электрод", "кот", "steel", "Ring", "plate"]
    names = [None, "", " steel ", "steel", "STEEL", " ".join(f"word{i}" for i in range(12)), " ".join(f"word{i}" for i in range(6, 20))] + [" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(60)]
    part = [(k, r.choice(names), r.choice([None, "", "Ring", "steel", "модуль", "образец"])) for k in [*range(60), *range(5)]]
    lines = [(r.randint(1, 60), r.randint(1, 12), r.randint(0, 60), r.randint(1, 2), r.choice([None, float("nan"), 0.0, -0.0, 1.0, 2.0]), r.choice([None, "", "N", "n", "A"])) for _ in range(500)]
    lines += [(0, n, n, 1, 1.0, "N") for n in range(40)] + r.sample(lines, 60) + [(*x[:4], 3.0, "R") for x in r.sample(lines, 60)] + [(None, 1, 1, 1, 1.0, "N"), (61, None, 1, 1, 1.0, "N")]
    put = lambda rows, names, kinds, name: pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names), path / f"{name}.parquet")
    put(part, ["p_partkey", "p_name", "p_type"], [pa.int64(), pa.string(), pa.string()], "part")
    put(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string()], "lineitem")
    return str(path)


@pytest.mark.parametrize("most", [casewise.PAIRS, 30, 3])
def test_odd_cases_are_walked_as_by_windows(spark, odd, monkeypatch, most):
    """Many cases at a time, few, or nearly all of them too large for one hand."""
    t = Tables(spark, odd)
    monkeypatch.setattr(matching.casewise, "assigned", partial(casewise.assigned, most=most))
    got = matching.join_source_graph_1to1(t)
    assert sorted(map(tuple, got.select(*NODE, "item", "score").collect())) == walked(t)


def test_a_case_over_several_batches(spark, odd):
    t, key = Tables(spark, odd), "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 7)
    try:
        got = sorted(map(tuple, matching.join_source_graph_1to1(t).select(*NODE, "item", "score").collect()))
    finally:
        spark.conf.unset(key)
    assert got == walked(t)


def test_a_case_that_is_not_whole_fails(spark, odd):
    lines = matching.whole_cases(Tables(spark, odd)).selectExpr("* except (n)", "n + 1 n").filter("case = 0")
    with pytest.raises(Exception, match="several partitions"):
        casewise.assigned(lines, matching.TITLE, (matching.SHEET, matching.TEXT)).count()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pairs_are_no_rows_of_the_plan(spark, monkeypatch):
    """Lines go into one step that sorts once on each side; pairs were joined as rows and sorted for each window."""
    written, keep = [], matching.assignment.kept
    monkeypatch.setattr(matching.assignment, "kept", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    assert matching.join_source_graph_1to1(Tables(spark, str(DATA))).count()
    assert "Window" not in written[0] and "array_intersect" not in written[0] and written[0].count("Sort [") == 2
