"""Nearest vectors, marks in texts and profiles, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.operators import attributes, retrieval


@pytest.mark.parametrize("block", [1024, 3])
def test_top_cosine(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(300, None), (301, [None, 1.0, 1.0, 1.0]), (302, [1.0, 2.0]), (None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = v.filter("vec_id % 30 = 0 or vec_id = 302").withColumnRenamed("vec_id", "qid")
    got = {(r.qid, r.rank_order): (r.vec_id, r.score) for r in retrieval.top_cosine(q, v, 5, block=block).collect()}
    want = {}
    good = [(i, np.array(x)) for i, x in rows[:300]]
    for i in range(0, 300, 30):
        a = good[i][1]
        cos = lambda b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6) if a.any() and b.any() else 0.0  # noqa: B023, E731
        best = sorted((-cos(b), j) for j, b in good if j != i)[:5]
        want |= {(i, n): (j, -s) for n, (s, j) in enumerate(best, 1)}
    assert {k: (i, round(s, 5)) for k, (i, s) in got.items()} == {k: (i, round(s, 5)) for k, (i, s) in want.items()}
    assert retrieval.top_cosine(q.limit(0), v, 5).count() == retrieval.top_cosine(q, v.limit(0), 5).count() == 0


def test_marks(spark):
    r = random.Random(2)
    aliases = [("".join(r.choices("abё12", k=r.randint(1, 5))), r.choice("MNO")) for _ in range(60)] + [("", "M"), (None, "N"), ("-", "O")]
    texts = [(i, "".join(r.choices("abе12 -.", k=r.randint(0, 40)))) for i in range(80)] + [(80, None), (81, "zzz"), (82, "a" * 200_000)]
    squeeze = lambda s: "".join(c for c in (s or "").lower().replace("ё", "е") if c.isalnum())
    owners = {(squeeze(a), m) for a, m in aliases if squeeze(a)}
    want = {}
    for i, t in texts:
        hits = [(len(a), m) for a, m in owners if a in squeeze(t)]
        top = {m for n, m in hits if n == max(hits)[0]}
        want[i] = ("none", None, 0) if not hits else ("resolved", top.pop(), max(hits)[0]) if len(top) == 1 else ("ambiguous", None, max(hits)[0])
    df = spark.createDataFrame(texts, "i long, t string").repartition(3)
    got = attributes.resolved_marks(df, "i", "t", spark.createDataFrame(aliases, "alias string, mark string"))
    assert {x.i: (x.status, x.mark, x.alias_length) for x in got.collect()} == want
    assert {x.status for x in attributes.resolved_marks(df, "i", "t", spark.createDataFrame([], "alias string, mark string")).collect()} == {"none"}


def test_comparisons_and_statuses(spark):
    df = spark.createDataFrame([("Ёж  a", "еж a", 1.0, 2.0, ["A", "b"], ["B", "a", "c"], [1.0, 3.0], [3.0, 4.0])], "a string, b string, x double, y double, p array<string>, q array<string>, r array<double>, s array<double>")
    c = lambda k, m, n: attributes.compare(k, F.col(m), F.col(n))
    assert tuple(df.select(c("exact", "a", "b"), c("minimum", "x", "y"), c("maximum", "x", "y"), c("contains", "p", "q"), c("contains", "q", "p"), c("range_overlap", "r", "s")).first()) == (True, True, False, True, False, True)
    rules = [("c", "exact", True, True), ("r", "minimum", False, True), ("o", "exact", False, False)]
    rows = [
        (1, "x", "x", 1.0, 2.0, "a", "a", True, "EXACT"), (2, "x", "y", 1.0, None, "a", "a", True, "NO_MATCH"), (3, "x", None, 1.0, 2.0, "a", "a", True, "UNCERTAIN"), (4, "x", "x", 1.0, 2.0, "a", "a", False, "UNCERTAIN"),
        (5, "x", "x", 3.0, 2.0, "a", "a", True, "PARTIAL"), (6, None, None, 1.0, None, "a", "a", True, "PARTIAL"), (7, "x", "x", None, None, "a", "b", True, "LIKELY_ANALOG"), (8, None, "z", None, 1.0, None, None, True, "EXACT"), (9, "x", "x", 1.0, 1.0, None, None, None, "UNCERTAIN"),
    ]
    got = attributes.evaluated(spark.createDataFrame(rows, "i int, requested_c string, offered_c string, requested_r double, offered_r double, requested_o string, offered_o string, sure boolean, want string"), rules, F.col("sure"))
    assert [(x.i, x.status) for x in got.orderBy("i").collect()] == [(r[0], r[8]) for r in rows]
    assert {x.i: (x.missing, x.mismatch) for x in got.collect()}[2] == (["r"], ["c"])
    with pytest.raises(ValueError):
        attributes.compare("near", F.col("a"), F.col("b"))
