"""Similarity joins against all pairs compared by difflib."""

from __future__ import annotations

import random
from collections import Counter
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from offerlens.operators import similarity
from offerlens.tables import kept

DATA = Path("/root/testdata/sf0.001")


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def names(seed, n=120):
    r = random.Random(seed)
    parts = ["насос", "кабель", "ввгнг", "pump", "valve", "ball", "3x2.5", "dn50", "ооо", "x", "стальной", "медный"]
    base = [" ".join(r.choices(parts, k=r.randint(1, 5))) for _ in range(n)]

    def typo(s):
        s = list(s)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(s) + 1)
            s[i : i + r.randint(0, 1)] = r.choice(["", "a", "7", "ж"])
        return "".join(s)

    return base, [typo(x) for x in base] + ["", None, "a", "ab", "abc" * 90, "abc" * 90 + "d"]


@pytest.mark.parametrize("least", [0.7, 0.82, 0.9, 1.0])
def test_all_pairs(spark, least):
    a, b = names(1)
    left, right = spark.createDataFrame([(x,) for x in a + b], "t string"), spark.createDataFrame([(x,) for x in b], "t string")
    got = {(r.a_text, r.b_text): r.ratio for r in similarity.similar_pairs(left, right, F.col("t"), F.col("t"), least).collect()}
    want = {(x, y): q for x in set(a + b) if x for y in set(b) if y if (q := ratio(x, y)) >= least}
    assert got == want


def test_pairs_within_blocks(spark):
    a, b = names(2, 60)
    rows = [(x, i % 3 if i % 7 else None) for i, x in enumerate(a + b)]
    df = spark.createDataFrame(rows, "t string, k int")
    got = {(r.block, r.a_text, r.b_text) for r in similarity.similar_pairs(df, df, F.col("t"), F.col("t"), 0.82, F.col("k"), F.col("k")).collect()}
    want = {(str(k), x, y) for x, k in rows if x and k is not None for y, m in rows if y and k == m and ratio(x, y) >= 0.82}
    assert got == want


def test_best(spark):
    a, b = names(3)
    left, right = spark.createDataFrame([(x,) for x in a], "t string"), spark.createDataFrame([(x, i) for i, x in enumerate(b)], "t string, i int")
    got = {r.text: (r.best_text, r.best_order, r.score) for r in similarity.best_matches(left, right, F.col("t"), F.col("t"), F.col("i")).collect()}
    want = {}
    for x in set(a):
        q, i = max(((ratio(x, y), -i) for i, y in enumerate(b) if y))
        if q >= 0.7:
            want[x] = (b[-i], -i, q)
    assert got == want
    assert similarity.best_matches(left.limit(0), right, F.col("t"), F.col("t"), F.col("i")).count() == 0
    assert similarity.best_matches(left, right.limit(0), F.col("t"), F.col("t"), F.col("i")).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_few_pairs_are_compared(spark):
    part = spark.read.parquet(str(DATA.parent / "sf0.01/part.parquet"))
    text = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    a = kept(similarity._texts(part, F.lit(""), text), "names")
    n = a.count()
    met = similarity.candidates(a, a, 0.9).join(a.selectExpr("id as a_id", "text as x"), "a_id").join(a.selectExpr("id as b_id", "text as y"), "b_id")
    compared = sum(2 * (Counter(r.x) & Counter(r.y)).total() >= 0.9 * (len(r.x) + len(r.y)) - 1e-9 for r in met.select("x", "y").collect())
    assert 0 < compared < 0.01 * n * n


def test_numbered_names_meet_few_others(spark):
    a, b = ([(f"supplier {i:09d}",) for i in range(low, high)] for low, high in ((5000, 5400), (0, 300)))
    left, right = spark.createDataFrame(a, "t string"), spark.createDataFrame(b, "t string")
    got = {(r.a_text, r.b_text): r.ratio for r in similarity.similar_pairs(left, right, F.col("t"), F.col("t"), 0.9).collect()}
    assert got == {(x, y): q for (x,) in a for (y,) in b if (q := ratio(x, y)) >= 0.9} and got
    x, y = (kept(similarity._texts(d, F.lit(""), F.col("t")), "names") for d in (left, right))
    assert similarity.candidates(x, y, 0.9).count() < 4 * len(got)


def test_best_of_texts_with_a_word_more_or_less(spark, monkeypatch):
    r = random.Random(4)
    words = ["red", "hot", "bolt", "gear", "насос", "dn50", "b#1", "b#12", "b#2"]
    b = sorted({" ".join(r.choices(words, k=r.randint(2, 5))) for _ in range(150)})
    a = sorted({f"{x} {r.randrange(30)}" for x in b} | {f"{r.randrange(9)} {x}" for x in b} | {x.split(" ", 1)[1] for x in b[::5]})
    left, right = spark.createDataFrame([(x,) for x in a], "t string"), spark.createDataFrame([(x, -i) for i, x in enumerate(b)], "t string, i int")
    seen = []
    near = similarity._near
    monkeypatch.setattr(similarity, "_near", lambda *x: seen.append(kept(near(*x), "near")) or seen[-1])
    got = {r.text: (r.best_text, r.best_order, r.score) for r in similarity.best_matches(left, right, F.col("t"), F.col("t"), F.col("i")).collect()}
    want = {}
    for x in a:
        q, i = max((ratio(x, y), i) for i, y in enumerate(b))
        if q >= 0.7:
            want[x] = (b[i], -i, q)
    assert got == want
    assert len(a) // 2 < seen[0].count() < len(a)  # some go on to the thresholds


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_offers_of_parts_need_no_threshold(spark, monkeypatch):
    from offerlens.plans import QUERIES

    monkeypatch.setattr(similarity, "similar", lambda *x: pytest.fail("met by the tokens of few words"))
    met = []
    near_candidates = similarity.near_candidates
    monkeypatch.setattr(similarity, "near_candidates", lambda *x: met.append(near_candidates(*x)) or met[-1])
    rows = spark.read.parquet(str(DATA / "part.parquet")).orderBy("p_partkey").collect()
    lines: dict[str, int] = {}
    for r in rows:
        lines.setdefault(f"{r.p_name} {r.p_type} {r.p_brand}".lower(), r.p_partkey)
    want = {}
    for r in rows:
        text = f"{r.p_name} {r.p_type} {r.p_brand} {r.p_size}".lower()
        q, k, name = max((ratio(text, y), -k, y) for y, k in lines.items())
        want[r.p_partkey] = (-k, name, round(q, 3))
    got = {r.p_partkey: (r.matched_partkey, r.matched_name, r.match_score) for r in QUERIES["join_fuzzy_best"](spark, str(DATA)).collect()}
    assert got == want
    assert met[0].count() < 0.02 * len(rows) * len(lines)
