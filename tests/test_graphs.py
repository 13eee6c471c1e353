"""Graphs against plain walks."""

from __future__ import annotations

import random

import pytest

from offerlens.operators import assignment, cascade, graphs, ranges
from pyspark.sql import functions as F


def walk(up, n):
    seen = [n]
    while up.get(seen[-1]) is not None:
        n = up[seen[-1]]
        if n in seen:
            return None, None, seen.index(n) == 0
        seen.append(n)
    return seen[-1], len(seen) - 1, False


@pytest.mark.parametrize("seed", [1])
def test_roots(spark, seed):
    r = random.Random(seed)
    up = {i: r.choice([None, r.randrange(70), r.randrange(70)]) for i in range(60)}
    rows = [*up.items(), (None, 3), *list(up.items())[:5]]
    got = {x.node: (x.root, x.depth, x.on_cycle) for x in graphs.roots(spark.createDataFrame(rows, "node long, parent long")).collect()}
    nodes = set(up) | {p for p in up.values() if p is not None}
    assert got == {n: walk(up, n) for n in nodes}


def test_long_chain_and_empty(spark):
    chain = spark.range(10_000).selectExpr("id as node", "if(id = 0, null, id - 1) as parent")
    got = graphs.roots(chain)
    assert got.filter("root = 0 and depth = node").count() == 10_000
    assert graphs.roots(chain.limit(0)).count() == 0
    edges = chain.filter("parent is not null").selectExpr("node as a", "parent as b")
    rest, rounds = graphs._peeled(graphs.kept(edges, "edges"))
    assert rest.isEmpty() and rounds < 20
    assert graphs.on_cycles(edges).count() == 0 == graphs.on_cycles(edges.limit(0)).count()


def test_ancestors(spark):
    r = random.Random(5)
    up = {i: (None if i % 17 == 0 else r.randrange(i)) for i in range(60)} | {60: 61, 61: 60, 62: 60}
    pairs = [(r.randrange(64), r.randrange(64)) for _ in range(300)] + [(None, 1), (1, None), (5, 5)]

    def holds(a, n):
        if a is None or n is None or walk(up, n)[1] is None:
            return False
        while n is not None:
            if n == a:
                return True
            n = up.get(n)
        return False

    got = graphs.is_ancestor(spark.createDataFrame(list(up.items()), "node long, parent long"), spark.createDataFrame(pairs, "ancestor long, node long"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((a, n, holds(a, n)) for a, n in pairs), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range((25, 35, 50)[seed - 1])] + [(31, 31), (40, 41), (41, 42), (42, 40), (43, 40), (42, 44)]
    reach = {n: {n} for e in edges for n in e}
    while any([b not in reach[n] and not reach[n].add(b) for n in reach for a, b in edges if a in reach[n]]):
        pass
    on = {n for n in reach if any(n in reach[b] for a, b in edges if a == n)}
    want = {n: max(m for m in on if m in reach[n] and n in reach[m]) for n in on}
    got = graphs.on_cycles(spark.createDataFrame([*edges, edges[0], (None, 1)], "a long, b long"))
    assert {x.node: x.cycle for x in got.collect()} == want and got.count() == len(want)


def test_greedy_assignment(spark):
    r = random.Random(7)
    edges = list({(r.randrange(3), f"f{r.randrange(25)}", f"i{r.randrange(25)}"): r.choice([10, 20, 30, 120]) for _ in range(250)}.items())
    rows = [(*k, s) for k, s in edges] + [(None, "f1", "i1", 500)]
    df = spark.createDataFrame(rows, "doc int, f string, i string, score int").withColumn("minus", -F.col("score"))
    used, want = set(), set()
    for doc, f, i, s in sorted(rows[:-1], key=lambda x: (-x[3], x[2], x[1], x[0])):
        if (doc, "f", f) not in used and (doc, "i", i) not in used:
            used |= {(doc, "f", f), (doc, "i", i)}
            want.add((doc, f, i, s))
    got = assignment.greedy_one_to_one(df, ["doc", "f"], ["doc", "i"], ["minus", "i", "f", "doc"])
    assert {(x.doc, x.f, x.i, x.score) for x in got.collect()} == want
    assert assignment.greedy_one_to_one(df.limit(0), ["f"], ["i"], ["minus"]).count() == 0


def test_cascade(spark):
    known = [(1, "77", "A", 1), (2, "78", "B", 2), (3, None, "B", 3), (4, "", "C", 4), (5, "79", "D", 5), (6, "79", "E", 6)]
    asked = [(10, "77", "B"), (11, "99", "A"), (12, None, "B"), (13, "99", "C"), (14, "", ""), (15, "79", "A"), (16, None, None)]
    k, a = spark.createDataFrame(known, "id int, inn string, name string, at int"), spark.createDataFrame(asked, "id int, inn string, name string")
    keys = [F.col("inn"), F.col("name")]
    got = cascade.cascade(a, F.col("id"), keys, k, F.col("id"), keys, F.col("at"), [False, True])
    assert {(x.id, x.known_id, x.rank) for x in got.collect()} == {(10, 1, 0), (11, 1, 1), (13, 4, 1), (15, 5, 0)}


def test_previous_in_key(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), n, n * 10) for n in r.sample(range(200), 80)]
    got = ranges.previous_in_key(spark.createDataFrame(rows, "k string, n long, v long"), ["k"], "n", "v", "was", 7)
    last, want = {}, set()
    for k, n, v in sorted(rows, key=lambda x: x[1]):
        want.add((k, n, v, last.get(k) if k else None))
        last[k] = v
    assert {tuple(x) for x in got.select("k", "n", "v", "was").collect()} == want
