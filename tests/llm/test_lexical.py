"""Ranked search against SQL and plain sums, over the small tables, awkward ones and random postings."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from fixtures import DATA, awkward_rows, clashing, rows_of

from offerlens.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n, total = len(found), sum(k for *_, k in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        rows = []
        for d, c, k in found:
            m = 75 + 25 * k * n // total
            rows.append((-sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, a in q.items() if c[t]), d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted((x for x in rows if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_table_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLES["op13_lexical"])
    names = [c[0] for c in want.description]
    got = queries.op13_lexical(spark, str(DATA))
    assert rows_of(got, *names) == sorted(want.fetchall(), key=repr) and got.count() > 100


@pytest.mark.parametrize(("block", "postings"), [(1 << 17, 1 << 21), (5, 7)])
def test_awkward(spark, block, postings):
    docs = [(r[0], r[1]) for r in awkward_rows()] + [(None, "a b c"), (20, "b-C_ü Ü"), (21, "c b a c")]
    items = [(1, "a b c c"), (2, None), (3, ""), (4, "É ü Ü İ"), (5, "nowhere"), (1, "a b c c"), (6, "word1 word5"), (6, "word7919 word2"), (None, "x"), (7, "y" * 70_000)]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    q = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = lexical.ranked(d, q, block=block, postings=postings)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute(docs, items)
    assert lexical.ranked(d.limit(0), q).count() == lexical.ranked(d, q.limit(0)).count() == 0


def test_terms_of_long_texts():
    text = ("Ab1 " * 700_000 + "é" * 3_000_000).encode()
    pieces = list(lexical.terms(text))
    assert len(pieces) > 1 and Counter(t for p in pieces for t in p) == {b"ab1": 700_000, ("é" * 3_000_000).encode(): 1}


def test_blocks_are_the_cheapest():
    rng = np.random.default_rng(4)
    for n in (1, 2, 9, 40):
        s = rng.integers(1, 1000, n)
        got = lexical.block_starts([s, s[:1]], grain=1, longest=64, price=3.0)
        cost = lambda starts: sum(s[a:b].max() * (b - a) - s[a:b].sum() + 3.0 * s.mean() for a, b in zip(starts, [*starts[1:], n], strict=True))  # noqa: B023, E731
        best = [0.0] + [math.inf] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + s[i:j].max() * (j - i) - s[i:j].sum() + 3.0 * s.mean() for i in range(j))
        assert math.isclose(cost(got[0].tolist()), best[n]) and got[1].tolist() == [0]


def test_search_skips_and_misses_nothing():
    rng = np.random.default_rng(9)
    n, read, held = 4000, 0, 0
    doc, term, score = [], [], []
    for t in range(30):
        d = np.sort(rng.choice(n, rng.integers(1, 3000), replace=False))
        s = rng.integers(1, 50, len(d)) + 500 * (rng.random(len(d)) < 0.01)
        doc, term, score = [*doc, d], [*term, np.full(len(d), t)], [*score, s]
    shard = lexical.Shard(n, *map(np.concatenate, (doc, term, score)))
    for _ in range(40):
        asked = [(int(t), int(rng.integers(1, 4))) for t in rng.choice(32, 4, replace=False)]
        total = np.zeros(n, np.int64)
        for t, times in asked:
            if t < 30:
                total[doc[t]] += score[t] * times
                held += len(doc[t])
        bar = max(1, np.sort(total)[-5])
        got = dict(zip(*(x.tolist() for x in shard.best(asked, 5, 1)[:2]), strict=True))
        assert got == {int(i): int(total[i]) for i in np.nonzero(total >= bar)[0]}
    assert shard.read < held / 2
