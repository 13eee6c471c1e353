"""Integer product codes against SQL, plain numpy and awkward vectors."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from fixtures import DATA, clashing, rows_of

from offerlens.llm import queries, vector_codes

COLS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=4096, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label), in order, without bad vectors."""
    x = [[min(max(int(np.floor(v * scale)), -(2**29)), 2**29) for v in r[1]] for r in rows]
    dim = len(x[0])
    cut = [dim * p // parts for p in range(parts + 1)]
    piece = lambda v, p: v[cut[p] : cut[p + 1]]
    fits = [i for i, v in enumerate(x) if len(v) == dim]
    books = [[piece(x[i], p) for i in fits if i < entries] for p in range(parts)]
    gap = lambda a, b: sum((m - n) ** 2 for m, n in zip(a, b, strict=True))
    pick = lambda v, p: min(range(len(books[p])), key=lambda e: (gap(piece(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [(pick(x[i], p), piece(x[i], p)) for i in fits]
            have = {e: [v for w, v in of if w == e] for e in range(len(books[p]))}
            new.append([[sum(c) // len(have[e]) for c in zip(*have[e], strict=True)] if have[e] else old for e, old in enumerate(books[p])])
        books = new
    code = {i: [pick(x[i], p) for p in range(parts)] for i in fits}
    error = {i: sum(gap(piece(x[i], p), books[p][e]) for p, e in enumerate(c)) for i, c in code.items()}
    total = {r[2]: None for r in rows}
    for i in fits:
        total[rows[i][2]] = (total[rows[i][2]] or 0) + error[i]
    digest = vector_codes.hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for e in code[i]) if i in code else None, error.get(i), total[r[2]], digest) for i, r in enumerate(rows)), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op12_vector_codes"])
    names = [c[0] for c in want.description]
    assert rows_of(queries.op12_vector_codes(spark, str(DATA)), *names) == sorted(want.fetchall(), key=repr)


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, (12, 10)) / 2  # coarse, so that distances tie
    rows = [(i, [float(v) for v in base[i % 12]], (None, 1, 2)[i % 3]) for i in range(3, 60)]
    rows += [rows[5], rows[5], (1, [1e30, -1e30, *[0.5] * 8], 7), (2, [0.0] * 10, None)]
    odd = [(None, [0.25] * 10, 2), (100, [1.0] * 4, 1), (101, [], 3)]
    bad = [(0, None, 1), (-1, [nan] * 10, 1), (-2, [inf] + [0.0] * 9, 1), (-3, [None] + [0.0] * 9, 1)]
    df = clashing(spark.createDataFrame(rows + odd + bad, SCHEMA).repartition(3))
    good = sorted(rows + odd, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert rows_of(vector_codes.coded(df), *COLS) == brute(good)
    assert vector_codes.coded(df.limit(0)).count() == 0
    few = [(9, [0.5, 1.0], 1), (8, [0.0, -1.0], None), (7, [0.0, -1.0], None)]
    assert rows_of(vector_codes.coded(spark.createDataFrame(few, SCHEMA)), *COLS) == brute(sorted(few))


def test_bounds_save_distances_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(0, 16, 3000)] + rng.integers(-300, 300, (3000, 8))).astype(np.int64)
    book = vector_codes.Codebook.first(x[:16], 1)
    old = low = None
    work = []
    for _ in range(7):
        entries, groups = book.entries[0], book.groups[0]
        drift = book.drift[0] if book.drift else None
        old, best, bounds, n = vector_codes.nearest(x, entries, groups, drift, old, low)
        low = vector_codes.lower(bounds)
        gaps = vector_codes.squared(x, entries)
        assert (old == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()
        work.append(n)
        totals = {}
        for i in range(16):
            mine = x[old == i]
            totals |= {i * 9: len(mine)} | {i * 9 + 1 + j: int(s) for j, s in enumerate(mine.sum(axis=0))}
        book = book.moved(totals)
    assert work[0] == x.shape[0] * 16 and work[-1] < work[0] / 4
