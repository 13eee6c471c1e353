"""Hashed vectors of texts against the SQL, on awkward rows and in small pieces."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from offerlens.operators import hashing
from offerlens.plans import ORACLES, QUERIES

SIGNS = ("a", "Б", "é", "word", "WORD-", "_", "-", "9", "٣", "漢字", "İ", "ΑΣ", "ß", "́", "😀", " ", " ", "\n", ".", "٬", "Слово", "сталь", "x" * 30)


def texts(n):
    r = random.Random(5)
    return [r.choice([None, "", *("".join(r.choices(SIGNS, k=r.randint(1, 60))) for _ in range(6))]) for _ in range(n)]


def test_embed_hashing_is_the_sql_and_shuffles_once(spark, tmp_path):
    """Ids that repeat or are null, capitals of other scripts, texts beyond a piece; a row a document is shuffled, where words were."""
    r = random.Random(6)
    rows = [(r.choice([None, 1, 2, 3, *range(4, 40)]), x) for x in texts(200)]
    rows += [(100, "   . "), (101, "a" * 5_000_000), (102, "ab " * 500_000 + "w" * 2_500_000 + " конец" * 200_000), (103, "-"), (103, None)]
    table = pa.table({"doc_id": pa.array([x for x, _ in rows], pa.int64()), "text": pa.array([x for _, x in rows])})
    pq.write_table(table, tmp_path / "documents.parquet")
    got = QUERIES["embed_hashing"](spark, str(tmp_path))
    c = duckdb.connect()
    c.register("documents", table)
    key = lambda x: x[:2]
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(c.sql(ORACLES["embed_hashing"]).fetchall(), key=key)
    plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_pieces_cut_no_word(monkeypatch):
    ids, rows = pa.array(range(60)), texts(60)
    rows = [x or "" for x in rows]
    batch = pa.record_batch([ids, pa.array(rows)], ["i", "t"])

    def vectors():
        sums = np.zeros((60, hashing.BUCKETS), np.int64)
        for b in hashing._summed(["i", "b", "w"])(iter([batch.slice(0, 25), batch.slice(25)])):
            for i, buckets, weights in zip(*(c.to_pylist() for c in b.columns), strict=True):
                np.add.at(sums[i], buckets, weights)
        return sums

    want = vectors()
    assert want.any()
    for piece, n in ((1, 1), (7, 2048), (64, 3), (300, 7)):
        monkeypatch.setattr(hashing, "PIECE", piece)
        monkeypatch.setattr(hashing, "TEXTS", n)
        assert (vectors() == want).all()


def test_vectors_of_one_id_meet_across_batches(monkeypatch):
    one = lambda i, *w: pa.record_batch([pa.array(i), pa.array([[3], *[[5]] * (len(i) - 1)], pa.list_(pa.int16())), pa.array([[x] for x in w], pa.list_(pa.int64()))], ["i", "b", "w"])
    batches = [one([1, 1], 3_000_000, 2_000_000), one([1, 1, 2], 0, 2_000_000, 7), one([2, 3], 7, -7)]
    want = [(1, 3, 0.6), (1, 5, 0.8), (2, 3, 0.707107), (2, 5, 0.707107), (3, 5, -1.0)]
    for n in (1, 2, 1024):
        monkeypatch.setattr(hashing, "VECTORS", n)
        assert [r for b in hashing._united(["i", "b", "w"])(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == want
