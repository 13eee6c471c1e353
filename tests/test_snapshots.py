"""Upserts against a plain dictionary, with replays, races and snapshots."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

from offerlens.operators.snapshots import UpsertTable

SCHEMA = "source string, id string, title string, price double, at long, present array<string>"


def applied(batches):
    rows = {}
    for n, batch in enumerate(batches, 1):
        seen = {}
        for s, i, title, price, at, present in sorted((r for r in batch if r[0] is not None and r[1] is not None), key=lambda r: r[4]):
            row = rows.setdefault((s, i), {"first": n})
            row["last"] = n
            given = present if present is not None else ["title", "price", "at"]
            for c, v in (("title", title), ("price", price), ("at", at)):
                if c in given:
                    row[c] = v
            seen[s, i] = True
    return {(*k, r.get("title"), r.get("price"), r["first"], r["last"]) for k, r in rows.items()}


def made(seed, n):
    r = random.Random(seed)
    return [(r.choice(["eis", "eat", None]), r.choice("abcdefgh"), r.choice([None, "t", f"t{i}"]), r.choice([None, 1.5, float(i)]), 1000 * seed + i, r.choice([None, ["title", "at"], ["price", "at"], ["at"]])) for i in range(n)]


def got(table):
    return {tuple(r) for r in table.rows().select("source", "id", "title", "price", "first_seen", "last_seen").collect()}


def test_batches_replays_and_snapshots(spark, tmp_path):
    table = UpsertTable(spark, f"file://{tmp_path}/t", ["source", "id"], "at", buckets=2)
    batches = [made(s, 12) for s in (1, 2, 3, 4)]
    for n, b in enumerate(batches[:3]):
        assert table.commit(f"b{n}", spark.createDataFrame(b, SCHEMA))
    assert got(table) == applied(batches[:3])
    assert not table.commit("b1", spark.createDataFrame(made(9, 12), SCHEMA)) and got(table) == applied(batches[:3])
    old = table.version()
    table.compacted()
    assert got(table) == applied(batches[:3]) and len(table.version().parts) == 1
    assert {tuple(r) for r in table.rows(old).select("source", "id", "title", "price", "first_seen", "last_seen").collect()} == got(table)
    assert table.commit("b3", spark.createDataFrame(batches[3], SCHEMA)) and not table.commit("b0", spark.createDataFrame(batches[0], SCHEMA))
    after = {r[:4] for r in got(table)}
    assert after == {r[:4] for r in applied(batches)}


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    batches = {f"b{s}": [(f"s{s}", str(i), "t", 1.0, i, None) for i in range(5)] for s in range(4)}
    send = lambda k: UpsertTable(spark, path, ["source", "id"], "at", buckets=1).commit(k, spark.createDataFrame(batches[k], SCHEMA))
    with ThreadPoolExecutor(8) as pool:
        sent = list(pool.map(send, [*batches, *batches]))
    table = UpsertTable(spark, path, ["source", "id"], "at")
    v = table.version()
    assert sum(sent) == 4 and sorted(v.batches) == sorted(batches) and v.number == 4 and len(v.parts) == 4
    assert table.rows().count() == 20


def test_a_lost_race_is_tried_again(spark, tmp_path):
    table = UpsertTable(spark, f"file://{tmp_path}/t", ["source", "id"], "at", buckets=1)
    put, once = table._put, []

    def beaten(v):
        if not once:
            once.append(v.number)
            rival = UpsertTable(spark, table.path, ["source", "id"], "at", buckets=1)
            rival.commit("rival", spark.createDataFrame([("r", "1", "x", 2.0, 1, None)], SCHEMA))
        return put(v)

    table._put = beaten
    assert table.commit("mine", spark.createDataFrame([("m", "1", "y", 3.0, 1, None)], SCHEMA))
    assert table.version().batches == ["rival", "mine"] and {r[0] for r in got(table)} == {"r", "m"}


def test_a_writer_that_died_with_its_claim(spark, tmp_path):
    table = UpsertTable(spark, f"file://{tmp_path}/t", ["source", "id"], "at", buckets=1, patience=0.3)
    row = spark.createDataFrame([("m", "1", "y", 3.0, 1, None)], SCHEMA)
    table.commit("first", row)
    assert table._claimed(2) and not table._claimed(2)
    assert table.commit("second", row) and table.version().batches == ["first", "second"]
