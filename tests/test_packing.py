"""Packing against the sequential walk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from offerlens.operators import packing


def walked(rows, limit, most):
    out, state = {}, {}
    for case, n, tokens in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        t = max(0, tokens or 0)
        batch, used, held = state.get(case, (0, 0, 0))
        if not held or used + t > limit or held >= most:
            batch, used, held = batch + 1, 0, 0
        out[case, n] = (batch, used, t > limit)
        state[case] = (batch, used + t, held + 1)
    return out


@pytest.mark.parametrize(("partitions", "limit", "most"), [("1", 100, 7), ("17", 100, 7), ("29", 30, 3), ("17", 5000, 900)])
def test_packing(spark, partitions, limit, most):
    r = random.Random(limit)
    rows = [(0 if r.random() < 0.7 else r.choice([None, *range(1, 20)]), n, r.choice([None, -3, 0, 0, 5, 20, 33, 99, 100, 101, 250])) for n in range(1500)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k int, n long, tokens int")
        got = packing.packed(df, "k", ["n"], "tokens", limit, most).collect()
        assert packing.packed(df.limit(0), "k", ["n"], "tokens", limit, most).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(x.k, x.n): (x.batch, x.batch_tokens_before, x.oversized) for x in got} == walked(rows, limit, most)
    assert len(got) == len(rows)


def test_one_large_case(spark):
    df = spark.range(400_000).selectExpr("0 as k", "id as n", "cast(pmod(hash(id), 90) as int) as tokens")
    got = packing.packed(df, "k", ["n"], "tokens", 1000, 64)
    sums = got.groupBy("batch").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("n").alias("low"))
    assert sums.filter("t > 1000 or n > 64").count() == 0 and got.count() == 400_000
    after = sums.select((F.col("batch") - 1).alias("batch"), "low").withColumnRenamed("low", "next")
    first = got.select(F.col("n").alias("next"), F.col("tokens").alias("more"))
    room = sums.join(after, "batch").join(first, "next").filter("t + more <= 1000 and n < 64")
    assert room.count() == 0  # no batch could have taken the next fragment


def test_places(spark):
    rows = [("2", "10", "b"), ("2", "9", "a"), (None, "1", "c"), ("x", None, "d"), ("1", "", "e")]
    df = spark.createDataFrame(rows, "d string, c string, f string").orderBy(*packing.fragment_place(F.col("d"), F.col("c"), F.col("f")))
    assert [r.f for r in df.collect()] == ["e", "a", "b", "c", "d"]
