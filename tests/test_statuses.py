"""Folds and statuses against plain walks, and the stream against the batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from offerlens.operators import statuses

NAMES = sorted({s for r in statuses.RULES for s in r})


def requests(seed, keys, n):
    r = random.Random(seed)
    chain = [a for a, _ in statuses.RULES]
    rows = []
    for i in range(n):
        k = 0 if r.random() < 0.5 else r.choice([*range(1, keys), None])  # one key has half of all rows
        to = r.choice([*chain, *NAMES, None])
        rows.append((k, r.randrange(10**6), i, r.choice([None, None, None, "", r.choice(NAMES)]), to))
    return rows


def walked(rows):
    now, out = {}, set()
    for k, ts, i, wanted, to in sorted(rows, key=lambda x: (x[1], x[2])):
        before = now.get(k, "NEW")
        after, why = statuses.step(frozenset(statuses.RULES), before, wanted, to)
        now[k] = after
        out.add((k, i, before, after, statuses.BLOCKED if why else statuses.CHANGED, why))
    return out


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_table(spark, partitions):
    rows = requests(1, 12, 1500)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k int, ts long, i long, from_status string, to_status string")
        got = statuses.transitions(df, "k", ["ts", "i"]).select("k", "i", "before", "after", "event_code", "reason").collect()
        assert statuses.transitions(df.limit(0), "k", ["ts", "i"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r) for r in got} == walked(rows) and len(got) == len(rows)


def test_rules():
    ok = frozenset(statuses.RULES)
    assert len(statuses.RULES) == 13
    assert statuses.step(ok, "NEW", None, "CANDIDATE") == ("CANDIDATE", None)
    assert statuses.step(ok, "NEW", "CANDIDATE", "DOCS_ANALYSIS") == ("NEW", statuses.MISMATCH)
    assert statuses.step(ok, "NEW", None, "SUBMISSION") == ("NEW", statuses.NO_RULE)


def test_stream_is_the_batch_and_survives_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(k or 0, ts, i, w, to) for k, ts, i, w, to in requests(4, 5, 120)]
    rows.sort(key=lambda r: r[1] // 200_000)  # out of order within about the time allowed
    schema = "k long, ts long, i long, from_status string, to_status string"

    def put(part, n):
        spark.createDataFrame(part, schema).withColumn("at", F.timestamp_millis("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        src = spark.readStream.schema(schema + ", at timestamp").parquet(str(tmp_path / "in"))
        q = statuses.stream_transitions(src, "k", "at", "i", late="5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for n in range(0, 120, 40):
        put(rows[n : n + 40], n)
        drain()
    put([(10**6, 10**9, 10**6, None, "CANDIDATE")], 0)  # moves the watermark past all others
    drain()
    drain()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {tuple(r) for r in out.filter("k < 1000000").select("k", "i", "before", "after", "event_code", "reason").collect()}
    assert got == walked(rows)
    before = out.count()
    drain()
    assert spark.read.parquet(str(tmp_path / "out")).count() == before
