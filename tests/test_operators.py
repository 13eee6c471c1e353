from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import strings, vectors
from offerlens.operators import rows, scoring
from offerlens.streaming import event_log


def test_latest_breaks_ties_by_the_last_key(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 1, 9), (None, 3, 3)], "k int, ts int, id int")
    assert sorted(map(tuple, rows.latest_per_key(df, ["k"], ["ts", "id"]).collect()), key=str) == [(1, 5, 2), (2, 1, 9), (None, 3, 3)]
    assert rows.latest_per_key(df.limit(0), ["k"], ["ts"]).count() == 0


def test_budget_cuts_the_last_row(spark):
    df = spark.createDataFrame([(1, 1, 70), (1, 2, 50), (1, 3, 10)], "k int, i int, n int")
    assert [(r.i, r.used) for r in rows.within_budget(df, ["k"], [F.col("i")], F.col("n"), 100).orderBy("i").collect()] == [(1, 70), (2, 30)]


def test_upsert_keeps_old_values_where_new_ones_are_null(spark):
    a = spark.createDataFrame([(1, "x", "old", 0)], "k int, a string, b string, v int")
    b = spark.createDataFrame([(1, None, "new", 1), (2, "y", None, 1)], "k int, a string, b string, v int")
    assert sorted(map(tuple, rows.upsert(a, b, ["k"], ["v"]).collect())) == [(1, "x", "new", 1), (2, "y", None, 1)]


def test_unmatched_ids(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    assert tuple(rows.unmatched(ids("a", "b", " a", ""), ids("b", "c", None)).first()) == (2, 2, 1, 1, False)


def test_scores(spark):
    df = spark.createDataFrame([(40.0, "low"), (12.0, "critical"), (-1.0, "odd")], "m double, s string")
    got = df.select(scoring.margin_points(F.col("m")), scoring.escalated(F.col("s"), F.lit(1))).collect()
    assert [tuple(r) for r in got] == [(30, "medium"), (0, "critical"), (-30, "high")]


def test_urls_and_vectors(spark):
    df = spark.createDataFrame([("HTTPS://www.Web.example/a/?utm_source=x&b=1#f", [3.0, 4.0], [0.0, 0.0])], "u string, a array<float>, b array<float>")
    r = df.select(strings.normal_url(F.col("u")), vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("a"))).first()
    assert tuple(r) == ("https://web.example/a?b=1", 5.0, 0.0, 1.0)


def test_stream_counts_equal_the_table(spark, tmp_path):
    rows_ = [(i, f"2024-01-01 0{i % 3}:00:0{i % 10}", i % 2) for i in range(12)]
    df = spark.createDataFrame(rows_, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    s = event_log.window_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    s.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    key = lambda d: sorted(tuple(r) for r in d.select("user_id", "start", "n", "allowed").collect())
    assert key(spark.table("counts")) == key(event_log.window_counts(df))
