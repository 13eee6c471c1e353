"""Registers on rows that the test tables lack."""

from __future__ import annotations

from offerlens import plans


def test_halves_go_to_the_even_number(spark, tmp_path):
    rows = [(1, 150.5), (2, 151.5), (3, 2.5), (3, -0.5), (4, None), (5, -7.5), (6, 0.4999999999), (7, 2.4999999), (8, 150.50000001)]
    spark.createDataFrame(rows, "user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r.next_no for r in plans.QUERIES["agg_max_plus_one"](spark, str(tmp_path)).collect()}
    assert got == {1: 151, 2: 153, 3: 3, 4: 1, 5: -7, 6: 1, 7: 3, 8: 152}
