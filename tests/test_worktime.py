"""Deadlines in working hours against a walk from day to day."""

from __future__ import annotations

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from offerlens.operators import worktime

ZONE = ZoneInfo(worktime.ZONE)


def walked(at, severity, holidays=()):
    left = worktime.HOURS.get(severity)
    if at is None or left is None:
        return None
    left *= 3600
    now = at.replace(tzinfo=dt.UTC).astimezone(ZONE)
    while True:
        opens, ends = (dt.datetime.combine(now.date(), t, tzinfo=ZONE) for t in (worktime.START, worktime.END))
        if now.weekday() < 5 and now.date() not in holidays and now < ends:
            now = max(now, opens)
            room = int((ends - now).total_seconds())
            if left <= room:
                return (now + dt.timedelta(seconds=left)).astimezone(dt.UTC).replace(tzinfo=None)
            left -= room
        now = opens.replace(hour=0) + dt.timedelta(days=1)


@pytest.mark.parametrize(
    ("at", "severity", "want"),
    [
        ("2024-01-05 14:30:00", "sev1", "2024-01-08 09:30:00"),  # Friday 17:30: half an hour, then Monday from nine
        ("2024-01-06 10:00:00", "sev2", "2024-01-08 15:00:00"),  # Saturday: all of Monday, to its last second
        ("2024-01-08 06:00:00", "sev3", "2024-01-12 15:00:00"),  # a whole week
        ("2024-01-08 15:00:00", "sev1", "2024-01-09 10:00:00"),  # at the end of the day
        ("2024-01-08 03:00:00", "sev1", "2024-01-08 10:00:00"),  # before it begins
        ("2024-01-08 03:00:00", "low", None),
        (None, "sev1", None),
    ],
)
def test_stated_cases(spark, at, severity, want):
    df = spark.createDataFrame([(at, severity)], "at string, s string").withColumn("at", F.to_timestamp("at"))
    got = worktime.with_deadline(df, "at", "s", "due").select(F.date_format("due", "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == want


def test_random_times_and_holidays(spark):
    r = random.Random(1)
    rows = [(i, dt.datetime(2024, 2, 20) + dt.timedelta(microseconds=r.randrange(20 * 86_400_000_000)), r.choice(["sev1", "sev2", "sev3", "none"])) for i in range(300)]
    off = [dt.date(2024, 2, 23), dt.date(2024, 3, 8)]
    df = spark.createDataFrame([(i, a.isoformat(), s) for i, a, s in rows], "i int, a string, s string").select("i", F.to_timestamp("a").alias("at"), "s")
    got = worktime.with_deadline(df, "at", "s", "due", holidays=off).select("i", F.col("due").cast("timestamp_ntz")).collect()
    assert {x.i: x.due for x in got} == {i: walked(a, s, off) for i, a, s in rows}
    assert worktime.with_deadline(df.limit(0), "at", "s", "due").count() == 0
