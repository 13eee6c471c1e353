"""Deadlines in working hours, through a calendar of working days."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The zone and hours of the working day, and hours allowed by severity.
ZONE, START, END = "Europe/Moscow", datetime.time(9), datetime.time(18)
HOURS = {"sev1": 4, "sev2": 9, "sev3": 45}
MICRO = 1_000_000


def calendar(rows: DataFrame, at: Column, days_ahead: int, zone: str = ZONE, holidays: Iterable[datetime.date] = ()) -> DataFrame:
    """(day, works, ordinal): every day from the first time of the rows to `days_ahead` days after the last, whether it is a working day, and
    how many working days of the table come before it. One row a day of the span, whatever the number of rows."""
    local = F.to_date(F.from_utc_timestamp(at, zone))
    span = rows.agg(F.min(local).alias("low"), F.max(local).alias("high"))
    days = span.filter("low is not null").select(F.explode(F.sequence("low", F.date_add("high", days_ahead))).alias("day"))
    off = F.col("day").isin(list(holidays)) if (holidays := list(holidays)) else F.lit(False)
    works = (F.weekday("day") < 5) & ~off
    one = days.select("day", works.alias("works")).coalesce(1)
    listed = one.groupBy().agg(F.array_sort(F.collect_list(F.struct("day", "works"))).alias("d"))
    before = F.aggregate("d", F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + x["works"].cast("int")))
    return listed.select("d", before.alias("n")).select(F.posexplode("d").alias("i", "x"), "n").select("x.day", "x.works", F.get("n", F.col("i")).alias("ordinal"))


def with_deadline(rows: DataFrame, at: str, severity: str, name: str, hours: dict[str, int] | None = None, zone: str = ZONE, start: datetime.time = START, end: datetime.time = END, holidays: Iterable[datetime.date] = ()) -> DataFrame:
    """`rows` with the time (UTC) at which the hours that the severity allows have been worked since `at` (UTC).

    Working time is a line: working days before, times their length, plus what has passed of the day. The deadline is the point so
    many seconds further on, and the working day of its number gives the date: two joins with the calendar, no walk from day to day.
    A deadline at the end of a day stays on that day; where it falls on a later day, parts of a second at the start are dropped. Null times
    and other severities have no deadline.
    """
    hours = hours or HOURS
    length = (datetime.datetime.combine(datetime.date.min, end) - datetime.datetime.combine(datetime.date.min, start)).seconds
    opens = start.hour * 3600 + start.minute * 60 + start.second
    days = 14 + 2 * max(hours.values()) * 3600 // length + len(list(holidays := list(holidays)))
    cal = calendar(rows, F.col(at), days, zone, holidays)
    local = F.from_utc_timestamp(F.col(at), zone)
    today = cal.select(F.col("day").alias("__day"), F.col("works").alias("__works"), F.col("ordinal").alias("__ordinal"))
    then = cal.filter("works").select(F.col("day").alias("__then"), F.col("ordinal").alias("__target"))
    allowed = F.coalesce(*(F.when(F.col(severity) == k, h * 3600 * MICRO) for k, h in hours.items()))
    passed = F.unix_micros(local) - F.unix_micros(F.to_date(local).cast("timestamp")) - opens * MICRO
    spent = F.when(F.col("__works"), F.greatest(F.lit(0), F.least(passed, F.lit(length * MICRO)))).otherwise(F.lit(0))
    a = rows.withColumn("__day", F.to_date(local)).join(today, "__day", "left").withColumn("__spent", spent).withColumn("__need", allowed)
    within = F.col("__need") <= F.floor((length * MICRO - F.col("__spent")) / MICRO) * MICRO
    whole = F.ceil(F.col("__spent") / MICRO) * MICRO
    total = F.when(within, F.col("__spent")).otherwise(whole) + F.col("__need")
    b = a.withColumn("__total", F.col("__ordinal") * F.lit(length * MICRO) + total).withColumn("__target", F.floor((F.col("__total") - 1) / (length * MICRO)))
    c = b.join(then, "__target", "left")
    offset = F.col("__total") - F.col("__target") * F.lit(length * MICRO) + opens * MICRO
    when = F.to_utc_timestamp(F.timestamp_micros(F.unix_micros(F.col("__then").cast("timestamp")) + offset), zone)
    return c.withColumn(name, when).select(*rows.columns, name)
