"""Ladders, penalties and decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: list[tuple[float, object]], other: object) -> Column:
    """The result of the first step whose bound value reaches."""
    out = None
    for bound, result in steps:
        out = F.when(value >= bound, result) if out is None else out.when(value >= bound, result)
    return out.otherwise(other)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in pairs)), lambda x: x.isNotNull())


# Fixed values of the scoring rules.
MARGIN = [(35, 30), (25, 20), (20, 10), (10, 0)]
PROFIT = [(100000, 30), (50000, 20), (20000, 10), (5000, 5)]
ROI = [(50, 20), (30, 10), (15, 5)]
DECISION = [(60, "strong_recommend"), (30, "recommend"), (10, "watch"), (-10, "needs_manual_review")]
RISK_LEVELS = [(100, "critical"), (60, "high"), (25, "medium")]
SEVERITIES = ["low", "medium", "high", "critical"]


def margin_points(margin: Column) -> Column:
    return ladder(margin, MARGIN, -30)


def profit_points(profit: Column) -> Column:
    return ladder(profit, PROFIT, 0)


def deadline_points(hours: Column) -> tuple[Column, Column]:
    """Points and state of the hours that are left; null counts as active at a small cost."""
    points = F.when(hours.isNull(), -10).when(hours <= 0, -100).when(hours < 3, -30).when(hours < 12, -10).when(hours < 24, 3).otherwise(10)
    state = F.when(hours.isNull(), "active").when(hours <= 0, "expired").when(hours < 24, "soon").otherwise("active")
    return points, state


def cash_points(profit: Column, cash: Column) -> tuple[Column, Column]:
    """Points and return in per cent on the cash that is needed; both 0 without such."""
    roi = profit / cash * 100
    return F.when(cash <= 0, 0).otherwise(ladder(roi, ROI, -10)), F.when(cash <= 0, 0.0).otherwise(roi)


def escalated(level: Column, steps: Column) -> Column:
    """A severity raised by steps, at most to critical; unknown ones count as medium."""
    levels = F.array(*map(F.lit, SEVERITIES))
    at = F.array_position(levels, level)
    return F.element_at(levels, F.least(F.when(at == 0, 2).otherwise(at) + steps, F.lit(len(SEVERITIES))).cast("int"))
