"""Latest rows, ordered children, numbering, budgets, deduplication and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import running


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by `order`. As an aggregate, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return top.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is first by `order`."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return top.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank_order") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank_order") -> DataFrame:
    return ranked(df, keys, order, name).filter(F.col(name) <= n)


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each key in order until their sizes reach the budget; `used` is what the row may use, the last is cut. Running sums are
    taken over ranges, so no key is summed in one task."""
    key = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    at = [f"__at{i}" for i in range(len(order))]
    plain = df.withColumns({"__key": key, "__size": size.cast("long"), **dict(zip(at, order, strict=True))})
    upto = running(plain, "__key", at, "__size", "__upto")
    before = F.col("__upto") - F.coalesce("__size", F.lit(0))
    return upto.withColumn("used", F.least("__size", budget - before)).filter("used > 0").select(*df.columns, "used")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keys of both; of each the latest value that is not null, column by column, changes being later rows by `order`."""
    both = current.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    at = F.struct(*order)
    return both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest))


def without_known(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in `known`."""
    return df.join(known.select(*keys), keys, "left_anti")


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Summary of two sets of ids (column id): expected, observed, missing, unexpected, is_match."""
    both = left.select("id", F.lit(1).alias("e"), F.lit(0).alias("o")).union(right.select("id", F.lit(0), F.lit(1)))
    per = both.filter("id is not null and trim(id) <> ''").groupBy(F.trim("id").alias("id")).agg(F.max("e").alias("e"), F.max("o").alias("o"))
    s = per.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("expected"), F.coalesce(F.sum("o"), F.lit(0)).alias("observed"), F.count_if(F.expr("e = 1 and o = 0")).alias("missing"), F.count_if(F.expr("e = 0 and o = 1")).alias("unexpected"))
    return s.withColumn("is_match", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def nearest_ranks(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """(keys..., p, value): the value at rank ceil(p / 100 * n), at least the first, for each percentage.

    Values are counted before they are ranked, and the counts are summed over ranges: neither a group's rows nor its distinct
    values meet in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).count()
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("n")).select(F.struct(*keys).alias("__key"), "n")
    cum = running(counts.withColumn("__key", F.struct(*keys)), "__key", [value], "count", "upto")
    cum = cum.join(totals.withColumnRenamed("__key", "__of"), F.col("__key").eqNullSafe(F.col("__of")))
    at = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) / 100 * F.col("n"))), F.col(value)))
    found = cum.groupBy(*keys).agg(F.array(*(F.struct(F.lit(p).alias("p"), at(p).alias("value")) for p in percents)).alias("all"))
    return found.select(*keys, F.inline("all"))
