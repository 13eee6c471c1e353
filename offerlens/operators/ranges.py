"""Values that a key's earlier rows carry to later ones, with keys cut into stretches so that no task sorts a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_in_key(rows: DataFrame, key: Sequence[str], order: str, value: str, name: str, width: int) -> DataFrame:
    """`rows` with the value of the row before it of the same key, by the whole number `order`; null for a key's first row.

    Keys are cut into stretches of `width` of the order, so no task sorts a whole key: the first row of a stretch takes the last
    value of the stretch before, of which a key has few. Rows with a null in the key have no row before.
    """
    at = rows.withColumn("stretch", F.floor(F.col(order) / width))
    lasts = at.dropna(subset=list(key)).groupBy(*key, "stretch").agg(F.max(F.struct(F.col(order).alias("at"), F.col(value).alias("value"))).alias("last"))
    over = F.lag("last.value").over(Window.partitionBy(*key).orderBy("stretch"))
    before = lasts.select(*key, "stretch", over.alias("carried"))
    within = F.lag(value).over(Window.partitionBy(*key, "stretch").orderBy(order))
    first = F.row_number().over(Window.partitionBy(*key, "stretch").orderBy(order)) == 1
    out = at.withColumn("within", within).withColumn("is_first", first).join(before, [*key, "stretch"], "left")
    none = F.lit(False)
    for k in key:
        none = none | F.col(k).isNull()
    return out.withColumn(name, F.when(~none, F.when(F.col("is_first"), F.col("carried")).otherwise(F.col("within")))).drop("stretch", "within", "is_first", "carried")


def last_known(rows: DataFrame, key: Sequence[str], order: Sequence[str], stretch: Column, value: str, name: str) -> DataFrame:
    """`rows` with the last value of the key up to and with the row that is not null, by the columns `order`; null where there is none.

    `stretch` is a whole number that never falls along the order (of the time, say); a window covers one stretch of a key, and what
    earlier stretches leave comes from a table of one row a stretch. Rows with a null in the key are without a last value.
    """
    at = rows.withColumn("__stretch", stretch)
    lasts = at.filter(F.col(value).isNotNull()).dropna(subset=list(key)).groupBy(*key, "__stretch").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    spans = at.dropna(subset=list(key)).select(*key, "__stretch").distinct().join(lasts, [*key, "__stretch"], "left")
    earlier = F.last("__last", ignorenulls=True).over(Window.partitionBy(*key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    before = spans.select(*key, "__stretch", earlier.alias("__carried"))
    within = F.last(value, ignorenulls=True).over(Window.partitionBy(*key, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    out = at.withColumn("__within", within).join(before, [*key, "__stretch"], "left")
    return out.withColumn(name, F.when(known, F.coalesce("__within", "__carried"))).drop("__stretch", "__within", "__carried")
