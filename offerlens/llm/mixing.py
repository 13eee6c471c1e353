"""Mixing sources to target weights: hash-threshold histograms, without a sort of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept
from .text import n_words

#: Bits of a document's hash, and of it that one histogram resolves.
BITS, STEP = 60, 12


def doc_hash(id_col: Column, seed: str = "mix") -> Column:
    """60 bits of an MD5 of the id as a long, the same in every run and on every cluster; null ids share one value."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): targets share ratio times all sizes by weight, up to most times a source's size.

    Weights go to the sources in order of code points, null last, and repeat. What a stopped source leaves is shared again by
    weight until none is above: with sources in order of limit / weight, the first that need not stop gives the level.
    The table has one row a source, so the windows over all of it are small.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", F.get(F.array(*map(F.lit, weights)), rank % len(weights)).cast("double")).withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(ratio)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("free", F.col("level") < F.col("cap") / F.col("w"))
    level = F.max(F.when(F.col("free"), F.col("level"))).over(every)
    return s.select("source", "source_size", F.when(F.col("free"), F.col("w") * level).otherwise(F.col("cap")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): rows (source, size, h) with h < below sum to at most the source's budget, and to more with the next hash.

    Each pass sums sizes by source and bucket of the hash, finds the bucket in which the budget runs out, and the next pass
    reads that bucket alone in finer steps, until the hash is used up. A pass shuffles at most 2^12 partial sums a source.
    """
    bounds = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("below"), F.lit(True).alias("open"))
    for shift in range(BITS - STEP, -1, -STEP):
        at = bounds.withColumnRenamed("source", "__source")
        inside = rows.join(at, rows["source"].eqNullSafe(at["__source"]) & at["open"] & (F.shiftright("h", shift + STEP) == F.shiftright("below", shift + STEP)))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        upto = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        over = upto.filter("upto > left").groupBy(F.col("source").alias("__source")).agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("size")).alias("rest")), "bucket").alias("at"))
        joined = bounds.join(over, bounds["source"].eqNullSafe(over["__source"]), "left")
        hit = F.col("at").isNotNull()
        bounds = kept(
            joined.select(
                "source",
                F.when(hit, F.col("at.rest")).otherwise(F.col("left")).alias("left"),
                F.when(hit, F.shiftleft("at.bucket", shift)).otherwise(F.when(F.col("open"), F.lit(1 << BITS)).otherwise(F.col("below"))).alias("below"),
                (F.col("open") & hit).alias("open"),
            ),
            "mix-bounds",
        )
    return bounds.select("source", "below")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, h): words of each text (null and empty: 0) and a hash of its id; a row for each row of docs."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), doc_hash(F.col(id_col), seed).alias("h"))


def plan(rows: DataFrame, **options) -> DataFrame:
    """(source, source_size, target, whole, below): each document is taken `whole` times, once more if its hash is below `below`."""
    t = kept(targets(rows, **options), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("whole", whole)
    budgets = t.select("source", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long").alias("budget"))
    cut = thresholds(rows, budgets).withColumnRenamed("source", "__source")
    return kept(t.join(cut, t["source"].eqNullSafe(cut["__source"])).drop("__source"), "mix-plan")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every document; copies 0 to 2 at the default limits.

    Null texts have size 0; null sources are a source of their own, the last; rows that repeat an id share its hash and so
    its fate; an empty table gives an empty result; other columns are not read.
    """
    rows = kept(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    p = plan(rows, **options).withColumnRenamed("source", "__source")
    joined = rows.join(p, rows["source"].eqNullSafe(p["__source"]))
    copies = F.col("whole") + (F.col("h") < F.col("below")).cast("long")
    copies = F.when(F.col("whole") * F.col("source_size") >= F.col("target"), F.col("whole")).otherwise(copies)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The documents as often as the mix takes them, with the columns of docs. Texts are not shuffled.

    Null and empty texts add no words and come as often as their hash says; null sources are one source, the last; null ids hash alike;
    repeated rows come equally often; an empty table gives an empty result; other columns may have any name.
    """
    rows = kept(sized(docs, seed=seed), "mix-sizes")
    p = plan(rows, **options).select(F.col("source").alias("__source"), "source_size", "target", "whole", "below")
    # own names for the columns of docs, which may be called anything
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    hashed = docs.toDF(*at.values()).withColumn("__h", doc_hash(F.col(at["doc_id"]), seed))
    joined = hashed.join(p, F.col(at["source"]).eqNullSafe(F.col("__source")))
    extra = (F.col("__h") < F.col("below")) & (F.col("whole") * F.col("source_size") < F.col("target"))
    copies = (F.col("whole") + extra.cast("long")).cast("int")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*at.values()).toDF(*docs.columns)


SQL = r"""
with rows as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
  cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) h from documents),
s as (select source, cast(sum(size) as bigint) source_size from rows group by 1),
r as (select *, cast([3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) w, source_size * 2.0::double cap from s),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) lv from r
  window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, case when lv < cap / w then w * max(case when lv < cap / w then lv end) over () else cap end target from l),
p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end whole from t),
c as (select doc_id, size, source_size, target, whole, cast(floor(target - whole * source_size) as bigint) budget,
  sum(size) over (partition by rows.source order by h) upto from rows join p on rows.source is not distinct from p.source)
select doc_id, size, source_size, target, size * (whole + case when whole * source_size < target and upto <= budget then 1 else 0 end) taken from c"""
