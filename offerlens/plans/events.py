"""Event log, state, rate windows, taxonomy and graph checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import Tables, query


@query("""select event_id, n <= 3 allowed, greatest(0, 3 - n)::bigint remaining, case when n > 3 then 3600 - e % 3600 else 0 end retry from
 (select event_id, epoch_us(ts) // 1000000 e, row_number() over (partition by user_id, epoch_us(ts) // 3600000000 order by ts, event_id) n from events)""")
def rate_limit_fixed_window(t: Tables, limit: int = 3, seconds: int = 3600) -> DataFrame:
    e = F.unix_seconds(F.col("ts").cast("timestamp"))
    n = F.row_number().over(Window.partitionBy("user_id", F.floor(e / seconds)).orderBy("ts", "event_id"))
    return t.events.select("event_id", n.alias("n"), e.alias("e")).select("event_id", (F.col("n") <= limit).alias("allowed"), F.greatest(F.lit(0), limit - F.col("n")).cast("long").alias("remaining"), F.when(F.col("n") > limit, seconds - F.col("e") % seconds).otherwise(0).alias("retry"))


@query("select event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) >= 60000000, true) allowed from events")
def rate_limit_min_interval(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = us(F.col("ts")) - us(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return t.events.select("event_id", F.coalesce(gap >= 60_000_000, F.lit(True)).alias("allowed"))


@query("select event_id, max(value) over (partition by user_id order by ts, event_id) peak from events")
def peak_sampling(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.max("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))


@query("select user_id, event_type, min(event_id) first_event, count(*) claims from events group by 1, 2")
def idempotency_claim(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("claims"))


@query("""with recursive e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) n from events),
 c as (select user_id, n, sha256('' || '|' || n || '|' || event_id || '|' || event_type) digest from e where n = 1
  union all select e.user_id, e.n, sha256(c.digest || '|' || e.n || '|' || e.event_id || '|' || e.event_type) from c join e on e.user_id = c.user_id and e.n = c.n + 1)
 select user_id, max(n) length, arg_max(digest, n) head from c group by 1""")
def event_hash_chain(t: Tables) -> DataFrame:
    """Each event's digest covers the digest before it, in order, per user. A chain cannot be cut, but its events stream through the task that
    follows it: only the last digest is held, however long it is."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, length, digest, ended = None, 0, "", []
        for b in batches:
            for u, i, kind in zip(*(b.column(c).to_pylist() for c in ("user_id", "event_id", "event_type")), strict=True):
                if length and u != user:
                    ended.append((user, length, digest))
                    length, digest = 0, ""
                user, length = u, length + 1
                digest = hashlib.sha256("|".join([digest, str(length), *(str(x) for x in (i, kind) if x is not None)]).encode()).hexdigest()
        if length:
            ended.append((user, length, digest))
        cols = list(zip(*ended, strict=True)) or [[]] * 3
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["user_id", "length", "head"])

    e = t.events.select("user_id", "ts", "event_id", "event_type")
    return e.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInArrow(chained, "user_id long, length long, head string")


@query("select n_name, r_name, 'world/' || r_name || '/' || n_name path, count(s_suppkey) suppliers from nation join region on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by all")
def tree_inherit(t: Tables) -> DataFrame:
    j = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("suppliers")).withColumn("path", F.concat_ws("/", F.lit("world"), "r_name", "n_name"))


@query("""select 'order_customer' code, count(*) n from orders where o_custkey not in (select c_custkey from customer) union all select 'line_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
 union all select 'line_part', count(*) from lineitem where l_partkey not in (select p_partkey from part) union all select 'quantity', count(*) from lineitem where l_quantity < 1""")
def catalog_semantics(t: Tables) -> DataFrame:
    def missing(code: str, left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
        return left.join(right, F.col(a) == F.col(b), "left_anti").agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")

    bad = t.lineitem.filter("l_quantity < 1").agg(F.count("*").alias("n")).select(F.lit("quantity").alias("code"), "n")
    return missing("order_customer", t.orders, "o_custkey", t.customer, "c_custkey").union(missing("line_order", t.lineitem, "l_orderkey", t.orders, "o_orderkey")).union(missing("line_part", t.lineitem, "l_partkey", t.part, "p_partkey")).union(bad)


@query("""select p_partkey, case when n = 0 then 'NONE' when n = 1 then 'ROUTED' else 'UNCERTAIN' end status from (select p_partkey, (contains(lower(p_type), 'brass'))::int + (contains(lower(p_type), 'steel'))::int + (contains(lower(p_type), 'standard'))::int n from part)""")
def route_category(t: Tables) -> DataFrame:
    aliases = t.spark.createDataFrame([("metal/brass", "brass"), ("metal/steel", "steel"), ("grade/standard", "standard")], "node string, alias string")
    hits = t.part.select("p_partkey", F.lower("p_type").alias("x")).join(F.broadcast(aliases), F.col("x").contains(F.col("alias"))).groupBy("p_partkey").agg(F.countDistinct("node").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return t.part.select("p_partkey").join(hits, "p_partkey", "left").select("p_partkey", F.when(n == 0, "NONE").when(n == 1, "ROUTED").otherwise("UNCERTAIN").alias("status"))
