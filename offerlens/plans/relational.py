"""Filters, joins, aggregates, windows, sorts and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import folds, rows
from .registry import Tables, query


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def money(c: Column) -> Column:
    """A sum of amounts that does not depend on the order of rows."""
    return F.sum(c.cast("decimal(18,4)")).cast("double")


@query("select * from region")
def scan_table(t: Tables) -> DataFrame:
    return t.region


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'O'")
def filter_eq_optional(t: Tables, status: str | None = "O") -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.filter(F.col("o_orderstatus") == status) if status is not None else o


@query("select p_partkey, p_name from part where p_name ilike '%re%' or p_brand ilike '%re%' or p_type ilike '%re%'")
def filter_ilike_or(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").ilike("%re%") | F.col("p_brand").ilike("%re%") | F.col("p_type").ilike("%re%")).select("p_partkey", "p_name")


@query("select c_custkey, c_name from customer where c_name ilike '%1%' or c_mktsegment ilike '%build%'")
def filter_ilike_customer(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_name").ilike("%1%") | F.col("c_mktsegment").ilike("%build%")).select("c_custkey", "c_name")


@query("select l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_name is not null and lower(c_name) like '%99%'")
def filter_lower_like(t: Tables) -> DataFrame:
    c = t.customer.filter(F.col("c_name").isNotNull() & F.lower("c_name").contains("99")).select(F.col("c_custkey").alias("o_custkey"))
    o = t.orders.join(c, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(o, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("select count(*) n from part where p_name is not null and p_name not like 'a%'")
def filter_not_like_notnull(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").isNotNull() & ~F.col("p_name").like("a%")).agg(F.count("*").alias("n"))


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus in ('F', 'O')")
def filter_in_list(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@query("select count(*) filter (length(trim(text)) > 0) non_blank, count(*) n from documents")
def filter_length_trim(t: Tables) -> DataFrame:
    return t.documents.agg(F.count_if(F.length(F.trim("text")) > 0).alias("non_blank"), F.count("*").alias("n"))


@query("select p_partkey from part where contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand') and contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '1')")
def filter_text_all_tokens(t: Tables) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return t.part.filter(F.forall(F.split(F.lit("brand 1"), " "), lambda w: hay.contains(w))).select("p_partkey")


@query("with o as (select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end p from orders) select o_orderkey from o where p between 1000 and 150000")
def filter_price_range_null(t: Tables, low: float | None = 1000, high: float | None = 150000) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    inside = F.coalesce((price >= low if low is not None else F.lit(True)) & (price <= high if high is not None else F.lit(True)), F.lit(low is None))
    return t.orders.filter(inside).select("o_orderkey")


@query("select o_orderkey from orders where o_orderdate is null or o_orderdate between timestamp '1995-01-01' and timestamp '1996-12-31'")
def filter_date_range_null(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.filter(d.isNull() | d.between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))).select("o_orderkey")


@query("""select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice between 20000 and 200000
  and o_orderdate >= timestamp '1995-06-01' and lower(o_orderpriority) like '%medium%' order by o_totalprice desc, o_orderkey limit 50""")
def filter_compound_first(t: Tables) -> DataFrame:
    o = t.orders.filter((F.col("o_orderstatus") == "O") & F.col("o_totalprice").between(20000, 200000) & (F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp_ntz")) & F.lower("o_orderpriority").contains("medium"))
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


HOSTS = ("http://localhost:8080/a", "https://127.0.0.1/x", "http://[::1]/", "http://0.0.0.0", "http://10.1.2.3/a", "http://172.16.0.9", "http://172.32.0.1", "http://192.168.5.5/q", "http://127.0.0.2/", "file:///etc/hosts", "ftp://x.org/a", "about:blank", "https://user@192.168.1.1:80/", "http://10.example.org/")


@query("with u(url) as (select url from pages union all values " + ", ".join(f"('{h}')" for h in HOSTS) + """), h as (select url, split_part(url, ':', 1) s,
 regexp_extract(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^.*@', ''), '^(\\[.*\\]|[^:]*)') h from u)
 select url from h where s in ('file', 'ftp', 'chrome', 'about') or h in ('localhost', '127.0.0.1', '[::1]', '0.0.0.0') or (regexp_matches(h, '^[0-9.]+$') and (starts_with(h, '10.') or starts_with(h, '192.168.')
 or (starts_with(h, '172.') and try_cast(split_part(h, '.', 2) as int) between 16 and 31)))""")
def filter_private_url(t: Tables) -> DataFrame:
    urls = t.pages.select("url").union(t.spark.createDataFrame([(h,) for h in HOSTS], "url string"))
    return urls.filter(strings.is_private(F.col("url")))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then '***' else c_name end shown from customer")
def redaction_projection(t: Tables, role: str = "viewer") -> DataFrame:
    hide = (F.col("c_mktsegment") == "BUILDING") & F.lit(role != "admin")
    return t.customer.select("c_custkey", F.when(hide, "***").otherwise(F.col("c_name")).alias("shown"))


@query("select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey")
def join_inner_equi(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("select l_orderkey, l_linenumber, o_orderstatus, c_mktsegment from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_quantity > 45")
def join_inner_2way_ctx(t: Tables) -> DataFrame:
    j = t.lineitem.filter("l_quantity > 45").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_mktsegment")


@query("select count(*) n from embeddings join labels on vec_id = doc_id where quality = 1")
def join_inner_count(t: Tables) -> DataFrame:
    return t.embeddings.join(t.labels.filter("quality = 1"), F.col("vec_id") == F.col("doc_id")).agg(F.count("*").alias("n"))


@query("select c_custkey, count(o_orderkey) n_orders, max(o_orderkey) last_order from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by 1")
def join_left_outer(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderstatus = 'F'")
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.max("o_orderkey").alias("last_order"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def join_anti_not_exists(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_partkey is not null and l_quantity > 49)")
def join_anti_not_in(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.filter("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("select vec_id, label from embeddings where vec_id in (select doc_id from labels where quality = 1)")
def join_semi_id_set(t: Tables) -> DataFrame:
    return t.embeddings.join(t.labels.filter("quality = 1"), F.col("vec_id") == F.col("doc_id"), "left_semi").select("vec_id", "label")


@query("""select p_partkey, coalesce(a.s, b.s) supplier from part
  left join (select l_partkey, max(l_suppkey) s from lineitem where l_returnflag = 'R' group by 1) a on a.l_partkey = p_partkey
  left join (select l_partkey, max(l_suppkey) s from lineitem group by 1) b on b.l_partkey = p_partkey""")
def join_composite_fallback(t: Tables) -> DataFrame:
    by = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("a"), F.max("l_suppkey").alias("b"))
    return t.part.join(by, "p_partkey", "left").select("p_partkey", F.coalesce("a", "b").alias("supplier"))


@query("select s_suppkey, n_parts, n_flags from supplier left join (select l_suppkey, count(distinct l_partkey) n_parts, count(distinct l_returnflag) n_flags from lineitem group by 1) on l_suppkey = s_suppkey")
def join_tag_aggregate(t: Tables) -> DataFrame:
    tags = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_returnflag").alias("n_flags"))
    return t.supplier.join(tags, "s_suppkey", "left").select("s_suppkey", "n_parts", "n_flags")


@query("""with e as (select user_id, ts, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) prev from events),
  rules(a, b) as (values ('view', 'click'), ('click', 'purchase'), ('signup', 'view'), ('view', 'view'), ('click', 'view'))
  select event_id, prev, event_type, exists (select 1 from rules where a = prev and b = event_type) allowed from e where prev is not null""")
def join_rule_membership(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view"), ("click", "view")], "prev string, event_type string").withColumn("hit", F.lit(True))
    e = t.events.withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("prev is not null")
    return e.join(rules, ["prev", "event_type"], "left").select("event_id", "prev", "event_type", F.coalesce("hit", F.lit(False)).alias("allowed"))


@query("""with o as (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders) where r = 1),
  l as (select * from (select l_orderkey, l_linenumber, l_shipdate, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc) r from lineitem) where r = 1)
  select c_custkey, o_orderkey last_order, l_linenumber last_line from customer left join o on o_custkey = c_custkey left join l on l_orderkey = o_orderkey""")
def load_context_multi(t: Tables) -> DataFrame:
    o = rows.latest_per_key(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    li = rows.latest_per_key(t.lineitem.select("l_orderkey", "l_shipdate", "l_linenumber"), ["l_orderkey"], ["l_shipdate", "l_linenumber"])
    j = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("c_custkey", F.col("o_orderkey").alias("last_order"), F.col("l_linenumber").alias("last_line"))


@query("select count(*) n, count(distinct o_custkey) customers, count(*) filter (o_orderstatus = 'F') finished, count(*) filter (o_orderstatus = 'O') open, count(o_totalprice) priced from orders")
def agg_multi_status_counts(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.count_if(s == "F").alias("finished"), F.count_if(s == "O").alias("open"), F.count("o_totalprice").alias("priced"))


@query("select coalesce(sum(length(text) // 4), 0)::bigint tokens, count(distinct source) sources, count(*) n from documents where length(trim(text)) > 0")
def agg_sum_coalesce(t: Tables) -> DataFrame:
    d = t.documents.filter(F.length(F.trim("text")) > 0)
    return d.agg(F.coalesce(F.sum(F.expr("length(text) div 4")), F.lit(0)).alias("tokens"), F.countDistinct("source").alias("sources"), F.count("*").alias("n"))


@query("select round(coalesce(avg(o_totalprice::decimal(18,2)), 0), 2) avg_price, count(*) filter (o_totalprice < 1000) small from orders")
def agg_avg_global(t: Tables) -> DataFrame:
    return t.orders.agg(F.round(F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("o_totalprice"), F.lit(0.0)), 2).alias("avg_price"), F.count_if(F.col("o_totalprice") < 1000).alias("small"))


@query("""select o_custkey, unnest(['orders', 'open', 'suppliers']) metric, unnest([n, o, s]) value from
  (select o_custkey, count(distinct o_orderkey) n, count(distinct case when o_orderstatus = 'O' then o_orderkey end) o, count(distinct l_suppkey) s from orders join lineitem on l_orderkey = o_orderkey group by 1)""")
def agg_deal_metrics(t: Tables) -> DataFrame:
    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    m = j.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n"), F.countDistinct(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("o"), F.countDistinct("l_suppkey").alias("s"))
    return m.select("o_custkey", F.expr("stack(3, 'orders', n, 'open', o, 'suppliers', s) as (metric, value)"))


@query("select 'customer' metric, count(*) n from customer union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem union all select 'part', count(*) from part")
def agg_pipeline_metrics(t: Tables) -> DataFrame:
    one = lambda name: getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    return one("customer").union(one("orders")).union(one("lineitem")).union(one("part"))


@query("select event_type, count(*) n, count(distinct user_id) users, bool_or(value > 90) any_high from events group by 1")
def agg_severity_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.bool_or(F.col("value") > 90).alias("any_high"))


@query("select source, count(*) n from documents group by 1 order by n desc, source limit 10")
def agg_topn_counter(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("select lang, count(*) n, sum(n_chars)::bigint chars, count(distinct source) sources, count(*) filter (n_chars > 2000) long_docs from documents group by 1")
def agg_status_histogram(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"), F.count_if(F.col("n_chars") > 2000).alias("long_docs"))


@query("select l_suppkey, round(sum(l_extendedprice::decimal(18,4))::double, 2) total, median(l_quantity) mid_quantity, round(avg((l_returnflag <> 'R')::int), 4) kept_share from lineitem group by 1")
def agg_supplier_quote(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey")
    return g.agg(F.round(money(F.col("l_extendedprice")), 2).alias("total"), F.median("l_quantity").alias("mid_quantity"), F.round(F.avg((F.col("l_returnflag") != "R").cast("int")), 4).alias("kept_share"))


@query("""select l_partkey, count(*) offers, min(l_extendedprice) low, max(l_extendedprice) high, arg_min(l_suppkey, (l_extendedprice, l_suppkey, l_orderkey, l_linenumber)) best,
  round((max(l_extendedprice) - min(l_extendedprice)) / min(l_extendedprice) * 100, 2) spread, count(distinct l_linestatus) > 1 or bool_or(l_discount > 0.09) review from lineitem group by 1""")
def agg_price_spread(t: Tables) -> DataFrame:
    p = F.col("l_extendedprice")
    low, high = F.min(p), F.max(p)
    return t.lineitem.groupBy("l_partkey").agg(
        F.count("*").alias("offers"), low.alias("low"), high.alias("high"), F.min_by("l_suppkey", F.struct(p, "l_suppkey", "l_orderkey", "l_linenumber")).alias("best"),
        F.round((high - low) / low * 100, 2).alias("spread"), ((F.countDistinct("l_linestatus") > 1) | F.bool_or(F.col("l_discount") > 0.09)).alias("review"),
    )


@query("select l_returnflag, min(l_quantity) low, max(l_quantity) high, quantile_disc(l_quantity, 0.5) p50, quantile_disc(l_quantity, 0.75) p75, quantile_disc(l_quantity, 0.9) p90, round(count(l_quantity) / count(*) * 100, 1) coverage from lineitem group by 1")
def agg_ingestion_percentiles(t: Tables) -> DataFrame:
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by l_quantity)").alias(f"p{int(p * 100)}")
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.min(q).alias("low"), F.max(q).alias("high"), disc(0.5), disc(0.75), disc(0.9), F.round(F.count(q) / F.count("*") * 100, 1).alias("coverage"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum((l_extendedprice * (1 - l_discount))::decimal(18,4))::double, 4) revenue, count(*) n from lineitem group by 1, 2")
def agg_schema_totals(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(money(revenue()), 4).alias("revenue"), F.count("*").alias("n"))


@query("""select round(tp / nullif(tp + fp, 0), 4) prec, round(tp / nullif(tp + fn, 0), 4) recall, n from
  (select count(*) filter (toxic = 1 and quality = 1) tp, count(*) filter (toxic = 1 and quality = 0) fp, count(*) filter (toxic = 0 and quality = 1) fn, count(*) n from labels)""")
def agg_truth_pack_scores(t: Tables) -> DataFrame:
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    c = t.labels.agg(F.count_if(x & q).alias("tp"), F.count_if(x & ~q).alias("fp"), F.count_if(~x & q).alias("fn"), F.count("*").alias("n"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 4)
    return c.select(ratio("tp", "fp").alias("prec"), ratio("tp", "fn").alias("recall"), "n")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def latest_per_parent(t: Tables) -> DataFrame:
    return rows.latest_per_key(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select l_partkey, l_suppkey, l_orderkey, l_extendedprice from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) r from lineitem) where r = 1")
def latest_quote(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.latest_per_key(li, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice")


@query("select l_orderkey, string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey) parts from lineitem group by 1")
def ordered_children(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    return a.select("l_orderkey", F.array_join(F.transform("a", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("select o_orderkey, format('ORD-{}-{:06d}', year(o_orderdate), row_number() over (partition by year(o_orderdate) order by o_orderdate, o_orderkey)) code from orders")
def business_id_next(t: Tables) -> DataFrame:
    rows_ = t.orders.select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"), F.lit(1).cast("long").alias("one"))
    n = folds.running(rows_, "y", ["o_orderdate", "o_orderkey"], "one", "n")
    return n.select("o_orderkey", F.format_string("ORD-%d-%06d", "y", "n").alias("code"))


@query("select doc_id, source, least(n_chars, 12000 - b) used from (select *, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint b from documents) where b < 12000 and n_chars > 0")
def context_budget_cut(t: Tables) -> DataFrame:
    return rows.within_budget(t.documents.select("doc_id", "source", "n_chars"), ["source"], [F.col("doc_id")], F.col("n_chars"), 12000).select("doc_id", "source", "used")


@query("select p_partkey, p_name, count(*) over (partition by lower(trim(p_name))) same_name from part")
def duplicate_name_count(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", F.count("*").over(Window.partitionBy(F.lower(F.trim("p_name")))).alias("same_name"))


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20 offset 10")
def limit_offset_page(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(20)


@query("select event_id from events where (ts, event_id) < (select (ts, event_id) from events where event_id = (select max(event_id) // 2 from events)) order by ts desc, event_id desc limit 25")
def cursor_page(t: Tables) -> DataFrame:
    mid = t.events.agg(F.expr("max(event_id) div 2").alias("event_id"))
    at = t.events.join(F.broadcast(mid), "event_id").select(F.struct("ts", "event_id").alias("cursor"))
    return t.events.join(F.broadcast(at), F.struct("ts", "event_id") < F.col("cursor")).orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id")


@query("select o_custkey, count(*) n from orders group by 1 order by n desc, o_custkey limit 10")
def topk_customers(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("select 'finance' kind, o_orderkey id, 'price' code from orders where o_totalprice > 300000 union all select 'supplier', s_suppkey, 'balance' from supplier where s_acctbal < 0 union all select 'quote', l_orderkey, 'discount' from lineitem where l_discount >= 0.1")
def union_risk_items(t: Tables) -> DataFrame:
    f = t.orders.filter("o_totalprice > 300000").select(F.lit("finance").alias("kind"), F.col("o_orderkey").alias("id"), F.lit("price").alias("code"))
    s = t.supplier.filter("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.lit("balance").alias("code"))
    q = t.lineitem.filter("l_discount >= 0.1").select(F.lit("quote").alias("kind"), F.col("l_orderkey").alias("id"), F.lit("discount").alias("code"))
    return f.unionByName(s).unionByName(q)


@query("""with e as (select distinct trim(doc_id::varchar) id from documents), o as (select distinct trim(doc_id::varchar) id from labels)
  select (select count(*) from e) expected, (select count(*) from o) observed, (select count(*) from (from e except from o)) missing, (select count(*) from (from o except from e)) unexpected,
  (select count(*) from (from e except from o)) = 0 and (select count(*) from (from o except from e)) = 0 is_match""")
def compare_id_sets(t: Tables) -> DataFrame:
    ids = lambda df: df.select(F.col("doc_id").cast("string").alias("id"))
    return rows.unmatched(ids(t.documents), ids(t.labels))


@query("select doc_id, source, row_number() over (partition by source order by doc_id) - 1 new_index from (select *, row_number() over (partition by source, sha256(text) order by doc_id) r from documents) where r = 1")
def dedup_hash_first(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = d.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"))
    numbered = folds.running(first.select("doc_id", "source", F.lit(1).cast("long").alias("one")), "source", ["doc_id"], "one", "n")
    return numbered.select("doc_id", "source", (F.col("n") - 1).alias("new_index"))


@query("select sha256(text) sha, min(doc_id) doc_id, count(*) versions, max(n_chars) n_chars from documents group by 1")
def merge_dupe_documents(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("versions"), F.max("n_chars").alias("n_chars"))


@query("""with n as (select c_custkey k, o_totalprice p, o_orderkey v from customer join orders on o_custkey = c_custkey where o_orderstatus = 'F' union all select c_custkey, null, -1 from customer)
  select k, arg_max(p, v) filter (p is not null) p, max(v) v from n group by 1""")
def upsert_customer(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_custkey").alias("k"), F.lit(None).cast("double").alias("p"), F.lit(-1).cast("long").alias("v"))
    new = t.orders.filter("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("v"))
    return rows.upsert(old, new, ["k"], ["v"])


@query("select o_orderkey, datediff('day', o_orderdate::date, max(l_shipdate)::date) cycle_days, count(distinct l_suppkey) suppliers, round(sum((l_extendedprice * (1 - l_discount))::decimal(18,4))::double, 4) revenue from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate")
def kpi_cycle_margin(t: Tables) -> DataFrame:
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("s"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(money(revenue()), 4).alias("revenue"))
    return t.orders.join(li, "o_orderkey").select("o_orderkey", F.datediff("s", "o_orderdate").cast("long").alias("cycle_days"), "suppliers", "revenue")
