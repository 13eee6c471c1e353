"""Registers of tenders, documents and offers: guards, joins, counts, orders, identities, upserts and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chunks, rows
from ..tables import kept
from .registry import Tables, query


@query("select c_custkey, c_name from customer where c_name ilike '%00000012%' and c_mktsegment = 'BUILDING'")
def filter_ilike_single(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_name").ilike("%00000012%") & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_name")


@query("select event_id, ts from events where (props is null or props like '%\"k\": 8%') and ts >= (select max(ts) from events) - interval 20 day order by ts, event_id limit 50")
def filter_like_or_null(t: Tables) -> DataFrame:
    """Rows without a title or with a placeholder in it, of the last twenty days, oldest first."""
    last = F.broadcast(t.events.agg(F.max("ts").alias("last")))
    e = t.events.filter(F.col("props").isNull() | F.col("props").contains('"k": 8'))
    recent = e.withColumn("one", F.lit(1)).join(last.withColumn("one", F.lit(1)), "one").filter(F.col("ts") >= F.col("last") - F.expr("interval 20 days"))
    return recent.select("event_id", "ts").orderBy("ts", "event_id").limit(50)


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P')")
def filter_status_in(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


@query("select s_suppkey from supplier where not coalesce(s_acctbal < 0, false)")
def filter_soft_delete(t: Tables) -> DataFrame:
    deleted = F.coalesce(F.col("s_acctbal") < 0, F.lit(False))
    return t.supplier.filter(~deleted).select("s_suppkey")


def holds(value: Column, needle: str | None) -> Column:
    """Whether a text has the needle in any case; no needle passes, a missing text is empty."""
    return F.lit(True) if not (needle or "").strip() else F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lit(needle.strip().lower()))


@query("select p_partkey from part where contains(lower(coalesce(p_type, '')), 'steel')")
def filter_optional_contains(t: Tables, needle: str = " Steel ", other: str | None = None) -> DataFrame:
    return t.part.filter(holds(F.col("p_type"), needle) & holds(F.col("p_name"), other)).select("p_partkey")


@query("select p_partkey from part where contains(trim(lower(p_brand)), 'brand#1')")
def filter_card_text(t: Tables, needle: str = "Brand#1") -> DataFrame:
    return t.part.filter(holds(F.trim("p_brand"), needle)).select("p_partkey")


@query("select o_orderkey from (select o_orderkey, o_orderdate::date d, case when o_orderkey % 7 = 0 then null else o_orderdate::date end p from orders) where p is null or p between date '1995-01-01' and date '1996-06-30'")
def filter_card_date_range(t: Tables) -> DataFrame:
    """Cards whose printed date, in one of two formats, lies in a range; those without a readable date pass."""
    d = F.col("o_orderdate")
    printed = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    parsed = F.coalesce(F.try_to_timestamp(printed, F.lit("dd.MM.yyyy")), F.try_to_timestamp(printed, F.lit("yyyy-MM-dd"))).cast("date")
    return t.orders.filter(parsed.isNull() | parsed.between("1995-01-01", "1996-06-30")).select("o_orderkey")


CARDS = "o_orderstatus = 'O' and lower(o_orderpriority) like '%medium%'"
STATUS_SQL = "(o_orderstatus <> 'O' or o_orderdate is null or o_orderdate + interval 90 day >= timestamp '1998-01-01' - interval 2 day)"


def consistent(status: Column, deadline: Column, today: str = "1998-01-01", grace: int = 2) -> Column:
    """An open status needs a deadline that is at most `grace` days past; a missing deadline passes."""
    return (status != "O") | deadline.isNull() | (deadline >= F.lit(today).cast("timestamp_ntz") - F.make_interval(days=F.lit(grace)))


@query(f"select o_orderkey from orders where {STATUS_SQL}")
def filter_status_consistency(t: Tables) -> DataFrame:
    return t.orders.filter(consistent(F.col("o_orderstatus"), F.col("o_orderdate") + F.expr("interval 90 days"))).select("o_orderkey")


@query(f"select o_orderkey from orders where {CARDS} and (o_totalprice is null or o_totalprice between 1000 and 300000) and {STATUS_SQL}")
def filter_card_compound(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    o = t.orders.filter((F.col("o_orderstatus") == "O") & holds(F.col("o_orderpriority"), "medium") & (price.isNull() | price.between(1000, 300000)))
    return o.filter(consistent(F.col("o_orderstatus"), F.col("o_orderdate") + F.expr("interval 90 days"))).select("o_orderkey")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice between 20000 and 200000 order by o_totalprice desc, o_orderkey limit 30")
def filter_demo_compound(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_orderstatus") == "O") & F.col("o_totalprice").between(20000, 200000)).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)


@query("select c_custkey, r.role, r.role = 'admin' or (r.role = 'editor' and c_mktsegment <> 'MACHINERY') may_view, r.role = 'admin' may_export from customer, (values ('admin'), ('editor'), ('guest')) r(role)")
def visibility_filter(t: Tables) -> DataFrame:
    """What each role may view and export; the few roles are a literal list beside every row."""
    role = F.explode(F.array(*map(F.lit, ("admin", "editor", "guest")))).alias("role")
    c = t.customer.select("c_custkey", "c_mktsegment", role)
    return c.select("c_custkey", "role", ((F.col("role") == "admin") | ((F.col("role") == "editor") & (F.col("c_mktsegment") != "MACHINERY"))).alias("may_view"), (F.col("role") == "admin").alias("may_export"))


@query("select l_suppkey, count(*) n, count(*) filter (l_returnflag = 'A') accepted, count(*) filter (l_returnflag = 'R') returned, min(l_extendedprice) best from lineitem group by 1")
def project_supplier_comparison(t: Tables) -> DataFrame:
    f = F.col("l_returnflag")
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(f == "A").alias("accepted"), F.count_if(f == "R").alias("returned"), F.min("l_extendedprice").alias("best"))


@query("select l_orderkey, l_linenumber, c_custkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and o_orderstatus = 'F'")
def join_inner_3way_ids(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderstatus = 'F'").join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "c_custkey")
    return t.lineitem.select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query("select 'order' kind, o_orderkey::varchar ref from orders join customer on o_custkey = c_custkey where c_custkey % 50 = 0 union all select 'line', l_orderkey || '/' || l_linenumber from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 50 = 0 union all select 'part', p_partkey::varchar from part join lineitem on p_partkey = l_partkey join orders on l_orderkey = o_orderkey where o_custkey % 50 = 0")
def join_chain_archive(t: Tables) -> DataFrame:
    """References to export, from several chains of joins, one list."""
    o = t.orders.filter("o_custkey % 50 = 0").select("o_orderkey", "o_custkey")
    li = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    of = lambda df, kind, ref: df.select(F.lit(kind).alias("kind"), ref.alias("ref"))
    orders = of(o.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "order", F.col("o_orderkey").cast("string"))
    return orders.union(of(li, "line", F.concat_ws("/", "l_orderkey", "l_linenumber"))).union(of(li.join(t.part, F.col("l_partkey") == F.col("p_partkey")), "part", F.col("p_partkey").cast("string")))


@query("select l_orderkey, l_linenumber, s_name, s_suppkey is null missing from lineitem left join supplier on l_suppkey = s_suppkey and s_acctbal > 0")
def join_map_lookup(t: Tables) -> DataFrame:
    """Offers with their supplier's record; those without one are marked."""
    s = t.supplier.filter("s_acctbal > 0").select("s_suppkey", "s_name")
    j = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "s_name", F.col("s_suppkey").isNull().alias("missing"))


def counted(name: str, sql: str, build) -> None:
    build.__name__ = name
    query(sql)(build)


counted("agg_count_all", "select count(*) n from orders", lambda t: t.orders.agg(F.count("*").alias("n")))
counted("agg_count_filtered", "select count(*) n from orders where o_orderstatus = 'F'", lambda t: t.orders.filter("o_orderstatus = 'F'").agg(F.count("*").alias("n")))
counted("agg_count_notnull", "select count(source) n from documents", lambda t: t.documents.agg(F.count("source").alias("n")))
counted("agg_count_distinct", "select count(distinct l_suppkey) n from lineitem", lambda t: t.lineitem.agg(F.countDistinct("l_suppkey").alias("n")))
counted("agg_count_distinct_tag", "select count(distinct s_suppkey) n, count(distinct case when l_returnflag = 'R' then l_suppkey end) tagged from supplier left join lineitem on l_suppkey = s_suppkey", lambda t: t.supplier.join(t.lineitem, F.col("l_suppkey") == F.col("s_suppkey"), "left").agg(F.countDistinct("s_suppkey").alias("n"), F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("tagged")))
counted("agg_max_plus_one", "select user_id, coalesce(max(value::bigint), 0) + 1 next_no from events group by 1", lambda t: t.events.groupBy("user_id").agg((F.coalesce(F.max(F.rint("value").cast("long")), F.lit(0)) + 1).alias("next_no")))
counted("agg_sla_counts", "select user_id, count(*) filter (event_type = 'error') active, case when count(*) filter (event_type = 'error') = 0 then 'operator_review' else 'escalated' end state from events group by 1", lambda t: t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("active")).select("user_id", "active", F.when(F.col("active") == 0, "operator_review").otherwise("escalated").alias("state")))
counted("agg_page_metrics", "select count(*) n, count(nullif(source, '')) named, count(*) - count(nullif(source, '')) unnamed, count(distinct nullif(source, '')) sources, count(distinct case when source <> 'web' then nullif(source, '') end) others from documents", lambda t: (lambda s: t.documents.agg(F.count("*").alias("n"), F.count(s).alias("named"), (F.count("*") - F.count(s)).alias("unnamed"), F.countDistinct(s).alias("sources"), F.countDistinct(F.when(F.col("source") != "web", s)).alias("others")))(F.nullif(F.col("source"), F.lit(""))))
counted("agg_fs_by_key", "select lang, source, count(*) files, sum(octet_length(encode(text)))::bigint bytes from documents group by 1, 2", lambda t: t.documents.groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes")))
counted("agg_postmortem", "select user_id, case when count(*) filter (event_type = 'error') >= 3 then 'claim_triggered' when count(*) filter (event_type = 'error') > 0 or count(*) filter (value < 0) > 0 then 'incident' else 'clear' end status from events group by 1", lambda t: t.events.groupBy("user_id").agg(F.when(F.count_if(F.col("event_type") == "error") >= 3, "claim_triggered").when((F.count_if(F.col("event_type") == "error") > 0) | (F.count_if(F.col("value") < 0) > 0), "incident").otherwise("clear").alias("status")))
counted("agg_document_completeness", "select source, count(distinct lang) kinds, count(*) files, count(distinct lang) >= 4 complete from documents group by 1", lambda t: t.documents.groupBy("source").agg(F.countDistinct("lang").alias("kinds"), F.count("*").alias("files")).withColumn("complete", F.col("kinds") >= 4))
counted("agg_nearest_rank", "select l_returnflag, p, max(l_extendedprice) filter (r = greatest(1, least(n, ceil(p / 100.0::double * n)))) price from (select l_returnflag, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice, l_orderkey, l_linenumber) r, count(*) over (partition by l_returnflag) n from lineitem), (values (50), (75), (90), (100)) q(p) group by 1, 2", lambda t: rows.nearest_ranks(t.lineitem, ["l_returnflag"], "l_extendedprice", (50, 75, 90, 100)).withColumnRenamed("value", "price"))
counted("agg_quality_gate", "select source, round(good / nullif(n, 0), 4) good_share, case when n = 0 then 'NOT_READY' when good / n >= 0.6 then 'PASS' when good / n >= 0.4 then 'CONDITIONAL' else 'FAIL' end verdict from (select source, count(quality)::double n, count(*) filter (quality = 1)::double good from documents left join labels using (doc_id) group by 1)", lambda t: (lambda g: g.select("source", F.round(F.try_divide("good", "n"), 4).alias("good_share"), F.when(F.col("n") == 0, "NOT_READY").when(F.col("good") / F.col("n") >= 0.6, "PASS").when(F.col("good") / F.col("n") >= 0.4, "CONDITIONAL").otherwise("FAIL").alias("verdict")))(t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count("quality").cast("double").alias("n"), F.count_if(F.col("quality") == 1).cast("double").alias("good"))))


def latest(name: str, table: str, key: str, at: str, id_: str, where: str = "true"):
    """The last row of each key by time and id, among those of one kind."""

    def f(t: Tables) -> DataFrame:
        return rows.latest_per_key(getattr(t, table).filter(where).select(key, at, id_), [key], [at, id_]).select(key, id_)

    f.__name__ = name
    query(f"select {key}, {id_} from (select *, row_number() over (partition by {key} order by {at} desc, {id_} desc) r from {table} where {where}) where r = 1")(f)


latest("latest_record_for_set", "lineitem", "l_orderkey", "l_shipdate", "l_linenumber")
latest("latest_screening", "orders", "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus = 'F'")
latest("latest_context_family", "events", "user_id", "ts", "event_id", "event_type = 'click'")
latest("latest_analysis_run", "events", "event_type", "ts", "event_id")
latest("latest_normalization", "orders", "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority <> '5-LOW'")


@query("select l_partkey, max(price) - max(price) filter (r = 2) < 50 as risky from (select l_partkey, l_extendedprice price, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber) r from lineitem) where r <= 2 group by 1")
def rank_spread_next(t: Tables) -> DataFrame:
    """Whether the two best offers of a part lie close together."""
    top = F.array_sort(F.collect_list("price"))
    two = rows.top_per_key(t.lineitem.select("l_partkey", F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber"), ["l_partkey"], [F.desc("price"), F.col("l_orderkey"), F.col("l_linenumber")], 2)
    return two.groupBy("l_partkey").agg(top.alias("p")).select("l_partkey", F.when(F.size("p") == 2, F.element_at("p", 2) - F.element_at("p", 1) < 50).alias("risky"))


@query("select l_orderkey, l_linenumber, format('CMR-{:04d}', 2 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey)) code from lineitem")
def seq_number_rows(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) + 2
    return t.lineitem.select("l_orderkey", "l_linenumber", F.format_string("CMR-%04d", n).alias("code"))


@query("select conv_id, turn, ((upto - 1) // 400)::bigint batch from (select conv_id, turn, sum(greatest(1, length(text) // 4)) over (partition by conv_id order by turn) upto from conversations)")
def prefix_sum_pack(t: Tables, limit: int = 400) -> DataFrame:
    """The batch of each turn by the running sum of token estimates in its conversation."""
    upto = F.sum(F.greatest(F.lit(1), F.expr("length(text) div 4"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", upto.alias("upto")).select("conv_id", "turn", F.expr(f"(upto - 1) div {limit}").alias("batch"))


@query("select conv_id, turn from (select *, sum(length(text) + 20) over (partition by conv_id order by turn) upto from conversations) where upto <= 1500")
def token_budget_select(t: Tables, budget: int = 1500, header: int = 20) -> DataFrame:
    """Turns in order while the rendered block with its headers fits; the first that does not ends it."""
    upto = F.sum(F.length("text") + header).over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("upto", upto).filter(F.col("upto") <= budget).select("conv_id", "turn")


def page(name: str, sql: str, build) -> None:
    counted(name, sql, build)


page("sort_nulls_last_date", "select o_orderkey, d from (select o_orderkey, case when o_orderkey % 5 <> 0 then o_orderdate end d from orders) order by d desc nulls last, o_orderkey limit 60", lambda t: t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("d")).orderBy(F.col("d").desc_nulls_last(), "o_orderkey").limit(60))
page("sort_severity_rank", "select event_id, event_type from events order by case event_type when 'error' then 4 when 'purchase' then 3 when 'signup' then 2 when 'click' then 1 else 0 end desc, event_type, event_id limit 40", lambda t: t.events.select("event_id", "event_type").orderBy(F.desc(F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 1).otherwise(0)), "event_type", "event_id").limit(40))
page("sort_coalesce_key", "select doc_id from documents order by coalesce(sha256(text), ''), doc_id limit 40", lambda t: t.documents.orderBy(F.coalesce(F.sha2("text", 256), F.lit("")), "doc_id").select("doc_id").limit(40))
page("sort_numeric_text", "select p_partkey, coalesce(try_cast(split_part(p_brand, '#', 2) as integer), 999) no from part order by no, lower(p_name), p_partkey limit 40", lambda t: t.part.select("p_partkey", F.coalesce(F.element_at(F.split("p_brand", "#"), 2).try_cast("int"), F.lit(999)).alias("no"), "p_name").orderBy("no", F.lower("p_name"), "p_partkey").limit(40).select("p_partkey", "no"))
page("limit_offset_jobs", "select event_id, (select count(*) from events where event_type = 'click' and user_id < 50) total from events where event_type = 'click' and user_id < 50 order by ts desc, event_id desc limit 20 offset 5", lambda t: (lambda e: e.join(F.broadcast(e.groupBy("event_type").agg(F.count("*").alias("total"))), "event_type").orderBy(F.desc("ts"), F.desc("event_id")).offset(5).limit(20).select("event_id", "total"))(t.events.filter("event_type = 'click' and user_id < 50")))
page("limit_offset_history", "select event_id from events where user_id < 20 order by ts desc, event_id desc limit 15 offset 10", lambda t: t.events.filter("user_id < 20").orderBy(F.desc("ts"), F.desc("event_id")).offset(10).limit(15).select("event_id"))
page("queue_position", "select o_orderkey, case when o_totalprice >= 300000 then 'P1' when o_totalprice >= 150000 then 'P2' else 'P3' end queue from orders", lambda t: t.orders.select("o_orderkey", F.when(F.col("o_totalprice") >= 300000, "P1").when(F.col("o_totalprice") >= 150000, "P2").otherwise("P3").alias("queue")))
page("union_deal_items", "select 'order' kind, o_orderkey id from orders where o_orderpriority = '1-URGENT' union all select 'line', l_orderkey from lineitem where l_returnflag = 'R' and l_quantity > 49 union all select 'event', event_id from events where event_type = 'error'", lambda t: t.orders.filter("o_orderpriority = '1-URGENT'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).union(t.lineitem.filter("l_returnflag = 'R' and l_quantity > 49").select(F.lit("line"), "l_orderkey")).union(t.events.filter("event_type = 'error'").select(F.lit("event"), "event_id")))
page("union_signals", "select distinct s from (select upper(p_brand) s from part union all select upper(p_type) from part union all select upper(r_name) from region)", lambda t: t.part.select(F.explode(F.array(F.upper("p_brand"), F.upper("p_type"))).alias("s")).union(t.region.select(F.upper("r_name"))).distinct())
page("intersect_tokens", "select p_partkey, len(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{3,}')), list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]{3,}')))) n from part", lambda t: t.part.select("p_partkey", F.size(F.array_intersect(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z0-9]{3,}"), 0), F.regexp_extract_all(F.lower("p_type"), F.lit("[a-z0-9]{3,}"), 0))).cast("long").alias("n")))
page("subset_issue_sets", "select user_id, array_to_string(list_sort(list_filter(list_distinct(list(event_type)), lambda x: x in ('error', 'view', 'refund'))), ',') found, array_to_string(list_sort(list_filter(['error', 'view', 'refund'], lambda x: not list_contains(list(event_type), x))), ',') missing from events group by 1", lambda t: t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("e")).select("user_id", F.array_join(F.array_sort(F.array_intersect("e", F.array(*map(F.lit, ("error", "view", "refund"))))), ",").alias("found"), F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, ("error", "view", "refund"))), "e")), ",").alias("missing")))
page("split_leakage", "select p_brand, count(distinct p_partkey % 3) splits, count(distinct p_partkey % 3) > 1 leaks from part group by 1", lambda t: t.part.groupBy("p_brand").agg(F.countDistinct(F.col("p_partkey") % 3).alias("splits")).withColumn("leaks", F.col("splits") > 1))
page("dedup_identity_hash", "select identity, min(page_id) page_id, count(*) n from (select page_id, sha256(coalesce(nullif(regexp_replace(lower(url), '[?#].*$', ''), ''), length(html)::varchar || '|' || coalesce(url, ''))) identity from pages) group by 1", lambda t: t.pages.groupBy(F.sha2(F.coalesce(F.nullif(F.regexp_replace(F.lower("url"), "[?#].*$", ""), F.lit("")), F.concat_ws("|", F.length("html").cast("string"), F.coalesce("url", F.lit("")))), 256).alias("identity")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")))
page("dedup_attachments", "select min(page_id) page_id, url from pages where url not in (select url from pages where page_id % 10 = 0 and url is not null) group by url", lambda t: t.pages.join(t.pages.filter("page_id % 10 = 0").select("url").distinct(), "url", "left_anti").filter("url is not null").groupBy("url").agg(F.min("page_id").alias("page_id")))
page("dedup_text_items", r"select min(doc_id) doc_id, arg_min(sha256(text), doc_id) text_hash, count(*) n from (select doc_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' .')) k from documents where text is not null) group by k", lambda t: t.documents.filter("text is not null").groupBy(F.sha2(F.lower(F.regexp_replace(F.regexp_replace("text", r"\s+", " "), r"^[ .]+|[ .]+$", "")), 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.min_by(F.sha2("text", 256), "doc_id").alias("text_hash"), F.count("*").alias("n")).drop("k"))
page("upsert_search_result", "select user_id, event_type, arg_min(event_id, ts) event_id from (select user_id, event_type, event_id, {'t': ts, 'e': event_id} ts from events) group by 1, 2", lambda t: rows.first_per_key(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id"))
page("upsert_artifact", "select sha256(text) sha, min(doc_id) doc_id from documents where text is not null group by 1", lambda t: t.documents.filter("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id")))
page("upsert_embedding", "select vec_id, arg_max(label, v) as label, max(v) version from (select vec_id, label, 1 v from embeddings union all select vec_id, label + 1, 2 from embeddings where vec_id % 4 = 0) group by vec_id", lambda t: t.embeddings.select("vec_id", "label", F.lit(1).alias("v")).union(t.embeddings.filter("vec_id % 4 = 0").select("vec_id", F.col("label") + 1, F.lit(2))).groupBy("vec_id").agg(F.max_by("label", "v").alias("label"), F.max("v").alias("version")))
page("merge_notes", "select user_id, string_agg(note, chr(10) order by first) notes from (select user_id, trim(props) note, min((ts, event_id)) first from events where trim(props) <> '' group by 1, 2) group by 1", lambda t: t.events.filter("trim(props) <> ''").groupBy("user_id", F.trim("props").alias("note")).agg(F.min(F.struct("ts", "event_id")).alias("first")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "note"))), lambda x: x["note"]), "\n").alias("notes")))
page("vec_norm", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) norm from embeddings", lambda t: t.embeddings.select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 6).alias("norm")))
page("vec_dim_check", "select len(embedding) dim, count(*) n from embeddings group by 1", lambda t: t.embeddings.groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n")))
page("html_title", "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages", lambda t: t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")))


@query()
def text_chunk(t: Tables) -> DataFrame:
    """Overlapping chunks of documents, cut at sentences and words; chunks of one document with equal text count once."""
    return chunks.chunked(t.documents, "doc_id", "text").select("doc_id", "chunk_index", "char_start", "char_end", "token_estimate", "text_hash")


@query()
def chunk_stats(t: Tables) -> DataFrame:
    c = chunks.chunked(t.documents, "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_estimate").alias("tokens"), F.max("char_end").alias("covered"))


@query()
def chunk_incremental(t: Tables) -> DataFrame:
    """Chunks that are new or changed against what was indexed: the same place or the same text of a document is skipped."""
    now = kept(chunks.chunked(t.documents, "doc_id", "text"), "chunks")
    return chunks.new_chunks(now, now.filter("doc_id % 3 = 0")).select("doc_id", "chunk_index", "text_hash")


@query()
def upsert_chunk(t: Tables) -> DataFrame:
    """Stored chunks after a run over changed texts: by place first, then by hash of the text."""
    old = kept(chunks.chunked(t.documents, "doc_id", "text"), "chunks")
    new = kept(chunks.chunked(t.documents.filter("doc_id % 4 = 0").withColumn("text", F.concat(F.lit("Revised. "), "text")), "doc_id", "text"), "chunks")
    return chunks.upserted(old, new).select("doc_id", "chunk_index", "text_hash")
