"""Goods and stored tables: marks in texts, profiles of attributes, upserts of tenders in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attributes, snapshots
from ..tables import new_path
from .registry import Tables, query


@query("""with i as (select item_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '') w from benchmark), a as (select distinct item_id, regexp_replace(lower(w[k] || w[k + 1] || w[k + 2]), '[^\\p{L}\\p{N}]+', '', 'g') alias from i, range(1, len(w) - 1) t(k)),
 d as (select doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') c from documents), h as (select doc_id, item_id, length(alias) n from d join a on alias <> '' and contains(c, alias)), m as (select doc_id, max(n) n from h group by 1),
 o as (select h.doc_id, h.n, count(distinct item_id) owners, min(item_id) item_id from h join m on h.doc_id = m.doc_id and h.n = m.n group by 1, 2)
 select doc_id, case when owners is null then 'none' when owners = 1 then 'resolved' else 'ambiguous' end status, case when owners = 1 then item_id::varchar end mark, coalesce(n, 0) alias_length from documents left join o using (doc_id)""")
def resolve_mark(t: Tables) -> DataFrame:
    """The item of which a document holds the longest run of three words, every such run of the items being an alias."""
    words = F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda k: F.concat(F.get("w", k), F.get("w", k + 1), F.get("w", k + 2)))
    aliases = t.benchmark.select("item_id", words.alias("w")).filter("size(w) >= 3").select(F.col("item_id").alias("mark"), F.explode(runs).alias("alias"))
    return attributes.resolved_marks(t.documents, "doc_id", "text", aliases)


RULES = [("brand", "exact", True, True), ("size", "minimum", True, True), ("type", "exact", False, True), ("price", "maximum", False, False), ("words", "contains", False, True), ("range", "range_overlap", False, False)]


def requests(t: Tables) -> DataFrame:
    """Parts as requests, and the part with the next number as what is offered; some values are not asked for, some not given."""
    p = t.part
    words = lambda c: F.split(c, " ")
    k = F.col("p_partkey")
    want = p.select(k.alias("request"), (k + 1).alias("offer"), F.when(k % 3 == 0, F.upper("p_brand")).alias("requested_brand"), F.when(k % 2 == 0, F.col("p_size") - 15).alias("requested_size"), F.col("p_type").alias("requested_type"), (F.col("p_retailprice") + F.col("p_size") - 25).alias("requested_price"), F.when(k % 5 == 0, words("p_name")).alias("requested_words"), F.when(k % 4 == 0, F.array("p_retailprice", F.col("p_retailprice") + 10)).alias("requested_range"))
    have = p.select(k.alias("offer"), F.when(k % 11 != 0, F.concat(F.lit(" "), "p_brand")).alias("offered_brand"), F.when(k % 7 != 0, F.col("p_size")).alias("offered_size"), F.col("p_type").alias("offered_type"), F.col("p_retailprice").alias("offered_price"), words("p_name").alias("offered_words"), F.array(F.col("p_retailprice") + F.col("p_size") - 30, F.col("p_retailprice") + F.col("p_size") - 25).alias("offered_range"))
    return want.join(have, "offer")


EVALUATED = """w as (select a.p_partkey k, a.p_partkey % 3 = 0 and b.p_partkey % 11 = 0 brand0, a.p_partkey % 3 = 0 and b.p_partkey % 11 <> 0 and lower(a.p_brand) <> lower(b.p_brand) brand1, a.p_partkey % 2 = 0 and b.p_partkey % 7 = 0 size0, a.p_partkey % 2 = 0 and b.p_partkey % 7 <> 0 and b.p_size < a.p_size - 15 size1,
  lower(a.p_type) <> lower(b.p_type) type1, b.p_retailprice > a.p_retailprice + a.p_size - 25 price1, a.p_partkey % 5 = 0 and not list_has_all(string_split(lower(b.p_name), ' '), string_split(lower(a.p_name), ' ')) words1,
  a.p_partkey % 4 = 0 and greatest(a.p_retailprice, b.p_retailprice + b.p_size - 30) > least(a.p_retailprice + 10, b.p_retailprice + b.p_size - 25) range1, a.p_partkey % 6 <> 1 sure from part a join part b on b.p_partkey = a.p_partkey + 1)"""


@query(f"""with {EVALUATED} select k request, case when brand1 or size1 then 'NO_MATCH' when brand0 or size0 or not sure then 'UNCERTAIN' when type1 or words1 then 'PARTIAL' when price1 or range1 then 'LIKELY_ANALOG' else 'EXACT' end status,
 concat_ws(',', case when brand0 then 'brand' end, case when size0 then 'size' end) missing, concat_ws(',', case when brand1 then 'brand' end, case when size1 then 'size' end, case when type1 then 'type' end, case when price1 then 'price' end, case when words1 then 'words' end, case when range1 then 'range' end) mismatch from w""")
def profile_evaluate(t: Tables) -> DataFrame:
    """How well each offered part does for the requested one, by a profile of six attributes."""
    found = attributes.evaluated(requests(t), RULES, F.col("request") % 6 != 1)
    return found.select("request", "status", F.array_join("missing", ",").alias("missing"), F.array_join("mismatch", ",").alias("mismatch"))


@query(f"""with {EVALUATED} select k request, case when k % 3 = 0 and not brand0 then not brand1 end brand, case when k % 2 = 0 and not size0 then not size1 end size, not type1 as type, not price1 price, case when k % 5 = 0 then not words1 end words, case when k % 4 = 0 then not range1 end "range" from w""")
def attr_compare(t: Tables) -> DataFrame:
    """Each comparison of the profile by itself; null where a value is not asked for or not given."""
    r = requests(t)
    return r.select("request", *(F.when(F.col(f"requested_{n}").isNotNull() & F.col(f"offered_{n}").isNotNull(), attributes.compare(c, F.col(f"requested_{n}"), F.col(f"offered_{n}"))).alias(n) for n, c, _, _ in RULES))


TENDERS = """b as (select o_orderstatus source, o_custkey external_id, case when o_orderkey % 7 <> 0 then o_orderpriority end title, o_totalprice nmck, o_orderkey as k, o_orderkey % 3 + 1 v, o_orderkey % 5 = 0 part from orders)"""


def tender_table(t: Tables) -> snapshots.UpsertTable:
    """Orders as sightings of tenders, in three batches, the second of which is sent twice; a snapshot is made after it. Some sightings leave the amount out."""
    o = t.orders
    k = F.col("o_orderkey")
    rows = o.select(F.col("o_orderstatus").alias("source"), F.col("o_custkey").alias("external_id"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("title"), F.col("o_totalprice").alias("nmck"), k.alias("k"), F.when(k % 5 == 0, F.array(F.lit("title"), F.lit("k"))).alias("present"))
    table = snapshots.UpsertTable(t.spark, new_path(t.spark, "tenders"), ["source", "external_id"], "k", buckets=8)
    for n in (0, 1, 1, 2):
        table.commit(f"batch-{n}", rows.filter(k % 3 == n))
        if n == 1 and len(table.version().parts) == 2:
            table.compacted()
    return table


@query(f"""with {TENDERS}, g as (select source, external_id, max({{'v': v, 'k': k, 'x': title}}) t, max({{'v': v, 'k': k, 'x': nmck}}) filter (not part) n, min(v) f, max(v) l from b group by 1, 2)
 select source, external_id, t.x title, n.x nmck, case when f = 3 then 4 else f end::bigint first_batch, l = 3 seen_last from g""")
def upsert_tender(t: Tables) -> DataFrame:
    """Tenders after all batches: the last title and amount given, when first seen (versions: two batches, the snapshot, one batch), and whether the last batch had them."""
    rows = tender_table(t).rows()
    return rows.select("source", "external_id", "title", "nmck", F.col("first_seen").alias("first_batch"), (F.col("last_seen") == 4).alias("seen_last"))


@query("select unnest(['batch-0', 'batch-1', 'batch-2']) batch, unnest([1, 2, 3])::bigint place, (select count(*) from (select distinct o_orderstatus, o_custkey from orders))::bigint tenders")
def sink_orm_upsert(t: Tables) -> DataFrame:
    """The log of the table after a batch was sent twice: each batch once, and the number of rows that it holds."""
    table = tender_table(t)
    n = table.rows().agg(F.count("*").alias("tenders"))
    log = t.spark.createDataFrame([(b, i) for i, b in enumerate(table.version().batches, 1)], "batch string, place long")
    return log.join(n).select("batch", "place", "tenders")
