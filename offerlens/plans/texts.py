"""Text, urls, pages, retrieval and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, strings, vectors
from ..operators import hashing, retrieval
from .offers import TRANSLIT
from .registry import Tables, query

COLLAPSED = "trim(regexp_replace(regexp_replace({}, '\u00a0', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'))"


@query(f"select doc_id, {COLLAPSED.format('text')} clean, sha256(text) content_hash from documents")
def str_normalize_ws(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", strings.collapse(F.col("text")).alias("clean"), strings.sha256(F.col("text")).alias("content_hash"))


@query("select p_partkey, " + COLLAPSED.format("regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_\\s\\-/]', ' ', 'g')") + " title, trim(upper(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')), '_') signal, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') slug from part")
def str_normalize_title(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select("p_partkey", strings.normal_title(n).alias("title"), strings.signal(F.col("p_type")).alias("signal"), strings.slug(n).alias("slug"))


@query(f"select doc_id, len(list_distinct(regexp_extract_all({TRANSLIT}, '[a-z0-9]{{3,}}'))) n_tokens, case when length(v) = 0 then 0 else greatest(1, length(v) // 4) end estimate, trim(replace(substr(v, 1, 280), chr(10), ' ')) preview from (select doc_id, text v from documents)")
def str_tokenize_set(t: Tables) -> DataFrame:
    """Different words of three letters or digits after transliteration, rough tokens, and a preview."""
    x = F.col("text")
    return t.documents.select("doc_id", F.size(parsing.tokens(x)).cast("long").alias("n_tokens"), strings.token_estimate(x).alias("estimate"), strings.preview(x).alias("preview"))


@query("select o_orderkey, round(o_totalprice::decimal(18,4), 2)::double amount from orders")
def num_parse_decimal(t: Tables) -> DataFrame:
    """Amounts as price lists print them: spaces between thousands, a decimal comma, a currency behind."""
    printed = F.concat(F.translate(F.format_number(F.col("o_totalprice").cast("decimal(18,4)"), 2), ",.", " ,"), F.lit(" ₽"))
    return t.orders.select("o_orderkey", strings.decimal_of(printed).cast("double").alias("amount"))


@query(r"select doc_id, nullif(lower(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')), '') email, len(regexp_extract_all(text, 'https?://[^ \t\r\n\f]+')) n_urls from documents")
def extract_contacts(t: Tables) -> DataFrame:
    email = F.lower(F.regexp_extract("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0))
    return t.documents.select("doc_id", F.nullif(email, F.lit("")).alias("email"), F.size(F.regexp_extract_all("text", F.lit("https?://[^ \\t\\r\\n\\f]+"), 0)).cast("long").alias("n_urls"))


@query("""select o_orderkey, strftime(strptime(s, '%d.%m.%Y %H:%M'), '%Y-%m-%d %H:%M') parsed from (select o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') s from orders)""")
def date_parse_multi(t: Tables) -> DataFrame:
    printed = F.date_format("o_orderdate", "dd.MM.yyyy HH:mm")
    parsed = F.coalesce(F.try_to_timestamp(printed, F.lit("dd.MM.yyyy HH:mm")), F.try_to_timestamp(printed, F.lit("dd.MM.yyyy")))
    return t.orders.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm").alias("parsed"))


@query("select l_orderkey, l_linenumber, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::double, 4) as days from lineitem join orders on o_orderkey = l_orderkey")
def date_diff_days(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.round((us("l_shipdate") - us("o_orderdate")) / 86400e6, 4).alias("days"))


URL_SQL = r"""with u as (select page_id, regexp_extract(url, '^([^?#]*)', 1) base, regexp_extract(url, '\?([^#]*)', 1) q, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') host from pages),
 k as (select page_id, host, lower(regexp_extract(base, '^([A-Za-z]+)://', 1)) || '://' || host || coalesce(nullif(regexp_replace(regexp_extract(base, '^[A-Za-z]+://[^/]*(.*)$', 1), '/+$', ''), ''), '/') head,
  array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' and lower(regexp_extract(p, '^([^=]*)', 1)) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'yclid', 'mc_cid', 'mc_eid', 'ref', 'source', 'from')), '&') q from u)
 select page_id, host, head || case when q = '' then '' else '?' || q end url, sha256(head || case when q = '' then '' else '?' || q end) url_hash from k"""


@query(URL_SQL)
def url_normalize(t: Tables) -> DataFrame:
    u = strings.normal_url(F.col("url"))
    return t.pages.select("page_id", strings.host_of(F.col("url")).alias("host"), u.alias("url"), strings.sha256(u).alias("url_hash"))


@query("with n as (" + URL_SQL + ") select url_hash, min(page_id) page_id, count(*) n from n group by 1")
def upsert_web_page(t: Tables) -> DataFrame:
    h = strings.sha256(strings.normal_url(F.col("url")))
    return t.pages.groupBy(h.alias("url_hash")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("select page_id, " + COLLAPSED.format("regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g')") + " text, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages")
def html_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", strings.stripped_html(F.col("html")).alias("text"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""select page_id, href from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) href from pages)""")
def scan_html_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))


@query("select event_id, (props->>'k')::bigint k, event_type from events where props->>'k' is not null")
def json_pick_first(t: Tables) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.key"))
    return t.events.filter(k.isNotNull()).select("event_id", k.cast("long").alias("k"), "event_type")


@query("""with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+')) w from documents),
 f as (select doc_id, ('0x' || substr(sha256(w), 1, 8))::bigint % 256 bucket, ((case when ('0x' || substr(sha256(w), 9, 2))::bigint % 2 = 0 then 1 else -1 end) * (1 + least(length(w), 24) / 24.0::double))::decimal(18,6) weight from tok
  union all select doc_id, ('0x' || substr(sha256(substr(w, 1, 6)), 1, 8))::bigint % 256, ((case when ('0x' || substr(sha256(substr(w, 1, 6)), 9, 2))::bigint % 2 = 0 then 1 else -1 end) * 0.5::double)::decimal(18,6) from tok where length(w) >= 6),
 g as (select doc_id, bucket, sum(weight) weight from f group by 1, 2), n as (select doc_id, sqrt(sum(weight::double * weight::double)) norm from g group by 1)
 select doc_id, bucket, round(weight::double / norm, 6) + 0.0::double weight from g join n using (doc_id) where weight <> 0""")
def embed_hashing(t: Tables) -> DataFrame:
    """Signed feature hashing of words in any script and of their first six letters, at a length of one; sparse: buckets that are not 0."""
    return hashing.hashed_vectors(t.documents, "doc_id", "text")


@query("""with q as (select vec_id qid, embedding::double[] q from embeddings where vec_id % 100 = 0), s as (select qid, vec_id, list_cosine_similarity(q, embedding::double[]) c from q cross join embeddings where vec_id <> qid)
 select qid, vec_id, round(c, 6) score, rank_order from (select *, row_number() over (partition by qid order by round(c, 6) desc, vec_id) rank_order from s) where rank_order <= 10""")
def vec_topk(t: Tables, k: int = 10) -> DataFrame:
    """The stated query set (ids divisible by 100) against all vectors, in blocks of queries."""
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return retrieval.top_cosine(asked, t.embeddings, k)


@query("select doc_id, round(5 * contains(lower(text), 'the of')::int + (2 + 3 / 16.0::double) * contains(lower(text), 'the')::int + (2 + 4 / 16.0::double) * contains(lower(text), 'that')::int, 4) score from documents where contains(lower(text), 'the') or contains(lower(text), 'that') order by score desc, doc_id limit 20")
def lexical_fallback(t: Tables, phrase: str = "the of", keywords: tuple[str, ...] = ("the", "that"), n: int = 20) -> DataFrame:
    x = F.lower("text")
    score = 5 * x.contains(phrase).cast("int")
    for w in keywords:
        score = score + (2 + min(len(w), 16) / 16) * x.contains(w).cast("int")
    return t.documents.select("doc_id", F.round(score, 4).alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(n)


@query(r"select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) n_hidden, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g')) redacted_hash from documents")
def redact_text(t: Tables) -> DataFrame:
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(mail)).cast("long").alias("n_hidden"), strings.sha256(F.regexp_replace("text", mail, "[email]")).alias("redacted_hash"))


@query("""select conv_id, count(*) n, count(*) filter (turn <> expected) gaps, count(*) filter (length(trim(text)) = 0) blanks, sum(length(text) // 4)::bigint tokens from
  (select *, row_number() over (partition by conv_id order by turn) - 1 + min(turn) over (partition by conv_id) expected from conversations) group by 1""")
def chunk_snapshot(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    c = t.conversations.withColumn("expected", F.row_number().over(w.orderBy("turn")) - 1 + F.min("turn").over(w))
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("turn") != F.col("expected")).alias("gaps"), F.count_if(F.length(F.trim("text")) == 0).alias("blanks"), F.sum(F.expr("length(text) div 4")).alias("tokens"))
