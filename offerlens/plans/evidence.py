"""Evidence for analysis: order and batches of fragments, sizes of requests, deadlines of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds, grounding, packing, worktime
from .registry import Tables, query

LIMIT, MOST, OVERHEAD = 6000, 24, 350
ENVELOPE = "task: answer from the evidence only"


def fragments(t: Tables) -> DataFrame:
    """Documents as fragments of a case (their language): order of the document and number of the chunk, if they have any, and rough tokens."""
    document = F.when(F.col("doc_id") % 7 != 0, F.floor(F.col("doc_id") / 5).cast("string")).otherwise("none")
    chunk = F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 5).cast("string"))
    order = packing.fragment_place(document, chunk, F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    rough = F.greatest(F.lit(1), F.floor(F.octet_length("text") / 3))
    return t.documents.filter("text is not null").select("lang", *(c.alias(n) for c, n in zip(order, ("document", "chunk", "fragment"), strict=True)), rough.alias("tokens"), "doc_id", "text")


FRAGMENTS = f"""f as (select lang, case when doc_id % 7 <> 0 then doc_id // 5 else {packing.NO_DOCUMENT} end document, case when doc_id % 11 <> 0 then doc_id % 5 else {packing.NO_CHUNK} end chunk, lpad(doc_id::varchar, 12, '0') fragment,
  greatest(1, octet_length(encode(text)) // 3) tokens, doc_id, text from documents where text is not null),
 o as (select *, row_number() over (partition by lang order by document, chunk, fragment) n from f)"""
PACKED = f"""{FRAGMENTS}, w as (select lang, n, doc_id, tokens, 1 batch, 0::bigint used, 1 held from o where n = 1
  union all select o.lang, o.n, o.doc_id, o.tokens, case when w.used + w.tokens + o.tokens > {LIMIT} or w.held >= {MOST} then w.batch + 1 else w.batch end,
   case when w.used + w.tokens + o.tokens > {LIMIT} or w.held >= {MOST} then 0 else w.used + w.tokens end, case when w.used + w.tokens + o.tokens > {LIMIT} or w.held >= {MOST} then 1 else w.held + 1 end
  from w join o on o.lang is not distinct from w.lang and o.n = w.n + 1)"""


@query(f"with {FRAGMENTS} select lang, doc_id, document, chunk, n place from o")
def fragment_order(t: Tables) -> DataFrame:
    """The place of each fragment among those of its case. Documents and chunks without a number go last."""
    rows = fragments(t).select("lang", "doc_id", "document", "chunk", "fragment", F.lit(1).cast("long").alias("one"))
    return folds.running(rows, "lang", ["document", "chunk", "fragment"], "one", "place").select("lang", "doc_id", "document", "chunk", "place")


def batches(t: Tables) -> DataFrame:
    return packing.packed(fragments(t), "lang", ["document", "chunk", "fragment"], "tokens", LIMIT, MOST)


@query(f"with recursive {PACKED} select lang, doc_id, batch::bigint batch, used batch_tokens_before, tokens > {LIMIT} oversized from w")
def batch_plan(t: Tables) -> DataFrame:
    """The batch of each fragment: in order, as many as fit."""
    return batches(t).select("lang", F.col("fragment").cast("long").alias("doc_id"), "batch", "batch_tokens_before", "oversized")


@query(f"""with recursive {PACKED}, e as (select w.lang, batch, string_agg(w.doc_id || ':' || text, chr(10) order by w.n) evidence from w join f on f.doc_id = w.doc_id group by 1, 2),
 m as (select *, greatest(1, octet_length(encode(evidence)) // 3) evidence_tokens, greatest(1, octet_length(encode('{ENVELOPE}' || chr(10) || evidence)) // 3) + {OVERHEAD} full_request_tokens from e)
 select lang, batch::bigint batch, full_request_tokens, evidence_tokens, full_request_tokens - evidence_tokens fixed_envelope_tokens, sha256('{ENVELOPE}' || chr(10) || evidence) request_hash, sha256(evidence) evidence_hash from m""")
def request_tokens(t: Tables) -> DataFrame:
    """Sizes and hashes of the request of each batch: of all of it and of its evidence, and what the rest takes."""
    text = fragments(t).select("doc_id", "text")
    parts = batches(t).withColumn("doc_id", F.col("fragment").cast("long")).join(text, "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("document", "chunk", "fragment", F.concat_ws(":", F.col("doc_id").cast("string"), "text").alias("piece"))))
    e = parts.groupBy("lang", "batch").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n").alias("evidence"))  # of MOST fragments at most
    body = F.concat(F.lit(ENVELOPE + "\n"), "evidence")
    tokens = lambda c: F.greatest(F.lit(1), F.floor(F.octet_length(c) / 3))
    full, own = tokens(body) + OVERHEAD, tokens(F.col("evidence"))
    return e.select("lang", "batch", full.alias("full_request_tokens"), own.alias("evidence_tokens"), (full - own).alias("fixed_envelope_tokens"), F.sha2(body, 256).alias("request_hash"), F.sha2("evidence", 256).alias("evidence_hash"))


@query(f"""with recursive e as (select event_id, case when event_type = 'error' then 'sev1' when event_type = 'purchase' then 'sev2' when event_type = 'click' then 'sev3' else event_type end severity, ts + interval 3 hour l from events),
 b as (select event_id, severity, case severity {" ".join(f"when '{k}' then {v * 3600}::bigint" for k, v in worktime.HOURS.items())} end need,
   case when dayofweek(l) in (0, 6) then null else l end a, l from e),
 s(event_id, severity, need, c) as (select event_id, severity, need, case when a is null then l::date + interval 33 hour when hour(l) < 9 then l::date + interval 9 hour when hour(l) >= 18 then l::date + interval 33 hour else l end from b where need is not null
  union all select event_id, severity, case when dayofweek(c) in (0, 6) then need else need - epoch_us(c::date + interval 18 hour - c) // 1000000 end, c::date + interval 33 hour
   from s where dayofweek(c) in (0, 6) or need > epoch_us(c::date + interval 18 hour - c) // 1000000)
 select event_id, b.severity, t.deadline from b left join (select event_id, c + to_seconds(need) - interval 3 hour deadline from s where dayofweek(c) not in (0, 6) and need <= epoch_us(c::date + interval 18 hour - c) // 1000000) t using (event_id)""")
def sla_business_start(t: Tables) -> DataFrame:
    """When work on an event has to begin: working hours by severity, in the zone of the office; kinds without a severity have no deadline."""
    kind = F.col("event_type")
    severity = F.when(kind == "error", "sev1").when(kind == "purchase", "sev2").when(kind == "click", "sev3").otherwise(kind)
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), severity.alias("severity"))
    return worktime.with_deadline(e, "ts", "severity", "deadline").select("event_id", "severity", F.col("deadline").cast("timestamp_ntz").alias("deadline"))


def packet(t: Tables) -> DataFrame:
    """Documents as evidence of cases (their sources), with ids that follow from what is in them."""
    d = t.documents.select(F.col("source").alias("case"), F.col("doc_id").alias("document_id"), F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("document_name"), F.col("lang").alias("chunk_id"), "text")
    return grounding.packet(d)


def claims(t: Tables) -> DataFrame:
    """Claims about documents: most say what stands there, others do not, take a decision, or come twice."""
    k = F.col("doc_id")
    value = F.when(k % 13 == 0, "go").when(k % 5 == 0, "absent value").otherwise(F.substring("text", 11, 12))
    path = F.when(k % 13 == 0, "result.bid_decision").otherwise("fields[0].subject")
    one = t.documents.filter("length(text) >= 40").select(F.concat(F.lit("c"), "doc_id").alias("claim_id"), k.alias("at"), path.alias("field_path"), value.alias("value"), F.array(value).alias("values"))
    return one.unionByName(one.filter("at % 19 = 0").withColumn("at", F.col("at") + 1_000_000_000))


def references(t: Tables) -> DataFrame:
    """References of the claims: quotes that are right, altered, wrongly hashed, of another document's name, or of no fragment."""
    k = F.col("document_id")
    p = packet(t).filter("length(text) >= 40")
    quote = F.when(k % 4 == 1, F.concat(F.lit("#"), F.substring("text", 6, 30))).otherwise(F.substring("text", 6, 30))
    sha = F.when(k % 9 == 2, F.lit("0")).otherwise(F.sha2(quote, 256))
    base = [F.concat(F.lit("c"), k).alias("claim_id"), "case", F.when(k % 17 == 8, "none").otherwise(F.col("fragment_id")).alias("fragment_id"), "document_id", F.when(k % 11 == 5, "other").otherwise(F.col("document_name")).alias("document_name"), "chunk_id"]
    more = F.substring("text", 1, 40)
    first = p.filter("document_id % 7 <> 3").select(*base, quote.alias("quote"), sha.alias("quote_sha256"))
    return first.unionByName(p.filter("document_id % 6 = 0 and document_id % 7 <> 3").select(*base, more.alias("quote"), F.sha2(more, 256).alias("quote_sha256")))


PACKET = """p as (select source as case_, doc_id document_id, 'doc-' || doc_id || '.txt' document_name, lang chunk_id, text, sha256(doc_id || chr(31) || 'doc-' || doc_id || '.txt' || chr(31) || coalesce(lang, '') || chr(31) || coalesce(text, '')) fragment_id from documents)"""
CLAIMS = f"""{PACKET}, c as (select 'c' || doc_id claim_id, doc_id as at_, case when doc_id % 13 = 0 then 'go' when doc_id % 5 = 0 then 'absent value' else substr(text, 11, 12) end v, doc_id % 13 = 0 never from documents where length(text) >= 40),
 cc as (select * from c union all select claim_id, at_ + 1000000000, v, never from c where at_ % 19 = 0),
 r as (select 'c' || document_id claim_id, document_id k, text, fragment_id, quote, sha from (select *, unnest([case when document_id % 4 = 1 then '#' || substr(text, 6, 30) else substr(text, 6, 30) end] || case when document_id % 6 = 0 then [substr(text, 1, 40)] else [] end) quote, unnest([1] || case when document_id % 6 = 0 then [2] else [] end) nr from p where length(text) >= 40 and document_id % 7 <> 3),
   lateral (select case when nr = 1 and document_id % 9 = 2 then '0' else sha256(quote) end sha)),
 e as (select claim_id, k, quote, case when k % 17 = 8 then ['reference_fragment_not_found'] else list_filter([case when k % 11 = 5 then 'reference_document_name_mismatch' end, case when sha <> sha256(quote) then 'reference_quote_hash_mismatch' end, case when not contains(text, quote) then 'reference_quote_not_found' end], lambda x: x is not null) end errors from r)"""
PLAIN = r"lower(trim(regexp_replace({}, '[\s\x{{85}}\x{{a0}}]+', ' ', 'g')))"


@query(f"with {PACKET} select case_ as case, document_id, fragment_id, sha256(text) text_sha256 from p")
def evidence_packet(t: Tables) -> DataFrame:
    return packet(t).select("case", "document_id", "fragment_id", "text_sha256")


@query(f"with {CLAIMS} select claim_id, quote, array_to_string(errors, ',') errors from e")
def grounding_reference(t: Tables) -> DataFrame:
    """What is wrong with each reference, if anything."""
    found = grounding.checked_references(references(t), packet(t))
    return found.select("claim_id", "quote", F.array_join("errors", ",").alias("errors"))


@query(f"with {CLAIMS}, q as (select claim_id, {PLAIN.format('string_agg(quote, chr(10))')} q from e group by 1) select claim_id, at_ as at, {PLAIN.format('v')} <> '' and contains(q, {PLAIN.format('v')}) supported from cc join q using (claim_id)")
def grounding_lexical(t: Tables) -> DataFrame:
    """Whether the value of each claim stands in its quotes."""
    quotes = references(t).groupBy("claim_id").agg(F.collect_list("quote").alias("quotes"))
    return claims(t).join(quotes, "claim_id").select("claim_id", "at", grounding.supported(F.col("values"), F.col("quotes")).alias("supported"))


@query(f"""with {CLAIMS}, g as (select claim_id, count(*) n, list_sort(list_distinct(flatten(list(errors)))) wrong, {PLAIN.format('string_agg(quote, chr(10))')} q from e group by 1),
 j as (select cc.claim_id, at_, v, never, n, case when at_ >= 1000000000 then ['duplicate_claim_id'] else []::varchar[] end twice, coalesce(wrong, []::varchar[]) wrong, q from cc left join g using (claim_id)),
 s as (select *, case when never then twice || ['provider_positive_decision_prohibited'] when n is null then twice || ['claim_has_no_evidence'] when len(twice || wrong) = 0 then case when {PLAIN.format('v')} <> '' and contains(q, {PLAIN.format('v')}) then []::varchar[] else ['claim_value_not_lexically_supported'] end else list_sort(twice || wrong) end errors from j)
 select claim_id, at_ as at, case when never then 'REJECTED' when n is null then 'INSUFFICIENT_EVIDENCE' when len(errors) = 0 then 'SUPPORTED' else 'REJECTED' end support_status, case when not never and n is not null and len(errors) = 0 then case when n > 1 then 0.98::double else 0.95::double end end validated_confidence, array_to_string(errors, ',') errors from s""")
def grounding_validate(t: Tables) -> DataFrame:
    """The status of each claim: supported, rejected or without evidence, and why."""
    found = grounding.validated(claims(t), grounding.checked_references(references(t), packet(t)))
    return found.select("claim_id", "at", "support_status", "validated_confidence", F.array_join("errors", ",").alias("errors"))
