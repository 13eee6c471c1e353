"""Quotes as texts and from two readers: labelled fields, amounts and terms; what one reader lacks is filled from the other; addresses compared."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from .registry import Tables, query

# Labels of the fields of a quote, in the order in which they are tried, and parameters that only track visitors.
LABELS = {
    "total_amount": ("total price", "итого", "total amount", "сумма", "стоимость"),
    "total_amount_without_vat": ("price without vat", "без ндс", "total without vat"),
    "unit_price": ("price per unit", "цена за ед", "unit price", "цена"),
    "quote_date": ("quote date", "дата", "date"),
    "valid_until": ("valid until", "offer validity", "действительно до"),
    "vat_rate": ("vat", "ндс"),
    "vat_included": ("with vat", "с ндс", "включая ндс"),
    "delivery_cost": ("delivery cost", "стоимость доставки", "доставка"),
    "delivery_time_days": ("delivery time", "срок поставки", "срок"),
    "payment_terms": ("payment terms", "условия оплаты", "оплата"),
    "warranty_months": ("warranty", "гарантия"),
    "availability": ("availability", "наличие"),
    "includes_delivery": ("packaging/delivery", "delivery included", "доставка включ"),
    "includes_installation": ("installation", "монтаж"),
    "certificates_available": ("certificate", "сертификат", "eac", "iso"),
}
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referrer", "source", "mc_cid", "mc_eid", "fbclid", "gclid", "yclid", "igshid")
FILLED = ("quote_date", "currency_code", "total_amount", "delivery_time_days", "payment_terms", "contact_email")


def labelled(text: Column, labels: tuple[str, ...]) -> Column:
    """The rest of the line behind the first of the labels that has one, after a colon or a dash; null if none has."""
    found = lambda label: F.trim(F.regexp_extract(text, rf"(?iu){re.escape(label)}\s*[:\-]\s*([^\r\n]+)", 1))
    return F.coalesce(*(parsing.blank_to_null(found(label)) for label in labels))


def date_in(c: Column) -> Column:
    """The first date of a cell, ISO or day first, as it stands."""
    return F.coalesce(parsing.blank_to_null(F.regexp_extract(c, "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)), parsing.blank_to_null(F.regexp_extract(c, r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", 0)))


def fields_of(text: Column) -> dict[str, Column]:
    """Columns of what a quote's text says, each in its own type; roubles where no currency is named."""
    said = {k: labelled(text, v) for k, v in LABELS.items()}
    read = {
        "total_amount": parsing.locale_number, "total_amount_without_vat": parsing.locale_number, "unit_price": parsing.locale_number, "delivery_cost": parsing.locale_number, "quote_date": date_in, "valid_until": date_in, "vat_rate": parsing.vat_rate,
        "vat_included": parsing.yes_no, "includes_delivery": parsing.yes_no, "includes_installation": parsing.yes_no, "certificates_available": parsing.yes_no, "delivery_time_days": lambda c: parsing.digits(c, 4), "warranty_months": lambda c: parsing.digits(c, 3),
    }
    out = {k: read.get(k, lambda c: c)(v) for k, v in said.items()}
    phone = parsing.blank_to_null(F.trim(F.regexp_extract(text, r"\+?[0-9][0-9() \-]{8,}[0-9]", 0)))
    return out | {"currency_code": F.coalesce(parsing.currency(text), F.lit("RUB")), "contact_email": parsing.email(text), "contact_phone": phone}


def quote_texts(t: Tables) -> DataFrame:
    """A quote in words for each order, in Russian or English."""
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "dd.MM.yyyy")
    amount = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    days = (k % 60 + 1).cast("string")
    ru = F.concat(F.lit("Дата: "), d, F.lit("\r\nИтого - "), F.replace(amount, F.lit("."), F.lit(",")), F.lit(" руб.\nНДС: 20%\nСрок поставки: "), days, F.lit(" дней\nОплата: по факту\nГарантия: 12 месяцев\nДоставка включена: да\nПочта: A"), k.cast("string"), F.lit("@Mail.example"))
    en = F.concat(F.lit("Quote date: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nTotal price: "), amount, F.lit(" USD\nVAT: without VAT\nDelivery time: "), days, F.lit(" days\nPayment terms: 30 days net\nWarranty: 24 months\nDelivery included: not included\nTel. +7 (495) 123-45-67"))
    return t.orders.select("o_orderkey", F.when(k % 2 == 0, ru).otherwise(en).alias("text"))


@query("""select o_orderkey, o_totalprice::decimal(20, 2)::double total_amount, case when e then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%d.%m.%Y') end quote_date, case when e then 'USD' else 'RUB' end currency_code, case when e then 0.0::double else 20.0::double end vat_rate,
  (o_orderkey % 60 + 1)::int delivery_time_days, case when e then '30 days net' else 'по факту' end payment_terms, case when e then 24 else 12 end warranty_months, case when e then true end includes_delivery, case when not e then 'a' || o_orderkey || '@mail.example' end contact_email, case when e then strftime(o_orderdate, '%Y-%m-%d') end contact_phone
 from (select *, o_orderkey % 2 = 1 e from orders)""")
def quote_text_parse(t: Tables) -> DataFrame:
    """What the texts of quotes say, by the rules as they are: a label has to end before its colon, a hint for yes goes before one for no, and an
    ISO date is the first thing that looks like a telephone number."""
    wanted = ("total_amount", "quote_date", "currency_code", "vat_rate", "delivery_time_days", "payment_terms", "warranty_months", "includes_delivery", "contact_email", "contact_phone")
    found = fields_of(F.col("text"))
    return quote_texts(t).select("o_orderkey", *(found[c].alias(c) for c in wanted))


@query("select o_orderkey, case when o_orderkey % 2 = 1 then '30 days net' else 'по факту' end terms, case when o_orderkey % 2 = 1 then (o_orderkey % 60 + 1) || ' days' else (o_orderkey % 60 + 1) || ' дней' end delivery from orders")
def extract_labelled_field(t: Tables) -> DataFrame:
    """Two fields as they stand behind their labels."""
    return quote_texts(t).select("o_orderkey", labelled(F.col("text"), LABELS["payment_terms"]).alias("terms"), labelled(F.col("text"), LABELS["delivery_time_days"]).alias("delivery"))


def merged(pairs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One quote from two readings of it, in columns a_... (by rules) and b_... (by a model; b_status null where there is none).

    A reading by rules that is parsed and sure by 0.95 stays as it is. Else what it lacks comes from the other, review fields are united
    and sorted, warnings united in order, and the status is the other's unless that failed.
    """
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    alone = b("status").isNull() | F.coalesce((a("status") == "parsed") & (a("confidence") >= 0.95), F.lit(False))
    empty = lambda c: c.isNull() | (c.cast("string") == "")
    pick = lambda c: F.when(~alone & empty(a(c)), b(c)).otherwise(a(c)).alias(c)
    lines = F.when(~alone & (F.size(a("line_items")) == 0) & (F.size(b("line_items")) > 0), b("line_items")).otherwise(a("line_items"))
    review = F.when(alone, a("review")).otherwise(F.array_sort(F.array_union(a("review"), b("review"))))
    warnings = F.when(alone, a("warnings")).otherwise(F.array_distinct(F.concat(a("warnings"), b("warnings"))))
    status = F.when(alone | (b("status") == "failed"), a("status")).otherwise(b("status"))
    mode = F.when(alone, a("mode")).when(a("mode") == "deterministic", "hybrid").otherwise(b("mode"))
    own = [c for c in pairs.columns if not c.startswith(("a_", "b_"))]
    return pairs.select(*own, *map(pick, fields), lines.alias("line_items"), review.alias("review"), warnings.alias("warnings"), status.alias("status"), F.when(alone, a("confidence")).otherwise(F.greatest(a("confidence"), b("confidence"))).alias("confidence"), mode.alias("mode"))


@query("""with r as (select l_orderkey k, count(*) n, max(l_extendedprice) p, min(l_partkey) i from lineitem group by 1), x as (select *, k % 4 = 0 or (k % 3 <> 0 and k % 2 = 0) alone from r)
 select k, case when not alone and k % 5 = 0 then p else case when k % 5 <> 0 then p + 1 end end total_amount, case when not alone and k % 7 < 2 then 'b' else case when k % 7 >= 2 then 'a' when k % 7 = 1 then '' end end payment_terms, case when n > 1 or alone then n - 1 else 1 end line_items,
  case when alone then 'price,unit' else 'date,price,unit' end review, case when alone then 'w2,w1' else 'w2,w1,w3' end warnings, case when alone or k % 9 = 1 then case when k % 3 <> 0 then 'parsed' else 'partial' end else 'reviewed' end status,
  case when alone then case when k % 2 = 0 then 0.96::double else 0.4::double end else greatest(case when k % 2 = 0 then 0.96::double else 0.4::double end, 0.7::double) end confidence, case when alone then 'deterministic' else 'hybrid' end as mode from x""")
def merge_quotes(t: Tables) -> DataFrame:
    """Two readings of the quote of each order, merged."""
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("p"))
    k, lit = F.col("k"), lambda *xs: F.array(*map(F.lit, xs))
    none = F.lit(None).cast("string")
    pairs = g.select(
        "k", F.when(k % 5 != 0, F.col("p") + 1).alias("a_total_amount"), F.when(k % 7 >= 2, "a").when(k % 7 == 1, "").alias("a_payment_terms"), F.array_repeat(F.lit(1), (F.col("n") - 1).cast("int")).alias("a_line_items"), lit("price", "unit").alias("a_review"), lit("w2", "w1").alias("a_warnings"),
        F.when(k % 3 != 0, "parsed").otherwise("partial").alias("a_status"), F.when(k % 2 == 0, 0.96).otherwise(0.4).alias("a_confidence"), F.lit("deterministic").alias("a_mode"),
        F.col("p").alias("b_total_amount"), F.lit("b").alias("b_payment_terms"), lit(1).alias("b_line_items"), lit("unit", "date").alias("b_review"), lit("w1", "w3").alias("b_warnings"), F.when(k % 4 == 0, none).when(k % 9 == 1, "failed").otherwise("reviewed").alias("b_status"), F.lit(0.7).alias("b_confidence"), F.lit("llm").alias("b_mode"),
    )
    m = merged(pairs, ("total_amount", "payment_terms"))
    return m.select("k", "total_amount", "payment_terms", F.size("line_items").cast("long").alias("line_items"), F.array_join("review", ",").alias("review"), F.array_join("warnings", ",").alias("warnings"), "status", "confidence", "mode")


def dedup_url(c: Column) -> Column:
    """An address as duplicates are told by it: lower case, no fragment, no tracking parameters, the others sorted, no slashes at the end; where
    slashes repeat in the path, all runs of slashes become one, that of the scheme too."""
    u = F.regexp_replace(F.lower(F.trim(c)), "(?s)#.*$", "")
    base, rest = F.regexp_extract(u, r"(?s)^([^?]*)", 1), F.regexp_extract(u, r"(?s)^[^?]*\?(.*)$", 1)
    drops = F.array(*map(F.lit, TRACKING))
    params = F.array_sort(F.filter(F.split(rest, "&"), lambda p: ~(p.contains("=") & F.array_contains(drops, F.split(p, "=")[0]))))
    joined = F.when(u.contains("?") & (F.size(params) > 0), F.concat(base, F.lit("?"), F.array_join(params, "&"))).otherwise(base)
    bare = F.regexp_replace(joined, "/+$", "")
    return F.replace(F.when(F.replace(bare, F.lit("://"), F.lit("::")).contains("//"), F.regexp_replace(bare, "/+", "/")).otherwise(bare), F.lit("::"), F.lit("://"))


@query(f"""with u as (select page_id, lower(trim(case page_id % 3 when 0 then url when 1 then ' ' || url || '&b=2&A=1&utm_source=x//' else replace(url, '/en', '//en') || '/?ref=1#f' end)) u from pages), f as (select page_id, regexp_replace(u, '#.*$', '') u from u),
 p as (select page_id, u, regexp_extract(u, '^([^?]*)', 1) base, list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\\?(.*)$', 1), '&'), lambda x: not (contains(x, '=') and split_part(x, '=', 1) in ({", ".join(f"'{x}'" for x in TRACKING)})))) ps from f),
 b as (select page_id, regexp_replace(case when contains(u, '?') and len(ps) > 0 then base || '?' || array_to_string(ps, '&') else base end, '/+$', '') b from p)
 select page_id, replace(case when contains(replace(b, '://', '::'), '//') then regexp_replace(b, '/+', '/', 'g') else b end, '::', '://') url from b""")
def url_normalize_dedup(t: Tables) -> DataFrame:
    """Addresses of pages with parameters, fragments and slashes added, in the form by which duplicates are told."""
    k, url = F.col("page_id") % 3, F.col("url")
    given = F.when(k == 0, url).when(k == 1, F.concat(F.lit(" "), url, F.lit("&b=2&A=1&utm_source=x//"))).otherwise(F.concat(F.replace(url, F.lit("/en"), F.lit("//en")), F.lit("/?ref=1#f")))
    return t.pages.select("page_id", dedup_url(given).alias("url"))
