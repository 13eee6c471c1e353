"""Notices and search pages: XML and HTML written from orders and customers, read back into fields, purchases, attachments and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import trees
from .registry import Tables, query

# Names of elements by the field that they may hold, the most telling first.
NOTICE = {
    "nmck": ("maxPrice", "initialPrice", "contractPrice", "initial_price", "price"),
    "publication_date": ("publishDTInEIS", "publishDate", "placingDate", "publicationDate", "publication_date", "createDate"),
    "submission_deadline": ("endDT", "endDate", "applicationEndDate", "collectingEndDate", "submissionDeadline", "deadline"),
    "delivery_term": ("deliveryTerm", "deliveryTermInfo", "deliveryPeriod", "deliveryDate"),
    "placer_name": ("placer", "customer", "customerInfo", "fullName", "legalEntityName"),
    "placer_inn": ("inn", "customerInn", "placerInn"),
    "procurement_subject": ("subject", "lotSubject", "procurementSubject", "contractSubject", "lotObjectInfo", "purchaseObjectInfo", "purchaseObject"),
}
CUSTOMER = {"customer_name": ("fullName", "name"), "customer_inn": ("INN", "inn")}
PURCHASES = ("procurement", "purchase", "notice")
PURCHASE = {
    "procurement_id": ("procurement_id", "procurementId", "id", "guid"),
    "title": ("title", "name", "purchaseName", "subject"),
    "customer_name": ("customer_name", "customerName", "customer", "organizationName"),
    "source_url": ("source_url", "sourceUrl", "url", "href"),
    "notice_number": ("notice_number", "noticeNumber", "purchaseNumber"),
    "attachments": ("attachments_count", "attachmentsCount", "documentsCount"),
    "law": ("law", "fz", "lawName"),
    "initial_price": ("initial_price", "initialPrice", "maxPrice"),
    "currency": ("currency", "currencyCode"),
    "status": ("status", "state", "statusName"),
}
ATTACHMENT_TAGS = ("attachment", "attachmentinfo", "document", "documentinfo", "file", "fileinfo")
ATTACHMENT = {"name": ("fileName", "docName", "name", "documentName", "title"), "url": ("url", "downloadUrl", "fileUrl", "href", "link")}
KINDS = (
    ("estimate", ("обоснование нмцк", "обоснование начальной", "расчет нмцк", "расчёт нмцк")),
    ("technical_specification", ("техническое задание", "техзад", " тз", "тз ", "technical specification")),
    ("procurement_object_description", ("описание объекта закупки", "описание товара", "описание работ", "описание услуг", "ооз")),
    ("specification", ("спецификац",)),
    ("contract_draft", ("проект контракта", "проект договора", "контракт", "договор", "agreement", "contract")),
    ("estimate", ("смет",)),
    ("form", ("форма",)),
    ("eis_notice", ("извещение", "epnotification", "notice")),
)


def attachment_kind(name: Column) -> Column:
    """The first kind one of whose signs the name holds; else attachment."""
    low, out = F.lower(name), None
    for kind, signs in KINDS:
        test = F.exists(F.array(*map(F.lit, signs)), lambda s: F.contains(low, s))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("attachment")


def safe_url(c: Column) -> Column:
    """Paths, and addresses of the registry's own site; null for others."""
    t = F.trim(c)
    host = F.lower(F.regexp_extract(t, r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = t.rlike("^https?://") & ((host == "zakupki.gov.ru") | host.endswith(".zakupki.gov.ru"))
    return F.when(t.startswith("//"), None).when(t.startswith("/") | own, t)


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def element(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.coalesce(c, F.lit("")), F.lit(f"</{name}>"))


def notice_docs(t: Tables) -> DataFrame:
    """An XML notice for each order, with namespaces; in one status the price stands elsewhere, every fortieth document is cut off."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    price = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    f = F.col("o_orderstatus") == "F"
    file = F.concat(F.lit('<d:attachment><d:fileName>'), F.when(f, "Проект контракта").otherwise("Описание товара"), F.lit('.docx</d:fileName><d:url>'), F.when(F.col("o_orderkey") % 3 == 0, "https://evil.example/x").otherwise("https://www.zakupki.gov.ru/f?id="), F.col("o_orderkey").cast("string"), F.lit("</d:url></d:attachment>"))
    link = F.concat(F.lit('<d:fileInfo href="/files/'), F.col("o_custkey").cast("string"), F.lit('" title="Смета"/>'))
    xml = F.concat(
        F.lit('<n:export xmlns:n="urn:n" xmlns:d="urn:d"><n:notice>'), F.when(f, element("n:maxPrice", F.lit(" "))).otherwise(""), element("d:price", F.concat(F.when(f, "").otherwise(" "), F.replace(price, F.lit("."), F.lit(",")))), element("n:publishDate", F.concat(day, F.lit("T10:00:00+03:00"))),
        element("n:customer", F.concat(element("d:shortName", F.lit("x")), element("d:fullName", escaped(F.concat("c_name", F.lit(" & <Co>")))), element("d:INN", F.col("c_custkey").cast("string")))), element("n:lotObjectInfo", element("d:subject", F.col("o_orderpriority"))), element("n:files", F.concat(file, file, link)), F.lit("</n:notice></n:export>"),
    )
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 40 == 7, F.left(xml, F.lit(80))).otherwise(xml).alias("xml"))


def day_first(c: Column) -> Column:
    """dd.mm.yyyy with time and zone of what begins as an ISO date; other texts as they are."""
    at = lambda k: F.regexp_extract(c, r"^(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?([+-]\d{2}:?\d{2})?", k)
    return F.when(at(1) != "", F.concat_ws(" ", F.concat_ws(".", at(3), at(2), at(1)), F.nullif(at(4), F.lit("")), F.nullif(at(5), F.lit("")))).otherwise(c)


ORDERS = "o as (select *, o_orderkey % 40 = 7 broken from orders join customer on o_custkey = c_custkey)"


@query(f"""with {ORDERS} select o_orderkey, o_totalprice::decimal(20, 2)::double nmck, strftime(o_orderdate, '%d.%m.%Y') || ' 10:00:00 +03:00' publication_date, c_name || ' & <Co>' customer_name, c_custkey::varchar customer_inn, o_orderpriority procurement_subject from o where not broken""")
def scan_notice_xml(t: Tables) -> DataFrame:
    """Fields of notices: the first alias with a text, the customer's own name and number before others; broken documents have none."""
    main, own = trees.picker(NOTICE), trees.picker(CUSTOMER)
    j = trees.mapped(notice_docs(t), "o_orderkey", "xml", lambda found: [main(found) + own(n for n in found if n[6])], (*NOTICE, *CUSTOMER), ("customer",))
    return j.select("o_orderkey", trees.decimal_price(F.col("nmck")).alias("nmck"), day_first(F.col("publication_date")).alias("publication_date"), F.coalesce("customer_name", "placer_name").alias("customer_name"), F.coalesce("customer_inn", "placer_inn").alias("customer_inn"), "procurement_subject")


@query(f"""with {ORDERS} select o_orderkey, case when o_orderstatus = 'F' then 'Проект контракта.docx' else 'Описание товара.docx' end as name, 'https://www.zakupki.gov.ru/f?id=' || o_orderkey url, case when o_orderstatus = 'F' then 'contract_draft' else 'procurement_object_description' end document_kind from o where not broken and o_orderkey % 3 <> 0
 union all select o_orderkey, 'Смета', '/files/' || o_custkey, 'estimate' from o where not broken""")
def scan_notice_attachments(t: Tables) -> DataFrame:
    """Attachments of notices, each once: name and address from elements below or from attributes; addresses elsewhere are left out."""
    pick = trees.picker(ATTACHMENT)

    def listed(found: list[tuple]) -> dict[tuple, None]:
        below, out = trees.within(found), {}
        for n in found:
            tag = n[1].lower()
            if "attachment" in tag or tag in ATTACHMENT_TAGS:
                attr = [next((v for name in names if (v := n[5].get(name, "").strip(" "))), None) for names in ATTACHMENT.values()]
                out[tuple(a or b for a, b in zip(pick(below.get(n[0], ())), attr, strict=True))] = None
        return out

    raw = trees.mapped(notice_docs(t), "o_orderkey", "xml", listed, tuple(ATTACHMENT), ("attachment", "attachmentInfo", "document", "documentInfo", "file", "fileInfo"))
    rows = raw.select("o_orderkey", F.trim("name").alias("name"), safe_url(F.col("url")).alias("url"))
    named = rows.filter("url is not null").withColumn("name", F.coalesce("name", F.nullif(F.regexp_extract("url", "([^/?#]*)(?:[?#].*)?$", 1), F.lit("")), F.lit("document")))
    return named.groupBy("o_orderkey", F.lower("name").alias("key"), "url").agg(F.first("name").alias("name")).select("o_orderkey", "name", "url", attachment_kind(F.col("name")).alias("document_kind"))


def soap_docs(t: Tables) -> DataFrame:
    """Answers of a search service, with up to sixteen purchases each; some have no title, no customer or no address."""
    fields = ("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")

    def purchase(x: Column) -> Column:
        k = x["o_orderkey"]
        return F.concat(
            F.lit("<purchase>"), element("guid", k.cast("string")), element("purchaseName", F.when(k % 9 != 4, F.concat(F.lit("Поставка "), x["o_orderpriority"]))), element("organizationName", F.when(k % 5 != 2, F.concat(F.lit("К"), x["o_custkey"].cast("string")))), element("href", F.when(k % 7 != 3, F.concat(F.lit("https://zakupki.gov.ru/"), k.cast("string")))),
            element("documentsCount", (k % 3).cast("string")), element("maxPrice", x["o_totalprice"].cast("decimal(20,2)").cast("string")), element("lawName", F.lit("44-ФЗ")), element("statusName", x["o_orderstatus"]), F.lit("</purchase>"),
        )

    of = t.orders.groupBy(F.floor(F.col("o_orderkey") / 16).alias("answer")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ps"))
    return of.select("answer", F.concat(F.lit('<s:Envelope xmlns:s="urn:s"><s:Body><r xmlns="urn:r">'), F.array_join(F.transform("ps", purchase), ""), F.lit("</r></s:Body></s:Envelope>")).alias("xml"))


@query("""select o_orderkey::varchar procurement_id, 'Поставка ' || o_orderpriority title, case when o_orderkey % 5 <> 2 then 'К' || o_custkey else 'Не указан' end customer_name, case when o_orderkey % 7 <> 3 then 'https://zakupki.gov.ru/' || o_orderkey else 'https://zakupki.gov.ru/' end source_url,
  o_totalprice::decimal(20, 2)::double initial_price, 'RUB' currency, o_orderstatus status, o_orderkey % 3 attachments_count, case when o_orderkey % 3 > 0 then 'downloadable' else 'manual_upload_required' end attachments_status, (o_orderkey % 5 = 2)::int + (o_orderkey % 7 = 3)::int warnings from orders where o_orderkey % 9 <> 4""")
def scan_soap_xml(t: Tables) -> DataFrame:
    """Purchases of search answers: those without an id or a title are left out, others count what they lack."""
    pick = trees.picker(PURCHASE)
    p = trees.mapped(soap_docs(t), "answer", "xml", lambda found: map(pick, trees.within(found).values()), tuple(PURCHASE), PURCHASES).filter("procurement_id is not null and title is not null")
    n = F.coalesce(F.col("attachments").try_cast("long"), F.lit(0))
    lacks = [F.col(c).isNull().cast("int") for c in ("customer_name", "source_url", "law")]
    return p.select("procurement_id", "title", F.coalesce("customer_name", F.lit("Не указан")).alias("customer_name"), F.coalesce("source_url", F.lit("https://zakupki.gov.ru/")).alias("source_url"), trees.decimal_price(F.col("initial_price")).alias("initial_price"), F.coalesce("currency", F.lit("RUB")).alias("currency"), "status", n.alias("attachments_count"), F.when(n > 0, "downloadable").otherwise("manual_upload_required").alias("attachments_status"), (lacks[0] + lacks[1] + lacks[2]).alias("warnings"))


def search_pages(t: Tables) -> DataFrame:
    """Search pages with up to ten cards of orders; every eighth page has links only."""
    block = lambda a, b: F.concat(F.lit(f'<div class="data-block__title">{a}:</div>\n <div class="x data-block__value">'), b, F.lit("</div>"))

    def entry(x: Column) -> Column:
        number = F.lpad(x["o_orderkey"].cast("string"), 19, "3")
        card = F.concat(
            F.lit('<div class="search-registry-entry-block registry-entry"><a href="/notice/view?regNumber='), number, F.lit('">№ '), number, F.lit("</a>"), block("Объект закупки", F.concat(F.lit("<b>Поставка</b>&nbsp;&amp; "), x["o_orderpriority"])), block("Заказчик", F.concat(F.lit("<span>К"), x["o_custkey"].cast("string"), F.lit("</span>"))), block("Заказчик", F.lit("второй")),
            block("Размещено", F.date_format(x["o_orderdate"], "dd.MM.yyyy")), block("Окончание подачи", F.concat(F.date_format(x["o_orderdate"], "dd.MM.yyyy"), F.lit(" 09:30 (МСК)"))), F.lit("</div>"),
        )
        bare = F.concat(F.lit('<a href="/v?n='), number, F.lit('">'), number, F.lit("</a>"))
        return F.when(F.floor(x["o_orderkey"] / 10) % 8 == 5, bare).otherwise(card)

    of = t.orders.groupBy(F.floor(F.col("o_orderkey") / 10).alias("page")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"))).alias("cs"))
    return of.select("page", F.concat(F.lit("<html><body><h1>Результаты</h1>"), F.array_join(F.transform("cs", entry), "\n"), F.lit("</body></html>")).alias("html"))


NUMBER = r'href="[^"]*?(\d{11,25})'


CARDS = "c as (select o_orderkey k, o_orderkey // 10 page, lpad(o_orderkey::varchar, 19, '3') number, o_orderkey // 10 % 8 = 5 bare, * from orders)"


@query(f"""with {CARDS} select page, number notice_number, case when not bare then 'Поставка & ' || o_orderpriority end title, case when not bare then 'к' || o_custkey end customer_name, case when not bare then o_orderdate::date end published, case when not bare then o_orderdate::date + interval 570 minute end deadline from c""")
def scan_html_cards(t: Tables) -> DataFrame:
    """Cards of search pages with number, title, customer and dates; a page without cards gives the numbers of its links, each once."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a[^>]*href="[^"]*?(\d{11,25})[^"]*"'), 1))
    of_card = lambda x: F.struct(F.regexp_extract(x, NUMBER, 1).alias("number"), trees.label_pairs(x, "data-block__title", "data-block__value").alias("p"))
    of_link = lambda x: F.struct(x.alias("number"), F.lit(None).cast("map<string,string>").alias("p"))
    found = F.transform(F.array(trees.cards(F.col("html"))), lambda c: F.when(F.size(c) > 0, F.transform(c, of_card)).otherwise(F.transform(links, of_link)))
    # outer, or Spark works the pieces out a second time to drop pages without any
    one = search_pages(t).select("page", F.explode_outer(F.get(found, 0)).alias("e")).filter("e is not null").select("page", F.col("e.number").alias("notice_number"), F.col("e.p").alias("p"))
    named = lambda n: F.try_element_at("p", F.lit(n))
    titled = one.select("page", "notice_number", named("объект закупки").alias("title"), F.lower(named("заказчик")).alias("customer_name"), F.to_date(trees.public_time(named("размещено"))).alias("published"), trees.public_time(named("окончание подачи")).cast("timestamp_ntz").alias("deadline"), F.col("p").isNull().alias("bare"))
    return titled.filter("title is not null or bare").drop("bare")


@query(f"with {CARDS} select page, number notice_number, unnest(['объект закупки', 'заказчик', 'размещено', 'окончание подачи']) label, unnest(['Поставка & ' || o_orderpriority, 'К' || o_custkey, strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%d.%m.%Y') || ' 09:30 (МСК)']) as value from c where not bare")
def html_label_pairs(t: Tables) -> DataFrame:
    """Labels and values of each card; of a label that comes twice the first value counts."""
    one = search_pages(t).select("page", F.explode_outer(trees.cards(F.col("html"))).alias("card")).filter("card is not null")
    pairs = F.explode_outer(trees.label_pairs(F.col("card"), "data-block__title", "data-block__value")).alias("label", "value")
    return one.select("page", F.regexp_extract("card", NUMBER, 1).alias("notice_number"), pairs).filter("label is not null")


@query("""select o_orderkey, case o_orderkey % 5 when 4 then null when 3 then o_orderdate::date::timestamp when 2 then o_orderdate::date::timestamp else o_orderdate::date + interval 570 minute end parsed from orders""")
def date_parse_public(t: Tables) -> DataFrame:
    """Times as public pages print them."""
    k, d = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "dd.MM.yyyy")
    text = F.when(k == 0, F.concat(F.lit("<span>"), d, F.lit("</span> 09:30&nbsp;(МСК)"))).when(k == 1, F.concat(d, F.lit("  9:30:00"))).when(k == 2, d).when(k == 3, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(d, F.lit(" at nine")))
    return t.orders.select("o_orderkey", trees.public_time(text).cast("timestamp_ntz").alias("parsed"))
