"""Files of quotes and vendors: written from the tables in several encodings and dialects, read back, parsed and imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..sources import cells
from ..tables import kept, new_path
from .registry import Tables, query

QUOTE_HEADER = ("№", "Наименование товара", "Кол-во", "Ед. изм.", "Цена за ед.", "Сумма", "Валюта")
# Headers of vendor lists, by the column that they name.
VENDOR_ALIASES = {
    "legal_name": ("legal_name", "Юрлицо", "Юридическое лицо", "Наименование", "Название компании", "Поставщик"),
    "display_name": ("display_name", "Краткое название", "Название", "Отображаемое название"),
    "inn": ("inn", "ИНН"),
    "website": ("website", "url", "Сайт"),
    "email": ("email", "Почта", "E-mail"),
    "phone": ("phone", "Телефон"),
    "categories": ("categories", "Категории", "Категория", "Направления", "Товары"),
    "brands": ("brands", "Бренды", "Производители", "Марки"),
    "region": ("region", "Регион", "Город", "География"),
    "notes": ("notes", "Комментарий", "Примечание", "Заметки"),
}


def of_file(pattern: str = "file=([0-9]+)") -> Column:
    return F.regexp_extract("file", pattern, 1).cast("long")


def quote_cells(t: Tables) -> DataFrame:
    """Cells of one quote for each supplier: a title, a blank row, the header and all of the supplier's lines. By supplier they are UTF-8 with commas,
    CP1251 with semicolons and decimal commas, or UTF-8 with tabs."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    price = F.when(F.col("l_linenumber") % 2 == 1, F.format_number(F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100, 2))
    total = F.when(F.col("l_linenumber") % 2 == 0, F.format_number(F.round("l_extendedprice", 2), 2))
    local = lambda c: F.when(F.col("l_suppkey") % 3 == 1, F.concat(F.translate(c, ",.", " ,"), F.lit(" руб."))).otherwise(c)
    name = F.concat_ws(" ", "p_name", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    body = [F.col("l_linenumber").cast("string"), name, F.col("l_quantity").cast("int").cast("string"), F.lit("шт"), local(price), local(total), F.when(F.col("l_suppkey") % 3 == 1, "₽".replace("₽", "руб")).otherwise("USD")]
    columns = [f"c{i}" for i in range(len(QUOTE_HEADER))]
    rows = lines.select(F.col("l_suppkey").alias("file"), F.lit(3).alias("pos"), F.col("l_orderkey").alias("at"), *(c.alias(n) for c, n in zip(body, columns, strict=True)))
    heads = (("Коммерческое предложение", *[""] * (len(QUOTE_HEADER) - 1)), ("",) * len(QUOTE_HEADER), QUOTE_HEADER)
    top = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(0).cast("long").alias("at"), *(F.lit(x).alias(n) for x, n in zip(head, columns, strict=True))) for i, head in enumerate(heads)))
    suppliers = t.lineitem.select(F.col("l_suppkey").alias("file")).distinct()
    path = new_path(t.spark, "quotes")
    cells.write_files(rows.unionByName(suppliers.select("file", F.inline(top))), path, "file", ["pos", "at"], ((",", "UTF-8"), (";", "windows-1251"), ("\t", "UTF-8")))
    return cells.read_cells(t.spark, path, "*.txt")


@query("select l_suppkey supplier, p_name || ' ' || l_orderkey || '-' || l_linenumber as name, l_quantity::int::varchar quantity, case l_suppkey % 3 when 1 then 'cp1251' else 'utf-8-sig' end encoding from lineitem join part on l_partkey = p_partkey")
def scan_csv_quote(t: Tables) -> DataFrame:
    """Rows of the quotes as read back, whatever their encoding and dialect."""
    return quote_cells(t).filter("row > 3").select(of_file().alias("supplier"), F.get("cells", F.lit(1)).alias("name"), F.get("cells", F.lit(2)).alias("quantity"), "encoding")


@query("select distinct l_suppkey supplier, 3::bigint header_row, 11 score, 'currency:6,name:1,quantity:2,total_price:5,unit:3,unit_price:4' as columns from lineitem")
def header_row_detect(t: Tables) -> DataFrame:
    """The row of each quote that holds its headers, and the column each of them names."""
    h = cells.header_rows(quote_cells(t))
    named = F.array_join(F.transform(F.map_entries("at"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return h.select(of_file().alias("supplier"), "header_row", "score", named.alias("columns"))


@query("""with l as (select l_suppkey supplier, p_name || ' ' || l_orderkey || '-' || l_linenumber as name, l_quantity quantity, l_linenumber % 2 = 1 odd, floor(l_extendedprice * 100 / l_quantity) / 100 p, round(l_extendedprice, 2) s from lineitem join part on l_partkey = p_partkey)
 select supplier, name, quantity, 'шт' unit, case when odd then p else s / quantity end unit_price, case when odd then p * quantity else s end total_price, case supplier % 3 when 1 then 'RUB' else 'USD' end currency, 0.95::double confidence from l""")
def scan_spreadsheet_multisheet(t: Tables) -> DataFrame:
    """Items of the quotes: names, quantities, prices in any notation, a missing price or total from the other."""
    c = kept(quote_cells(t), "quote-cells")  # files are read once, for headers and items
    found = cells.items(c, cells.header_rows(c))
    return found.select(of_file().alias("supplier"), "name", "quantity", "unit", "unit_price", "total_price", "currency", "confidence")


def vendor_rows(t: Tables) -> DataFrame:
    """(file, row, fields) of vendor lists, one for each nation: tax numbers repeat or are missing, some names are empty."""
    s = t.supplier
    key = F.col("s_suppkey")
    inn = F.when(key % 5 != 0, (F.lit(7_700_000_000) + key % 40).cast("string"))
    body = {
        "ИНН": F.concat(F.lit("ИНН "), inn), "Юридическое лицо": F.when(key % 11 != 3, F.col("s_name")), "Сайт": F.concat(F.lit("www."), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example/")),
        "E-mail": F.concat(F.lit(" Sales@"), F.col("s_nationkey").cast("string"), F.lit(".Example ")), "Телефон": F.concat(F.lit("8 (495) "), F.lpad(key.cast("string"), 7, "0")), "Прочее": F.lit("—"), "Примечание": F.concat(F.lit("note "), (key % 3).cast("string")),
    }
    columns = [f"c{i}" for i in range(len(body))]
    rows = s.select(F.col("s_nationkey").alias("file"), F.lit(1).alias("pos"), key.alias("at"), *(c.alias(n) for c, n in zip(body.values(), columns, strict=True)))
    head = s.select(F.col("s_nationkey").alias("file")).distinct().select("file", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("at"), *(F.lit(x).alias(n) for x, n in zip(body, columns, strict=True)))
    path = new_path(t.spark, "vendors")
    cells.write_files(head.unionByName(rows), path, "file", ["pos", "at"], ((";", "windows-1251"),))
    return cells.records(cells.read_cells(t.spark, path, "*.txt"), VENDOR_ALIASES)


VENDORS = """v as (select s_suppkey, s_nationkey file, row_number() over (partition by s_nationkey order by s_suppkey) + 1 as row, case when s_suppkey % 11 <> 3 then s_name end as legal, case when s_suppkey % 5 <> 0 then (7700000000 + s_suppkey % 40)::varchar end inn,
  'www.' || lower(replace(s_name, '#', '-')) || '.example/' site, ' Sales@' || s_nationkey || '.Example ' mail, 'note ' || s_suppkey % 3 note, '8 (495) ' || lpad(s_suppkey::varchar, 7, '0') phone from supplier)"""


@query(f"with {VENDORS} select file::bigint file, row, legal legal_name, case when inn is null then null else 'ИНН ' || inn end inn, site website, mail email, phone, note notes from v")
def scan_csv_vendor(t: Tables) -> DataFrame:
    """Rows of vendor lists by the canonical names of their columns; unknown columns are dropped."""
    text = lambda n: parsing.blank_to_null(F.element_at("fields", n)).alias(n)
    return vendor_rows(t).select(of_file().alias("file"), "row", *(text(n) for n in ("legal_name", "inn", "website", "email", "phone", "notes")))


def surrogate(label: Column, row: Column, fields: Column) -> Column:
    """A key for a row without a tax number, from where it stands and what it says."""
    said = [F.coalesce(F.element_at(fields, n), F.lit("")) for n in ("legal_name", "display_name", "website", "email")]
    return F.concat(F.lit("NOINN-"), F.upper(F.substring(F.sha1(F.concat_ws("|", label, row.cast("string"), *said)), 1, 12)))


def imported(rows: DataFrame, label: Column) -> DataFrame:
    """Vendor rows as they are imported: names, keys and contacts in normal form, the action taken, and why rows are left out.

    The first row of a key, by file and row, creates the supplier, later ones update it.
    """
    field = lambda n: F.trim(F.coalesce(F.element_at("fields", n), F.lit("")))
    legal, shown = parsing.blank_to_null(field("legal_name")), parsing.blank_to_null(field("display_name"))
    inn = parsing.blank_to_null(F.regexp_replace(field("inn"), r"[^0-9]+", ""))
    site = field("website")
    full = F.when(site.contains("://"), site).otherwise(F.concat(F.lit("https://"), site))
    host = F.ltrim(F.lower(F.regexp_extract(full, "^[^:]+://([^/?#]*)", 1)), F.lit("w."))
    path = F.regexp_extract(full, "^[^:]+://[^/?#]*([^?#]*)", 1)
    url = F.when(host != "", F.rtrim(F.concat(F.regexp_extract(full, "^([^:]+)://", 1), F.lit("://"), host, path), F.lit("/")))
    named = rows.select("file", "row", F.coalesce(legal, shown).alias("legal_name"), F.coalesce(shown, legal).alias("display_name"), F.coalesce(inn, surrogate(label, F.col("row"), F.col("fields"))).alias("key"), inn.isNull().alias("synthetic"), parsing.blank_to_null(F.lower(field("email"))).alias("email"), parsing.phone(field("phone")).alias("phone"), url.alias("website"), parsing.blank_to_null(field("notes")).alias("notes"))
    first = named.filter("legal_name is not null").groupBy("key").agg(F.min(F.struct("file", "row")).alias("first"))
    out = named.join(first, "key", "left")
    action = F.when(F.col("legal_name").isNull(), "skipped").when(F.struct("file", "row") == F.col("first"), "created").otherwise("updated")
    return out.withColumn("action", action).drop("first")


@query(f"""with {VENDORS}, k as (select *, coalesce(inn, 'NOINN-' || upper(substr(sha1('list|' || row || '|' || coalesce(legal, '') || '||' || site || '|' || mail), 1, 12))) key from v),
 a as (select *, case when legal is null then 'skipped' when row_number() over (partition by key, legal is null order by file::varchar, row) = 1 then 'created' else 'updated' end action from k)
 select file::bigint file, row, key, inn is null synthetic, lower(trim(mail)) email, '+7 495 ' || substr(phone, 9, 3) || '-' || substr(phone, 12, 2) || '-' || substr(phone, 14, 2) phone, 'https://' || ltrim(rtrim(site, '/'), 'w.') website, action from a""")
def vendor_import(t: Tables) -> DataFrame:
    """What becomes of each row of the vendor lists."""
    rows = vendor_rows(t).withColumn("file", F.regexp_extract("file", "file=([0-9]+)", 1))
    return imported(rows, F.lit("list")).select(F.col("file").cast("long").alias("file"), "row", "key", "synthetic", "email", "phone", "website", "action")


@query(f"with {VENDORS} select s_suppkey, 'NOINN-' || upper(substr(sha1('list|' || row || '|' || coalesce(legal, '') || '||' || site || '|' || mail), 1, 12)) key from v where inn is null")
def surrogate_missing_key(t: Tables) -> DataFrame:
    """Keys of the rows that have no tax number."""
    rows = vendor_rows(t).filter("coalesce(fields['inn'], '') = ''")
    number = F.regexp_extract(F.element_at("fields", "website"), "([0-9]+)[.]example", 1).cast("long")
    return rows.select(number.alias("s_suppkey"), surrogate(F.lit("list"), F.col("row"), F.col("fields")).alias("key"))
