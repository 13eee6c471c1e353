"""Values out of the cells of quotes, price lists and notices, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each letter is written as, header names, hints and unit names.
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
HEADERS = {
    "item_number": ("№", "n", "номер", "п/п", "item", "row"),
    "name": ("наименование", "товар", "позиция", "описание", "номенклатура", "оборудование", "description", "product", "name", "item"),
    "quantity": ("кол-во", "количество", "qty", "quantity"),
    "unit": ("ед", "ед изм", "ед. изм", "единица", "unit", "uom"),
    "unit_price": ("цена", "цена за ед", "unit price", "price", "price per unit", "цена без ндс", "цена с ндс"),
    "total_price": ("сумма", "стоимость", "итого", "total", "amount", "sum"),
    "delivery": ("срок", "срок поставки", "поставка", "delivery", "delivery days", "delivery date"),
    "manufacturer": ("производитель", "бренд", "марка", "manufacturer", "brand"),
    "currency": ("валюта", "currency"),
}
YES = ("yes", "true", "included", "включ", "есть", "available", "in stock", "да", "подтверж")
NO = ("no", "false", "not available", "не включ", "нет", "pending", "made to order")
NAME_UNITS = ("шт", "pcs", "pc", "компл", "set", "набор", "ед")
COMPANY_FORMS = ("ооо", "оао", "зао", "пао", "ао", "гоу", "моу", "фгуп", "гуп", "гбу", "гау", "фгбоу", "гбдоу", "мадоу", "мбдоу", '"', "«", "»")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def transliterated(c: Column) -> Column:
    single = {k: v for k, v in TRANSLITERATION.items() if len(v) == 1}
    out = F.translate(F.lower(c), "".join(single) + "ъь", "".join(single.values()))
    for k, v in TRANSLITERATION.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def canonical_signal(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(transliterated(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def tokens(c: Column, least: int = 3) -> Column:
    return F.array_distinct(F.regexp_extract_all(transliterated(c), F.lit("[a-z0-9]{%d,}" % least), 0))


def locale_number(c: Column) -> Column:
    """A number with spaces, currency signs and either sign as its decimal or its thousands separator; null if there is none."""

    def number(t: Column) -> Column:
        no_commas, no_points = F.replace(t, F.lit(","), F.lit("")), F.replace(t, F.lit("."), F.lit(""))
        commas, points = F.length(t) - F.length(no_commas), F.length(t) - F.length(no_points)
        thousands = lambda sign: (F.length(F.substring_index(t, sign, -1)) == 3) & (F.length(t) > 4)
        comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
        return (
            F.when((commas > 0) & (points > 0), F.when(comma_last, F.replace(no_points, F.lit(","), F.lit("."))).otherwise(no_commas))
            .when(commas > 1, no_commas)
            .when(points > 1, no_points)
            .when((commas == 1) & thousands(","), no_commas)
            .when((points == 1) & thousands("."), no_points)
            .otherwise(F.replace(t, F.lit(","), F.lit(".")))
        )

    t = F.regexp_replace(F.replace(c, F.lit("руб."), F.lit("")), r"[^0-9,.\-]", "")
    return F.get(F.transform(F.array(t), number), 0).try_cast("double")  # bound to a variable, so t is worked out once


def first_number(c: Column) -> Column:
    """The first number of a cell, with a decimal comma or point, after spaces and currency signs are dropped."""
    t = F.replace(F.regexp_replace(F.trim(c), " | |₽|руб\\.|руб|usd|eur|[$]|€", ""), F.lit(","), F.lit("."))
    return blank_to_null(F.regexp_extract(t, r"-?[0-9]+(\.[0-9]+)?", 0)).try_cast("double")


def amount(c: Column) -> Column:
    """All digits, signs and points of a cell as one decimal; null if that is no number."""
    t = F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"[^0-9.\-]", "")
    return t.try_cast("decimal(20,4)")


def digits(c: Column, most: int) -> Column:
    return F.regexp_extract(F.lower(F.trim(c)), "([0-9]{1,%d})" % most, 1).try_cast("int")


def currency(c: Column) -> Column:
    u = F.upper(c)
    return F.when(u.contains("RUB") | u.contains("РУБ") | c.contains("₽"), "RUB").when(u.contains("USD") | c.contains("$"), "USD").when(u.contains("EUR") | c.contains("€"), "EUR")


def yes_no(c: Column) -> Column:
    """True or false by the first hint found; hints for yes go first, as the rules have it."""
    t = F.lower(F.trim(c))
    some = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(t, h))
    return F.when(some(YES), True).when(some(NO), False)


def vat_rate(c: Column) -> Column:
    t = F.lower(F.trim(c))
    rate = F.replace(F.regexp_extract(t, r"([0-9]{1,2}([.,][0-9]+)?)\s*%", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(rate, F.when(t.contains("без ндс") | t.contains("without vat"), 0.0))


def email(c: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(c, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0)))


def domain(url: Column) -> Column:
    """Host of a url or bare address in lower case, without the prefix www."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)", 1))
    return blank_to_null(F.regexp_replace(host, r"^www\.", ""))


def header(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-zа-яё0-9%]+", " "))


def header_name(h: Column) -> Column:
    """The column that a header names: by equality with a synonym, or by holding one of three letters or more."""
    plain = lambda s: " ".join("".join(x if x.isalnum() and x != "№" else " " for x in s.lower()).split())
    known = [(s, name) for name, synonyms in HEADERS.items() for s in filter(None, map(plain, synonyms))]

    def named(x: Column) -> Column:
        out = F.when(x == "", None)
        for s, name in known:
            out = out.when(F.contains(x, F.lit(s)) if len(s) >= 3 else x == s, name)
        return out

    return F.get(F.transform(F.array(h), named), 0)  # bound to a variable, so h is worked out once


def phone(c: Column) -> Column:
    """+7 and ten digits in groups for numbers of this country; others as they are."""
    raw, d = F.trim(c), F.regexp_replace(c, "[^0-9]+", "")
    ten = F.when((F.length(d) == 11) & d.rlike("^[78]"), F.substring(d, 2, 10)).when(F.length(d) == 10, d)
    return F.coalesce(F.regexp_replace(ten, "^(...)(...)(..)(..)$", "+7 $1 $2-$3-$4"), blank_to_null(raw))


def company(c: Column) -> Column:
    """A customer's name in lower case without legal forms and quotes, in the order of the list."""
    out = squeezed(F.lower(c))
    for form in COMPANY_FORMS:
        out = F.trim(F.replace(out, F.lit(form), F.lit("")))
    return squeezed(out)


def stem_match(a: Column, b: Column) -> Column:
    """Equal words, or words of four letters or more that share all but two letters of the shorter from the start."""
    least = F.least(F.length(a), F.length(b))
    common = lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)
    return (a == b) | ((least >= 4) & common(least - 2))


def iso_date(c: Column) -> Column:
    """dd.mm.yyyy, the time and the zone of an ISO date; texts that do not begin with one stay as they are."""
    at = lambda k: F.regexp_extract(c, r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?))?([+-][0-9]{2}:?[0-9]{2})?", k)
    return F.when(at(1) != "", F.concat_ws(" ", F.concat_ws(".", at(3), at(2), at(1)), blank_to_null(at(4)), blank_to_null(at(5)))).otherwise(c)
