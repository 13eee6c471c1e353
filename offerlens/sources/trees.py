"""XML and HTML of notices and search pages as tables: nodes with their texts, fields by the first alias that has a text, cards."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing

NODE = "node int, tag string, path string, text string, whole string, attributes map<string,string>, scopes array<int>"


def nodes_of(source: str | None, scopes: frozenset[str] = frozenset()) -> list[tuple] | None:
    """(node, tag, path, text, whole, attributes, scopes) of each element, in document order, names without their namespace; None if the document
    is broken or declares entities. text: what stands before the first child; whole: all below; scopes: enclosing nodes with one of the tags, itself first."""
    if not source or not source.strip():
        return []
    local = lambda name: name.rsplit("}", 1)[-1]
    found: list[list] = []
    open_: list[int] = []
    texts: list[list[str]] = []
    parser = expat.ParserCreate(namespace_separator="}")

    def begin(name: str, attributes: dict[str, str]) -> None:
        tag, n = local(name), len(found)
        up = found[open_[-1]] if open_ else None
        inside = ([n] if tag in scopes else []) + (up[6] if up else [])
        if up is not None and up[3] is None:
            up[3] = "".join(texts[open_[-1]])
        found.append([n, tag, f"{up[2] if up else ''}/{tag}", None, None, {local(k): v for k, v in attributes.items()}, inside])
        texts.append([])
        open_.append(n)

    def end(_: str) -> None:
        n = open_.pop()
        all_ = "".join(texts[n])
        if found[n][3] is None:
            found[n][3] = all_
        found[n][4] = all_
        if open_:
            texts[open_[-1]].append(all_)
        texts[n] = []

    def data(text: str) -> None:
        if open_:
            texts[open_[-1]].append(text)

    def refuse(*_: object) -> None:
        raise ValueError("entities are not read")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = begin, end, data, refuse
    try:
        parser.Parse(source.encode(), True)
    except (expat.ExpatError, ValueError):
        return None
    return [tuple(x) for x in found]


def nodes(docs: DataFrame, id_: str, xml: str, scopes: Sequence[str] = ()) -> DataFrame:
    """(id, ok, node, tag, path, text, whole, attributes, scopes): the elements of each document; see `nodes_of`. A broken document has one row, with
    ok false and nothing else; null and blank ones have none."""
    wanted = frozenset(scopes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, source in enumerate(b.column(1).to_pylist()):
                found = nodes_of(source, wanted)
                rows = [(None,) * 7] if found is None else found
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int32())]
                arrays = [pa.array([None if x is None else list(x.items()) for x in c] if k == 5 else c, t) for k, (c, t) in enumerate(zip(cols, types, strict=True))]
                ids = b.column(0).take(pa.array([i] * len(rows), pa.int64()))
                yield pa.record_batch([ids, pa.array([found is not None] * len(rows), pa.bool_()), *arrays], [id_, "ok", "node", "tag", "path", "text", "whole", "attributes", "scopes"])

    rows = docs.select(id_, xml)
    return rows.mapInArrow(run, f"{id_} {dict(rows.dtypes)[id_]}, ok boolean, {NODE}")


def mapped(docs: DataFrame, id_: str, xml: str, make: Callable[[list[tuple]], Iterable[tuple]], columns: Sequence[str], scopes: Sequence[str] = ()) -> DataFrame:
    """(id, columns...): the rows of texts that `make` gives for the elements of each document (see `nodes_of`). They are picked where the document is
    read, so its nodes need not be grouped again. Broken, null and blank documents have no rows."""
    wanted = frozenset(scopes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 512):
                part = b.slice(low, 512)
                got = [(i, *row) for i, source in enumerate(part.column(1).to_pylist()) for found in (nodes_of(source, wanted),) if found for row in make(found)]
                at, *texts = list(zip(*got, strict=True)) or [[]] * (1 + len(columns))
                yield pa.record_batch([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in texts)], [id_, *columns])

    rows = docs.select(id_, xml)
    return rows.mapInArrow(run, f"{id_} {dict(rows.dtypes)[id_]}, " + ", ".join(f"{c} string" for c in columns))


def picker(aliases: dict[str, Sequence[str]]) -> Callable[[Iterable[tuple]], tuple[str | None, ...]]:
    """A function from elements to the values that `first_values` finds in them, in the order of the fields."""
    ranks: dict[str, list[tuple[int, int]]] = {}
    for k, tags in enumerate(aliases.values()):
        for rank, tag in reversed(list(enumerate(tags))):
            ranks.setdefault(tag, []).append((k, rank))

    def pick(found: Iterable[tuple]) -> tuple[str | None, ...]:
        best: list[tuple[int, str | None]] = [(1 << 30, None)] * len(aliases)
        for n in found:
            for k, rank in ranks.get(n[1], ()):
                if rank < best[k][0] and (text := (n[3] or "").strip(" \t\n\x0b\f\r")):
                    best[k] = (rank, text)
        return tuple(text for _, text in best)

    return pick


def within(found: Iterable[tuple]) -> dict[int, list[tuple]]:
    """Elements by each of the scopes that enclose them."""
    out: dict[int, list[tuple]] = {}
    for n in found:
        for at in n[6]:
            out.setdefault(at, []).append(n)
    return out


def first_values(tree: DataFrame, scope: Sequence[str], aliases: dict[str, Sequence[str]]) -> DataFrame:
    """(scope..., fields): for each field the first of its aliases that has a text, at its first place in the document. As an aggregate, so the nodes
    of a document are combined where they lie."""
    picks = []
    text = parsing.blank_to_null(F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")))
    for field, tags in aliases.items():
        rank = F.coalesce(*(F.when(F.col("tag") == tag, k) for k, tag in enumerate(tags)))
        picks.append(F.min_by(text, F.when(rank.isNotNull() & text.isNotNull(), F.struct(rank.alias("rank"), "node"))).alias(field))
    return tree.groupBy(*scope).agg(*picks)


def decimal_price(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), "[  ]", "").try_cast("double")


def plain_text(c: Column) -> Column:
    """Text of a piece of HTML: spans vanish, other tags are spaces, references of the common kinds are decoded, white space is single."""
    t = F.regexp_replace(F.regexp_replace(c, "(?i)</?span[^>]*>", ""), "<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(F.replace(t, F.lit(" "), F.lit(" ")), r"\s+", " "))


def label_pairs(c: Column, title_class: str, value_class: str) -> Column:
    """Map of labels (in lower case, without colons at their ends) to values from pairs of div elements of the two classes; of equal labels the first counts."""
    div = lambda name: rf'<div[^>]*class="[^"]*\b{re.escape(name)}\b[^"]*"[^>]*>(.*?)</div>'
    pattern = F.lit(f"(?is){div(title_class)}\\s*{div(value_class)}")
    label = lambda x: F.lower(F.trim(plain_text(x), F.lit(" :")))
    both = F.zip_with(F.regexp_extract_all(c, pattern, 1), F.regexp_extract_all(c, pattern, 2), lambda a, b: F.struct(label(a).alias("k"), plain_text(b).alias("v")))
    full = F.filter(both, lambda x: (x["k"] != "") & (x["v"] != ""))
    return F.aggregate(full, F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["k"]), m).otherwise(F.map_concat(m, F.create_map(x["k"], x["v"]))))


#: Classes of cards on search pages; the first that a page has decides.
CARD_CLASSES = ("registry-entry", "notice__item", "search-results__item")


def cards(c: Column) -> Column:
    """Pieces of a search page that begin with a card, in order; none if it has no card of a known class."""
    def found(name: str) -> Column:
        begins = rf'(?i)<div[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>'
        return F.filter(F.split(c, begins.replace("(?i)", "(?i)(?=") + ")"), lambda x: x.rlike("^" + begins))

    # each class is looked for once, and only where those before it are not found
    some = (F.get(F.filter(F.array(found(name)), lambda x: F.size(x) > 0), 0) for name in CARD_CLASSES)
    return F.coalesce(*some, F.array().cast("array<string>"))


def public_time(c: Column) -> Column:
    """Times as public pages print them: day first with or without hours, or an ISO day; a mark of the zone is dropped; null for others."""
    t = F.trim(F.regexp_replace(F.replace(plain_text(c), F.lit("(МСК)"), F.lit("")), r"\s+", " "))
    forms = {r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}$": "d.M.yyyy H:m", r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}:\d{1,2}$": "d.M.yyyy H:m:s", r"^\d{1,2}\.\d{1,2}\.\d{4}$": "d.M.yyyy", r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d"}
    parsed = lambda x: F.coalesce(*(F.when(x.rlike(p), F.try_to_timestamp(x, F.lit(f))) for p, f in forms.items()))
    return F.get(F.transform(F.array(t), parsed), 0)  # bound to a variable, so the text is made once
