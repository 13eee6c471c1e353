"""Line dedup by a log-template tree: fixed depth, by token count and leading tokens. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept
from .text import words

#: Stands for a variable field.
ANY = "<*>"


def fields(tokens: Column) -> Column:
    """The tokens, with a variable field for each that has a digit."""
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(ANY)).otherwise(t))


def keyed_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, heavy: int = 500) -> DataFrame:
    """rows joined with `table`, which has a row for each key with the number `weight` of rows that have it.

    Keys that hold more than one in `heavy` of the `total` rows are sent to every task, so their rows stay where they are; there
    are fewer than `heavy` of them. The others meet in a merge join, where none is large.
    """
    least = total // heavy
    hot = F.broadcast(table.filter(F.col(weight) > least).drop(weight))
    rest = table.filter(F.col(weight) <= least).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest.hint("merge"), on))


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3) -> DataFrame:
    """(doc_id, content, i, leaf, line): a row for each line with a word. A line's leaf of the tree is its number of tokens with
    its first `depth` tokens, variable fields among them, as a hash; the rest is parsed when the leaf is known to hold enough
    lines. `content` tells texts apart."""
    line = F.posexplode(F.split(F.col("text"), "\n"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text")).select("doc_id", "content", line.alias("i", "line"))
    rows = rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "content", "i", "line", words(F.col("line")).alias("tokens"))
    leaf = F.concat_ws(" ", F.size("tokens").cast("string"), fields(F.slice("tokens", 1, depth)))
    return rows.select("doc_id", "content", "i", F.xxhash64(leaf).alias("leaf"), "line")


def _names(prefix: str, text: Column) -> list[Column]:
    """128 bits of hashes that stand for a text in joins."""
    return [F.xxhash64(text).alias(f"{prefix}1"), F.xxhash64(F.lit(prefix), text).alias(f"{prefix}2")]


def recurring(lines: DataFrame, min_docs: int = 10, fixed: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Candidate lines with their templates, and the templates that recur: (t1, t2, n_texts, first_doc, n_rows).

    Leaves with fewer than min_docs lines can hold no recurring template and go first. In a leaf, a token stays fixed at its
    place if min_docs lines have it there, and becomes a variable field else. Fields with digits vary anyway; of the other
    tokens at least one, and the share `fixed` of them, must stay, so that prose that merely begins alike is no template. One
    recurs if min_docs different texts have it, so copies of one text count once. Lines and templates meet by 128 bits of
    hashes of their texts; text is shuffled once, to its leaf, and once for each distinct shape of a line.
    """
    counts = kept(lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs), "line-leaves")
    total = counts.agg(F.sum("n")).first()[0] or 0
    some = keyed_join(lines, counts, ["leaf"], "n", total)
    some = some.withColumn("line", F.concat_ws(" ", fields(words(F.col("line")))))
    some = kept(some.select("doc_id", "content", "i", "leaf", *_names("s", F.col("line")), "line"), "line-candidates")
    alike = some.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    alike = kept(alike.withColumn("tokens", F.split("line", " ")).drop("line"), "line-shapes")
    token = F.posexplode("tokens").alias("p", "t")
    at = alike.select("leaf", "n", token).filter(F.col("t") != ANY).groupBy("leaf", "p", "t").agg(F.sum("n").alias("n"))
    stays = at.filter(F.col("n") >= min_docs).select("leaf", "p", "t")
    placed = alike.select("leaf", "s1", "s2", token).join(stays, ["leaf", "p", "t"])
    keep = placed.groupBy("leaf", "s1", "s2").agg(F.collect_set("p").alias("keep")).join(alike, ["leaf", "s1", "s2"])
    own = F.size(F.filter("tokens", lambda t: t != ANY))
    template = F.transform("tokens", lambda t, p: F.when(F.array_contains("keep", p), t).otherwise(F.lit(ANY)))
    named = keep.filter(F.size("keep") >= own * fixed).select("s1", "s2", "n", *_names("t", F.concat_ws(" ", template)))
    named = kept(named.groupBy("s1", "s2").agg(F.sum("n").alias("n"), F.first("t1").alias("t1"), F.first("t2").alias("t2")), "line-templates")
    rows = kept(keyed_join(some.select("doc_id", "content", "i", "s1", "s2"), named, ["s1", "s2"], "n", total).drop("s1", "s2"), "line-rows")
    texts = rows.groupBy("t1", "t2", "content").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    found = texts.groupBy("t1", "t2").agg(F.count("*").alias("n_texts"), F.min("doc_id").alias("first_doc"), F.sum("n").alias("n_rows")).filter(F.col("n_texts") >= min_docs)
    return rows, kept(found, "line-recurring")


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_docs: int = 10, fixed: float = 0.6) -> DataFrame:
    """(doc_id, content, drop): the places of the lines to drop, for the texts that have such. The first document (smallest id)
    of a recurring template keeps its lines, so that a passage that was copied is not lost altogether."""
    rows, found = recurring(parsed(docs, id_col, text_col, depth), min_docs, fixed)
    total = found.agg(F.sum("n_rows")).first()[0] or 0
    out = keyed_join(rows, found, ["t1", "t2"], "n_rows", total).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return out.groupBy("doc_id", "content").agg(F.collect_set("i").alias("drop"))


def without_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: bool = False, **options) -> DataFrame:
    """docs with the recurring lines taken out of their texts; with `extra`, also n_lines and n_dropped.

    Every document stays, with an empty text if all its lines recur. Null texts stay null; lines without a word stay;
    repeated rows fare alike; an empty table gives an empty result; documents with a null id are never a template's first.
    """
    gone = kept(dropped(docs, id_col, text_col, **options), "line-drops").toDF("__id", "__content", "__drop")
    # own names for the columns of docs, which may be called anything
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain, text = docs.toDF(*at.values()), F.col(at[text_col])
    same = plain[at[id_col]].eqNullSafe(gone["__id"]) & (F.xxhash64(text) == gone["__content"])
    joined = plain.join(gone.hint("merge"), same, "left")
    lines = F.split(text, "\n")
    new = F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__drop", i)), "\n"))
    n = lambda a: F.when(a.isNull(), 0).otherwise(F.size(a)).cast("long")
    more = [n(lines).alias("n_lines"), n(F.col("__drop")).alias("n_dropped")] if extra else []
    return joined.select(*((new if c == text_col else F.col(own)).alias(c) for c, own in at.items()), *more)


SQL = r"""
with lines as (select doc_id, text, i, string_split(text, chr(10))[i + 1] line from (select doc_id, text, unnest(range(len(string_split(text, chr(10))))) i from documents)),
parsed as (select doc_id, text, i, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) tokens
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
leaved as (select *, concat_ws(' ', len(tokens), array_to_string(tokens[1:3], ' ')) leaf from parsed),
common as (select * from leaved where leaf in (select leaf from leaved group by 1 having count(*) >= 10)),
shapes as (select leaf, tokens, count(*) n from common group by all),
placed as (select leaf, tokens, n, p, tokens[p] t from (select leaf, tokens, n, unnest(range(1, len(tokens) + 1)) p from shapes)),
stays as (select leaf, p, t from placed where t <> '<*>' group by all having sum(n) >= 10),
kept_tokens as (select placed.leaf, placed.tokens, placed.p, any_value(placed.t) t, bool_or(stays.t is not null) keep
  from placed left join stays on stays.leaf = placed.leaf and stays.p = placed.p and stays.t = placed.t group by all),
templates as (select leaf, tokens, string_agg(case when keep then t else '<*>' end, ' ' order by p) template from kept_tokens
  group by all having sum(keep::int) > 0 and sum(keep::int) >= count(*) filter (t <> '<*>') * 0.6),
rows as (select doc_id, text, i, template from common join templates using (leaf, tokens)),
found as (select template, min(doc_id) first_doc from rows group by 1 having count(distinct text) >= 10),
gone as (select doc_id, list(i) d from rows join found using (template) where doc_id is distinct from first_doc group by 1),
cut as (select documents.doc_id, text, string_split(text, chr(10)) l, coalesce(d, []) d from documents left join gone using (doc_id))
select doc_id, cast(coalesce(len(l), 0) as bigint) n_lines, cast(len(d) as bigint) n_dropped,
  sha256(coalesce(case when len(d) = 0 then text else array_to_string([l[i] for i in range(1, len(l) + 1) if not list_contains(d, i - 1)], chr(10)) end, '')) kept_sha256 from cut"""
