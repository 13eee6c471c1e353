"""Attributes of goods: names of marks found in texts, and requested values against offered ones by the rules of a profile."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aliases that fit into the memory of every worker many times over; more are an error, not a slow join.
MOST_ALIASES = 1_000_000

# Statuses of a comparison, from the worst.
STATUSES = ("NO_MATCH", "UNCERTAIN", "PARTIAL", "LIKELY_ANALOG", "EXACT")


def compact(c: Column) -> Column:
    """Letters and digits only, in lower case, ё as е."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), r"[^\p{L}\p{N}]+", "")


def resolved_marks(texts: DataFrame, id_: str, text: str, aliases: DataFrame) -> DataFrame:
    """(id, status, mark, alias_length) of each text: the owner of the longest alias (alias, mark) that stands in its compact form.

    status: resolved, ambiguous (longest aliases of different marks; mark is null) or none. All aliases are looked for in one pass over a text, by an
    automaton that a task makes once, so the time does not grow with their number; that number is bounded and checked. Equal aliases
    may have several marks. Null and empty texts and aliases match nothing.
    """
    listed = aliases.select(compact(F.col("alias")).alias("alias"), F.col("mark").cast("string").alias("mark")).filter("alias <> '' and mark is not null").distinct()
    count = listed.count()
    if count > MOST_ALIASES:
        raise ValueError(f"{count} aliases; at most {MOST_ALIASES} are sent to the tasks")
    owners: dict[str, list[str]] = {}
    for r in listed.collect():
        owners.setdefault(r.alias, []).append(r.mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for alias, marks in owners.items():
            found.add_word(alias, (len(alias), marks))
        found.make_automaton()
        for b in batches:
            status, mark, size = [], [], []
            for t in b.column(1).to_pylist():
                longest, who = 0, set()
                for _, (n, marks) in found.iter(t or "") if owners else ():
                    if n > longest:
                        longest, who = n, set()
                    if n == longest:
                        who.update(marks)
                status.append("none" if not who else "resolved" if len(who) == 1 else "ambiguous")
                mark.append(next(iter(who)) if len(who) == 1 else None)
                size.append(longest)
            yield pa.record_batch([b.column(0), pa.array(status, pa.string()), pa.array(mark, pa.string()), pa.array(size, pa.int64())], [id_, "status", "mark", "alias_length"])

    rows = texts.select(id_, compact(F.col(text)).alias("text"))
    return rows.mapInArrow(run, f"{id_} {dict(rows.dtypes)[id_]}, status string, mark string, alias_length long")


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), r"\s+", " "))


def compare(comparator: str, requested: Column, offered: Column) -> Column:
    """Whether an offered value does for a requested one: equal texts (or arrays in any order), at least, at most, all of a set, or ranges that meet."""
    if comparator == "exact":
        return normal(requested.cast("string")) == normal(offered.cast("string"))
    if comparator == "minimum":
        return offered.cast("double") >= requested.cast("double")
    if comparator == "maximum":
        return offered.cast("double") <= requested.cast("double")
    if comparator == "contains":
        return F.size(F.array_except(F.transform(requested, normal), F.transform(offered, normal))) == 0
    if comparator == "range_overlap":
        low, high = (lambda r: F.get(r, 0).cast("double")), (lambda r: F.get(r, 1).cast("double"))
        return F.greatest(low(requested), low(offered)) <= F.least(high(requested), high(offered))
    raise ValueError(f"no comparator {comparator}")


def evaluated(rows: DataFrame, rules: list[tuple[str, str, bool, bool]], evidence: Column) -> DataFrame:
    """`rows` with status, and the attributes in which it is missing or does not do. rules: (attribute, comparator, critical, required); the values are
    in columns requested_<attribute> and offered_<attribute>, null where there is none. An attribute that is not requested does not count.

    A critical attribute that does not do is no match, one that is missing leaves it uncertain, as does missing evidence; then required
    ones make it partial and others an analog.
    """
    wrong: dict[str, list[Column]] = {"missing": [], "mismatch": []}
    bad: dict[tuple[str, str], list[Column]] = {}
    for name, comparator, critical, required in rules:
        want, have = F.col(f"requested_{name}"), F.col(f"offered_{name}")
        kind = "critical" if critical else "required" if required else "optional"
        lacks = want.isNotNull() & have.isNull()
        differs = want.isNotNull() & have.isNotNull() & ~F.coalesce(compare(comparator, want, have), F.lit(False))
        for what, test in (("missing", lacks), ("mismatch", differs)):
            wrong[what].append(F.when(test, name))
            bad.setdefault((kind, what), []).append(test)

    def some(kind: str, *what: str) -> Column:
        out = F.lit(False)
        for w in what:
            for test in bad.get((kind, w), []):
                out = out | test
        return out

    status = F.when(some("critical", "mismatch"), "NO_MATCH").when(some("critical", "missing") | ~F.coalesce(evidence, F.lit(False)), "UNCERTAIN").when(some("required", "missing", "mismatch"), "PARTIAL").when(some("optional", "missing", "mismatch"), "LIKELY_ANALOG").otherwise("EXACT")
    listed = {k: F.array_compact(F.array(*v)).alias(k) for k, v in wrong.items()}
    return rows.select("*", status.alias("status"), *listed.values())
