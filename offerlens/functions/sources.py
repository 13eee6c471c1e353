"""Names of items in different documents of a case: their words, whether two may be one thing, and how well they fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say too little, and word beginnings that two names of one thing cannot have apart.
GENERIC = ("набор", "модуль", "электрод", "контроллер", "питания", "система", "изделие", "товар")
BODY_PARTS = ("грудной", "большеберц", "плечев", "лучев", "локтев", "лопаточ", "лучезапяст", "таз", "кист")
OTHER_CONTRARIES = (("ржан", "недлительн"), ("образец", "электрод"))
UNITS = {"усл ед": "условная единица", "услед": "условная единица", "условная единица": "условная единица", "рул": "рулон", "шт": "штука"}


def words(name: Column) -> Column:
    """Different words of four letters or digits or more, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-zа-я0-9]+"), lambda w: F.length(w) >= 4))


def _begins(tokens: Column, stem: str) -> Column:
    return F.exists(tokens, lambda w: w.startswith(stem))


def stems(tokens: Column) -> Column:
    """Those of the stems above that a word begins with: all that a name's words say about contraries."""
    every = (*BODY_PARTS, *(p for pair in OTHER_CONTRARIES for p in pair))
    return F.array_compact(F.array(*(F.when(_begins(tokens, p), F.lit(p)) for p in every)))


def contrary(x: Column, y: Column) -> Column:
    """Stems of two names: two different body parts, one on each side, or another contrary pair."""
    parts = lambda s: F.array_intersect(s, F.array(*map(F.lit, BODY_PARTS)))
    pairs = [(F.array_contains(x, p) & F.array_contains(y, q)) | (F.array_contains(x, q) & F.array_contains(y, p)) for p, q in OTHER_CONTRARIES]
    differ = (F.size(parts(x)) > 0) & (F.size(parts(y)) > 0) & (F.size(F.array_union(parts(x), parts(y))) > 1)
    return (F.size(x) > 0) & (F.size(y) > 0) & reduce(lambda p, q: p | q, pairs, differ)


def agree(common: Column, x: Column, y: Column) -> Column:
    """Two names with these words in common and these stems: two words, or one that is not generic, and nothing contrary."""
    return ((F.size(common) >= 2) | ((F.size(common) == 1) & ~F.get(common, F.lit(0)).isin(*GENERIC))) & ~contrary(x, y)


def compatible(a: Column, b: Column) -> Column:
    """Words a and b of two names: two in common, or one that is not generic, and nothing contrary."""
    return agree(F.array_intersect(a, b), stems(a), stems(b))


def match_score(overlap: Column, name: Column, other: Column, quantity: Column, other_quantity: Column, unit: Column, other_unit: Column) -> Column:
    same = lambda x, y: F.coalesce(F.lower(F.trim(x)) == F.lower(F.trim(y)), F.lit(False))
    amount = F.coalesce((quantity == other_quantity) & (quantity != 0), F.lit(False))
    measure = F.coalesce((F.lower(unit) == F.lower(other_unit)) & (unit != ""), F.lit(False))
    return (overlap * 10 + F.when(same(name, other), 100).otherwise(0) + F.when(amount, 3).otherwise(0) + F.when(measure, 2).otherwise(0)).cast("long")


def unit_name(unit: Column) -> Column:
    bare = F.replace(F.lower(F.trim(unit)), F.lit("."), F.lit(""))
    known = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, bare), F.lower(F.trim(unit)))
