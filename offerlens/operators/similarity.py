"""Joins by name similarity: all pairs of texts at or above a ratio, and the best match of each text, without comparing all."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..tables import kept

#: Counts of tokens are kept by a hash of the token; any order of tokens gives right results, rare ones first give few candidates.
BUCKETS = 1 << 16
#: Remainders of a text that are listed at most for partners of one length.
REMAINDERS = 256
#: Characters left out in one half of two near texts at most, ways to leave them out that are listed for a text, and its characters.
HALF, WAYS, LONGEST = 2, 1024, 256


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, in lower case; null if either is null."""
    return pd.Series([None if x is None or y is None else ratio(x.lower(), y.lower()) for x, y in zip(a, b, strict=True)], dtype="float64")


def tagged(items: list[str]) -> list[str]:
    """Items with how often they came before, so that a multiset becomes a set."""
    seen: Counter[str] = Counter()
    out = []
    for x in items:
        seen[x] += 1
        out.append(f"{x}\x00{seen[x]}")
    return out


def shared_pairs(total: float, least: float) -> int:
    """Adjacent pairs of characters that two texts of `total` characters share at least, if their ratio is `least` or more.

    They match M >= least * total / 2 characters, in blocks. Each border between blocks needs an unmatched character, of
    which there are total - 2 M, so there are at most total - 2 M + 1 blocks, and each loses one pair.
    """
    return math.ceil(1.5 * least * total - total - 1 - 1e-9)


def signature(text: str, least: float, rare: list[int], short: bool) -> list[str]:
    """The rarest tokens of a text, as many as it takes for any partner to share one of them."""
    n = len(text)
    partner = least * n / (2 - least)
    items = tagged(list(text)) if short else tagged([text[i : i + 2] for i in range(n - 1)])
    need = math.ceil(least * (n + partner) / 2 - 1e-9) if short else shared_pairs(n + partner, least)
    items.sort(key=lambda x: (rare[bucket(x)], x))
    return items[: len(items) - max(1, need) + 1]


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def is_short(n: int, least: float) -> bool:
    """Too short for partners to be sure to share a pair of characters."""
    return shared_pairs(n + least * n / (2 - least), least) < 1


def shared_letters(n: int, m: int, least: float) -> int:
    """Characters, in order, that texts of n and m characters have in common at least, if their ratio is `least` or more."""
    return math.ceil(least * (n + m) / 2 - 1e-9)


def is_near(n: int, m: int, least: float) -> bool:
    """Whether so few characters are left out of either text that all its remainders can be listed."""
    k = shared_letters(n, m, least)
    return k <= min(n, m) and max(math.comb(n, k), math.comb(m, k)) <= REMAINDERS


def remainders(text: str, k: int) -> set[str]:
    """What is left of a text with all but k characters left out, in every way."""
    return {"".join(c) for c in combinations(text, k)}


def _texts(df: DataFrame, key: Column, text: Column) -> DataFrame:
    rows = df.select(key.cast("string").alias("block"), text.alias("text")).filter("text <> ''").distinct()
    return rows.withColumn("id", F.md5("text"))


def _lengths(texts: DataFrame) -> list[int]:
    """The different lengths of texts."""
    return [r.n for r in texts.select(F.length("text").alias("n")).distinct().collect()]


def _signed(texts: DataFrame, least: float, rare: list[int], partners: list[int]) -> DataFrame:
    """Signatures of texts for partners of these lengths: remainders where both texts lose few characters, else their rarest tokens."""
    longest = max((n for n in range(1, 4096) if is_short(n, least)), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[int, tuple[set[int], bool]] = {}
        for b in batches:
            for block, text, name in zip(*(b.column(c).to_pylist() for c in ("block", "text", "id")), strict=True):
                n = len(text)
                if n not in ways:
                    able = [m for m in partners if 2 * min(n, m) >= least * (n + m) - 1e-9]
                    near = {m for m in able if is_near(n, m, least)}
                    ways[n] = ({shared_letters(n, m, least) for m in near}, len(near) < len(able))
                sizes, far = ways[n]
                found = [f"0{x}" for k in sizes for x in remainders(text, k)]
                if far and not is_short(len(text), least):
                    found += [f"2{t}" for t in signature(text, least, rare, short=False)]
                if far and len(text) * least <= longest * (2 - least):  # may meet a short one
                    found += [f"1{t}" for t in signature(text, least, rare, short=True)]
                n = len(found)
                yield pa.record_batch([pa.array([block] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array([len(text)] * n, pa.int32()), pa.array(found, pa.string())], ["block", "id", "size", "token"])

    return texts.mapInArrow(run, "block string, id string, size int, token string")


def _rarity(texts: DataFrame) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[int] = Counter()
            for text in b.column("text").to_pylist():
                counts.update(map(bucket, tagged(list(text)) + tagged([text[i : i + 2] for i in range(len(text) - 1)])))
            yield pa.record_batch([pa.array(counts.keys(), pa.int32()), pa.array(counts.values(), pa.int64())], ["bucket", "n"])

    rare = [0] * BUCKETS
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        rare[r.bucket] = r.n
    return rare


def _verified(least: float | None):
    """Pairs whose ratio is `least` or more; without it, what the column `least` has for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_text, b_text = b.column("a_text").to_pylist(), b.column("b_text").to_pylist()
            known, keep, ratios = {}, [], []
            floors = b.column("least").to_pylist() if least is None else [least] * b.num_rows
            for i, (x, y, floor) in enumerate(zip(a_text, b_text, floors, strict=True)):
                if y not in known:
                    known = {y: (SequenceMatcher(None, "", y), Counter(y))}  # candidates come by the second text, mostly
                match, letters = known[y]
                if 2 * (Counter(x) & letters).total() < floor * (len(x) + len(y)) - 1e-9:
                    continue
                match.set_seq1(x)
                r = match.ratio()
                if r >= floor:
                    keep.append(i)
                    ratios.append(r)
            some = b.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([some.column("block"), some.column("a_text"), some.column("b_text"), pa.array(ratios, pa.float64())], ["block", "a_text", "b_text", "ratio"])

    return run


def candidates(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(block, a_id, b_id): pairs of texts (block, text, id) in one block that share a token of their signatures and whose lengths allow the ratio.

    Texts of which the ratio leaves few characters unmatched have a remainder in common, which few others have, however alike all names are (names
    that differ by a number); they are listed for lengths that occur on the other side.
    """
    rare = _rarity(a.unionByName(b).distinct())
    x = _signed(a, least, rare, _lengths(b)).withColumnsRenamed({"id": "a_id", "size": "a_size"})
    y = _signed(b, least, rare, _lengths(a)).withColumnsRenamed({"id": "b_id", "size": "b_size"})
    met = x.join(y, ["block", "token"]).filter(2 * F.least("a_size", "b_size") >= least * (F.col("a_size") + F.col("b_size")) - 1e-9)
    return met.select("block", "a_id", "b_id").distinct()


def similar(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(block, a_text, b_text, ratio) of all pairs of texts (block, text, id) in one block with a ratio of `least` or more; see `similar_pairs`."""
    met = candidates(a, b, least)
    texts = met.join(a.select("block", F.col("id").alias("a_id"), F.col("text").alias("a_text")), ["block", "a_id"]).join(b.select("block", F.col("id").alias("b_id"), F.col("text").alias("b_text")), ["block", "b_id"])
    return texts.select("block", "a_text", "b_text").mapInArrow(_verified(least), "block string, a_text string, b_text string, ratio double")


def similar_pairs(left: DataFrame, right: DataFrame, left_text: Column, right_text: Column, least: float, left_block: Column | None = None, right_block: Column | None = None) -> DataFrame:
    """(block, a_text, b_text, ratio) of all different pairs of texts whose ratio is `least` or more; with blocks, only
    pairs within one.

    Texts count once, however many rows have them. Tokens are pairs of neighbouring characters, or single characters where
    texts are short. Any two texts of that ratio share a number of them that their lengths give, so they share one of the
    rarest few of each; the join runs on these (within the block), and what meets is compared exactly. Only token counts by hash
    (65,536 at most) pass through the driver. Null and empty texts and null blocks match nothing.
    """
    one = F.lit("")
    a = kept(_texts(left, one if left_block is None else left_block, left_text), "names")
    b = kept(_texts(right, one if right_block is None else right_block, right_text), "names")
    return similar(a, b, least)


def _without_a_word(text: Column) -> Column:
    words = F.split(text, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.concat_ws(" ", F.slice(words, 1, i - 1), F.slice(words, i + 1, F.size(words))))


def guessed(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(text, least): the best ratio, `least` or more, of a text to those that have one word more or less, for texts that have such partners.

    It bounds from below what the text's best partner has. Of the partners with one word more that are alike without it, one is tried.
    """
    x, y = (d.select("text").filter(F.length("text") <= LONGEST) for d in (a, b))
    cut = lambda d: d.select("text", F.explode(F.array_distinct(_without_a_word(F.col("text")))).alias("key")).filter("key <> ''")
    more = cut(x).join(y.select(F.col("text").alias("b_text")), F.col("key") == F.col("b_text"))
    fewer = cut(y).groupBy("key").agg(F.min("text").alias("b_text")).join(x, F.col("key") == F.col("text"))
    pairs = more.select("text", "b_text").unionByName(fewer.select("text", "b_text"))
    tried = pairs.select(F.lit("").alias("block"), F.col("text").alias("a_text"), "b_text").mapInArrow(_verified(least), "block string, a_text string, b_text string, ratio double")
    return tried.groupBy(F.col("a_text").alias("text")).agg(F.max("ratio").alias("least"))


def left_out(n: int, m: int, least: float) -> int:
    """Characters that texts of n and m characters leave unmatched at most, if their ratio is `least` or more; -1 if it can't be."""
    k = shared_letters(n, m, least)
    return n + m - 2 * k if k <= min(n, m) else -1


def _needs(n: int, least: float, partners: list[int]) -> list[dict[int, int]]:
    """By length of a partner's first half, and of its second one: how many characters are left out there at most."""
    needs: list[dict[int, int]] = [{}, {}]
    for m in partners:
        u = left_out(n, m, least)
        if u >= 0:
            for need, h in zip(needs, (m // 2, m - m // 2), strict=True):
                need[h] = max(need.get(h, 0), u // 2)
    return needs


def _ways(needs: list[dict[int, int]]) -> int:
    """How many beginnings and ends `_left_halves` lists at most."""
    cuts = [(h, i, j) for need in needs for h, e in need.items() for i in range(e + 1) for j in range(e + 1 - i)]
    return sum(math.comb(max(0, h + i - j - 1), i) for h, i, j in cuts)


def _left_halves(text: str, needs: list[dict[int, int]]) -> set[str]:
    """What beginnings and ends of a text, each as half of a partner, may have in common with it: all but i characters, where the partner's
    half lacks all but j of its own. The outermost character is kept: one that is left out there counts to the other half."""
    found = set()
    for side, (s, need) in enumerate(zip((text, text[::-1]), needs, strict=True)):
        for h, e in need.items():
            for i in range(e + 1):
                for j in range(min(e - i, h) + 1):
                    p = h + i - j
                    if p <= len(s) and (h > j or not i):
                        found |= {f"{side}{h} {x}{s[p - 1 : p]}" for x in remainders(s[: max(0, p - 1)], h - j - 1)} if h > j else {f"{side}{h} "}
    return found


def _right_halves(text: str, e: int) -> set[str]:
    """Both halves of a text without up to e characters each."""
    h = len(text) // 2
    halves = ((0, text[:h]), (1, text[::-1][: len(text) - h]))
    return {f"{side}{len(s)} {x}" for side, s in halves for j in range(min(e, len(s)) + 1) for x in remainders(s, len(s) - j)}


def _near(guesses: DataFrame, partners: list[int]) -> DataFrame:
    """The rows of (text, least) whose halves can be listed for partners of these lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able: dict[tuple[int, float], bool] = {}
        for b in batches:
            keep = []
            for text, least in zip(*(b.column(c).to_pylist() for c in ("text", "least")), strict=True):
                key = (len(text), least)
                if key not in able:
                    needs = _needs(*key, partners)
                    able[key] = all(e <= HALF for need in needs for e in need.values()) and _ways(needs) <= WAYS
                keep.append(able[key])
            yield b.filter(pa.array(keep, pa.bool_()))

    return guesses.mapInArrow(run, guesses.schema)


def near_candidates(near: DataFrame, b: DataFrame, partners: list[int]) -> DataFrame:
    """(a_text, least, b_text): the pairs of texts (text, least) and (text) that may have the ratio `least`, for those that `_near` keeps;
    a pair may come more than once.

    A pair leaves u characters unmatched at most. Cut the right text in halves: either its first half and a beginning of the left one, or
    its second half and an end of it, leave u / 2 of them out at most. What is left of these is listed and joined; the edit distance,
    which is no more than u, tells of the pairs that meet which remain.
    """
    lowest = {r.n: r.least for r in near.groupBy(F.length("text").alias("n")).agg(F.min("least").alias("least")).collect()}
    most = {m: max((left_out(n, m, least) for n, least in lowest.items()), default=-1) // 2 for m in partners}

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, float], list[dict[int, int]]] = {}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = b.slice(i, 256)
                texts, floors, tokens, at = rows.column("text").to_pylist(), rows.column("least").to_pylist(), [], []
                for k, key in enumerate(zip(map(len, texts), floors, strict=True)):
                    if key not in known:
                        known[key] = _needs(*key, partners)
                    found = _left_halves(texts[k], known[key])
                    tokens += found
                    at += [k] * len(found)
                again = rows.take(pa.array(at, pa.int32()))
                yield pa.record_batch([pa.array(tokens, pa.string()), again.column("text"), again.column("least")], ["token", "a_text", "least"])

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("text").to_pylist():
                found = _right_halves(text, most[len(text)]) if most.get(len(text), -1) >= 0 else set()
                yield pa.record_batch([pa.array(found, pa.string()), pa.array([text] * len(found), pa.string())], ["token", "b_text"])

    # few bytes list many halves: texts are dealt to tasks by their number
    dealt = near.select("text", "least").repartition(max(near.sparkSession.sparkContext.defaultParallelism, near.count() // 10_000))
    x = dealt.mapInArrow(left, "token string, a_text string, least double")
    y = b.select("text").mapInArrow(right, "token string, b_text string")
    size = "(length(a_text) + length(b_text))"
    unmatched = f"cast({size} - 2 * ceil(least * {size} / 2 - 1e-9) as int)"
    return x.join(y, "token").filter(f"{unmatched} >= 0 and levenshtein(a_text, b_text, {unmatched}) >= 0").select("a_text", "least", "b_text")


def best_matches(left: DataFrame, right: DataFrame, left_text: Column, right_text: Column, right_order: Column, least: float = 0.7, stages: tuple[float, ...] = (0.9, 0.8)) -> DataFrame:
    """(text, best_text, best_order, score) of each different text of the left that has a right one with a ratio of `least` or more:
    the highest ratio, among equals the lowest order.

    Equal texts meet by an equi-join. A text that is one of the right with a word more or less has its best partner at that one's ratio or
    above; where this leaves few characters unmatched, all partners there are found by halves (`near_candidates`). The rest looks for
    partners at falling thresholds: a text that has one at or above a threshold has its best one there, so only texts without one go on
    to the next, where more has to be compared. Order values are unique on the right; null and empty texts have no match.
    """
    a = kept(_texts(left, F.lit(""), left_text), "names")
    lines = kept(right.select(right_text.alias("text"), right_order.alias("at")).filter("text <> ''").groupBy("text").agg(F.min("at").alias("at")), "names")
    b = _texts(lines, F.lit(""), F.col("text"))
    found = kept(a.join(lines, "text").select("text", F.col("text").alias("best_text"), F.col("at").alias("best_order"), F.lit(1.0).alias("score")), "best")

    def with_best(pairs: DataFrame) -> DataFrame:
        top = F.min(F.struct((-F.col("ratio")).alias("minus"), "at", "b_text")).alias("top")
        best = pairs.join(lines.withColumnRenamed("text", "b_text"), "b_text").groupBy("a_text").agg(top)
        return kept(found.unionByName(best.select(F.col("a_text").alias("text"), F.col("top.b_text").alias("best_text"), F.col("top.at").alias("best_order"), (-F.col("top.minus")).alias("score"))), "best")

    partners = _lengths(b)
    near = kept(_near(guessed(a.join(found.select("text"), "text", "left_anti"), b, least), partners), "near")
    met = near_candidates(near, b, partners).select(F.lit("").alias("block"), "a_text", "b_text", "least")
    found = with_best(met.mapInArrow(_verified(None), "block string, a_text string, b_text string, ratio double"))
    for t in (*(s for s in stages if s > least), least):
        rest = kept(a.join(found.select("text"), "text", "left_anti"), "names")
        if rest.isEmpty():
            break
        found = with_best(similar(rest, b, t))
    return found
