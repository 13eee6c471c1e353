"""Substring dedup: repeated windows of words, from a compressed FM-index for each shard of the text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .lines import keyed_join
from .storage import kept
from .text import slices

BASE = np.uint64(0x9E3779B97F4A7C15)


class Bits:
    """A packed row of bits with a count of ones before each 64 of them."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def at(self, places: np.ndarray) -> np.ndarray:
        return ((self.words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def rank(self, to: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = to >> 6
        mask = (np.uint64(1) << (to & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """A sequence of symbols below 2^levels, top bit first, one bit a symbol and level. A level's nodes lie by their bits read
    backwards (a wavelet matrix), so that one count of ones leads from a place to its place on the next level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = max(1, levels)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.levels))])
        self.bits, self.zeros = [], []
        for level in range(self.levels):
            bit = (symbols >> (self.levels - 1 - level)) & 1
            self.bits.append(Bits(bit))
            up = bit == 1
            self.zeros.append(len(symbols) - int(up.sum()))
            symbols = np.concatenate([symbols[~up], symbols[up]])
        new = np.nonzero(np.concatenate([[True], np.diff(symbols) != 0]))[0] if len(symbols) else np.zeros(0, np.int64)
        self.start = np.zeros(1 << self.levels, np.int64)
        self.start[symbols[new]] = new

    def rank(self, symbol: np.ndarray, to: np.ndarray) -> np.ndarray:
        """How often each symbol, of those in the sequence, occurs before each place."""
        for level, bits in enumerate(self.bits):
            ones = bits.rank(to)
            to = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, to - ones)
        return to - self.start[symbol]

    def ranked(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before that place."""
        symbol = np.zeros_like(at)
        for level, bits in enumerate(self.bits):
            bit, ones = bits.at(at), bits.rank(at)
            at, symbol = np.where(bit, self.zeros[level] + ones, at - ones), symbol * 2 + bit
        return symbol, at - self.start[symbol]


class FmIndex:
    """Texts over word ids 1.., each closed by a 0 that sorts as a symbol of its own, so that the order of suffixes is full.

    What is kept is the wavelet tree of the Burrows-Wheeler transform and a sample of the suffix array: the places of each
    text's first word and of every `sample`-th after it. Other places are found by walking back to a sampled one.
    """

    def __init__(self, text: np.ndarray, sample: int = 16):
        self.size = n = len(text)
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + ends.sum() - 1)
        step = 1
        while True:
            key = rank * (n + rank.max() + 2) + np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(np.diff(key[order]) > 0)
            rank, step = new, step * 2
            if n == 0 or rank[order[-1]] == n - 1:
                break
        self.tree = WaveletTree(text[order - 1], int(text.max()).bit_length())
        self.before = self.tree.below
        first = np.concatenate([[0], np.nonzero(ends)[0][:-1] + 1])
        held = ((np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))) % sample == 0)[order]
        self.held, self.places = Bits(held), order[held].astype(np.int32)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many patterns: the suffixes that start with symbol and go on as those in [lo, hi)."""
        at = self.before[symbol]
        return at + self.tree.rank(symbol, lo), at + self.tree.rank(symbol, hi)

    def search(self, text: np.ndarray, ends: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Match statistics of a streamed text: how many words up to each of `ends` occur, one after another, at `least` places
        or more of the index, looking back `lengths` words at most; and of the ends that get so far, (which, lo, hi) of the
        suffixes that start with these words. An end whose match breaks off goes out at once."""
        reached = np.zeros(len(ends), np.int64)
        at, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        done = []
        while len(at):
            full = reached[at] == lengths[at]
            done.append((at[full], lo[full], hi[full]))
            at, lo, hi = at[~full], lo[~full], hi[~full]
            lo, hi = self.extend(lo, hi, text[ends[at] - reached[at]])
            more = hi - lo >= least
            at, lo, hi = at[more], lo[more], hi[more]
            reached[at] += 1
        return reached, *(np.concatenate([np.zeros(0, np.int64), *c]) for c in list(zip(*done, strict=True)) or [()] * 3)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of suffixes, by their rows in the order of suffixes."""
        places, at = np.empty(len(rows), np.int64), np.arange(len(rows))
        rows, steps = rows.copy(), 0
        while len(at):
            here = self.held.at(rows) == 1
            places[at[here]] = self.places[self.held.rank(rows[here])] + steps
            at, rows = at[~here], rows[~here]
            symbol, before = self.tree.ranked(rows)
            rows, steps = self.before[symbol] + before, steps + 1
        return places


def shard_matches(doc: np.ndarray, start: np.ndarray, rows: np.ndarray, texts: list[str], window: int, streamed: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a shard's index says of its texts, different runs of words that start at (doc, start) and stand in `rows` places:
    (text, first word, length, copies), with copies true for the whole of a text that stands in several places, as found in the
    index, and false for a run of words covered by windows that also start earlier in one of the texts.

    The index is made first; then the texts are streamed through it, `streamed` at a time, for their match statistics.
    """
    ids: dict[str, int] = defaultdict(count().__next__)
    ids[""]  # the nothing between two texts: 0, their end

    def coded(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = ("  ".join(some) + " ").split(" ")
        flat = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        return flat, np.concatenate([[0], np.nonzero(flat == 0)[0][:-1] + 1])

    text, first = coded(texts)
    index = FmIndex(text)
    del text
    of_doc = np.unique(doc, return_inverse=True)[1].astype(np.int64)

    def key(owner: np.ndarray, offset: np.ndarray) -> np.ndarray:
        return (of_doc[owner] << 32) + start[owner] + offset

    found = []
    for base in range(0, len(texts), streamed):
        text, own = coded(texts[base : base + streamed])
        sizes = np.diff(np.append(own, len(text))) - 1
        copied = np.nonzero(rows[base : base + streamed] > 1)[0]
        reached = index.search(text, own[copied] + sizes[copied] - 1, sizes[copied], 1)[0]
        found.append((base + copied, np.zeros(len(copied), np.int64), reached, np.ones(len(copied), bool)))

        owner = np.repeat(np.arange(len(own)), np.maximum(sizes - window + 1, 0))
        ends = np.arange(len(owner)) - np.searchsorted(owner, owner) + own[owner] + window - 1
        _, at, lo, hi = index.search(text, ends, np.full(len(ends), window), 2)
        if not len(at):
            continue
        spans, back = np.unique(lo, return_inverse=True)
        stop = np.empty(len(spans), np.int64)
        stop[back] = hi
        n = stop - spans
        places = index.locate(np.repeat(spans, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        holder = np.searchsorted(first, places, side="right") - 1
        least = np.minimum.reduceat(key(holder, places - first[holder]), np.cumsum(n) - n)
        offset = ends[at] - window + 1 - own[owner[at]]
        later = least[back] < key(base + owner[at], offset)
        who, offset = base + owner[at][later], offset[later]
        by = np.lexsort((offset, who))
        who, offset = who[by], offset[by]
        new = np.nonzero(np.concatenate([[True], (np.diff(who) != 0) | (np.diff(offset) != 1)]))[0] if len(who) else np.zeros(0, np.int64)
        found.append((who[new], offset[new], np.diff(np.append(new, len(who))) + window - 1, np.zeros(len(new), bool)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, seg, doc_id, place): every document cut into segments of consecutive windows that share their anchor, the place
    of the least hash among a window's grams. Equal windows have equal anchors, wherever they are. seg is a hash of the
    segment's words, place its first word times 2^8 plus its number of windows."""
    width = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 20):
            parts = [(t or "").encode().split() for t in b.column("text").to_pylist()]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            h = np.concatenate([_hashes(p) for p in parts]) if sizes.sum() else np.zeros(0, np.uint64)
            n = len(h)
            if n < window:
                continue
            doc = np.repeat(np.arange(len(parts)), sizes)
            first = np.cumsum(sizes) - sizes
            g = np.zeros(n - gram + 1, np.uint64)
            for i in range(gram):
                g = g * BASE + h[i : i + n - gram + 1]
            g ^= g >> np.uint64(29)
            g *= np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(32)
            s = np.arange(n - window + 1)
            low = np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + s
            s = s[doc[s] == doc[s + window - 1]]
            if not len(s):
                continue
            low = low[s]
            new = np.concatenate([[True], (np.diff(low) != 0) | (np.diff(s) != 1) | (np.diff(doc[s]) != 0)])
            at = np.nonzero(new)[0]
            begin, count = s[at], np.diff(np.append(at, len(s)))
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
            total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1], dtype=np.uint64)])
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)))]), dtype=np.uint64)
            seg = (total[begin + count + window - 1] - total[begin]) * back[begin]
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            place = ((begin - first[doc[begin]]) << 8) | count
            yield pa.record_batch([pa.array(g[low[at]].view(np.int64)), pa.array(seg.view(np.int64)), pa.array(ids[doc[begin]]), pa.array(place)], ["anchor", "seg", "doc_id", "place"])

    return docs.mapInArrow(run, "anchor long, seg long, doc_id long, place long")


def repeated_spans(docs: DataFrame, window: int = 20, gram: int = 8, shard_rows: int = 8192, hot: int = 4096) -> DataFrame:
    """(doc_id, start, length): spans of words covered by windows that also start earlier, from docs (doc_id, text).

    Windows are dealt out by their anchors (see segments), so equal windows meet. An anchor that occurs once is done with.
    Equal segments of the others are combined before the shuffle, by 128 bits of hashes (anchor and segment), to the first and
    their number, and each goes once, as text, to the anchor's shard, whose FM-index is searched for it: the match of the whole
    holds for all later copies, and that of its windows for the first. The segments of an anchor with more than `hot` different
    ones are cut into windows, which are combined and looked up in the same way; windows and repeated segments of such an
    anchor go to shards by hashes of their own, so that no shard grows with one passage. Keys that hold many rows are joined where their rows lie (see keyed_join).
    """
    docs = docs.filter("doc_id is not null and text is not null")
    every = segments(docs, window, gram)
    several = kept(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "window-anchors")
    some = kept(every.join(several, "anchor", "left_semi"), "window-segments")
    combine = lambda rows: rows.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("rows"))
    first = kept(combine(some).withColumn("deal", F.col("anchor")), "window-firsts")
    narrow = docs.select("doc_id", "text")

    def of_doc(rows: DataFrame) -> DataFrame:
        """The texts of the documents of rows (anchor, seg, first, rows, deal), with these as `parts`."""
        part = F.struct("anchor", "seg", F.col("first.place").alias("place"), "rows", "deal")
        return narrow.join(rows.groupBy("first.doc_id").agg(F.collect_list(part).alias("parts")), "doc_id")

    def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 20):
            found = []
            for i, text, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "parts")), strict=True):
                words = text.encode().split()
                for p in parts:
                    s = p["place"] >> 8
                    for j in range(s, s + (p["place"] & 255)):
                        t = b" ".join(words[j : j + window])
                        found.append((xxh64_intdigest(t) - (1 << 63), xxh64_intdigest(t, 1) - (1 << 63), i, j << 8 | 1))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in list(zip(*found, strict=True)) or [[]] * 4], ["anchor", "seg", "doc_id", "place"])

    contested = kept(first.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"), "hot-anchors")
    if not contested.isEmpty():
        # windows of the first of equal segments: their later copies are found as a whole
        cut_up = first.join(contested, "anchor", "left_semi")
        windows = kept(of_doc(cut_up).mapInArrow(singly, "anchor long, seg long, doc_id long, place long"), "hot-windows")
        parts = combine(windows).filter("rows > 1").withColumn("deal", F.col("anchor"))
        wholes = cut_up.filter("rows > 1").withColumn("deal", F.col("seg"))
        first = kept(first.join(contested, "anchor", "left_anti").unionByName(parts).unionByName(wholes), "window-all-firsts")
        some = some.union(windows)
    total, rows = first.agg(F.count("*"), F.sum("rows")).first()
    shards = max(1, -(-total // shard_rows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 20):
            found = []
            for i, text, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "parts")), strict=True):
                words = text.encode().split()
                for p in parts:
                    s, n = p["place"] >> 8, p["place"] & 255
                    found.append((p["deal"] % shards, p["anchor"], p["seg"], i, s, p["rows"], b" ".join(words[s : s + n + window - 1]).decode()))
            cols = list(zip(*found, strict=True)) or [[]] * 7
            types = (pa.int32(), *[pa.int64()] * 5, pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["shard", "anchor", "seg", "doc_id", "start", "rows", "words"])

    def search(_: tuple, t: pd.DataFrame) -> pd.DataFrame:
        doc, start, n = (t[c].to_numpy() for c in ("doc_id", "start", "rows"))
        who, offset, length, copies = shard_matches(doc, start, n, t["words"].tolist(), window)
        return pd.DataFrame({"anchor": t["anchor"].to_numpy()[who], "seg": t["seg"].to_numpy()[who], "doc_id": doc[who], "start": start[who] + offset, "length": length, "rows": np.where(copies, n[who], 0)})

    texts = of_doc(first).mapInArrow(cut, "shard int, anchor long, seg long, doc_id long, start long, rows long, words string")
    found = kept(texts.groupBy("shard").applyInPandas(search, "anchor long, seg long, doc_id long, start long, length long, rows long"), "window-matches")
    copies = found.filter("rows > 0").select("anchor", "seg", F.struct("doc_id", "start").alias("first"), "length", "rows")
    again = keyed_join(some.select("anchor", "seg", "doc_id", F.shiftright("place", 8).alias("start")), copies, ["anchor", "seg"], "rows", rows or 0)
    return found.filter("rows = 0").select("doc_id", "start", "length").union(again.filter(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", "length"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every document: text is the words that stay, joined by one space.

    A word goes if a window of `window` words that covers it also starts earlier: in a document with a smaller id, or before
    in its own. Windows are judged on the input. Null texts have no words; documents with a null id keep theirs and take no
    part; rows that repeat an id are one document and fare alike; an empty table gives an empty result; other columns are
    not read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = repeated_spans(narrow, window, **options).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, removed, texts = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                out, to = [], 0
                for s in spans or ():
                    out += words[to : s["start"]] if s["start"] > to else []
                    to = max(to, s["start"] + s["length"])
                out += words[to:]
                counts.append(len(words))
                removed.append(len(words) - len(out))
                texts.append(b" ".join(out).decode())
            yield pa.record_batch([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return narrow.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(drop, "doc_id long, n_words long, n_removed long, text string")
