"""Ranked lexical search: posting lists cut into blocks of variable length, and an exact search that skips blocks by their bounds."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept, small_batches
from .text import slices

#: Characters of terms are ASCII letters and digits and all others outside ASCII, which are bytes from 128 in UTF-8.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists of about a megabyte each."""
    data, at = text.translate(FOLD), 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = Counter(t for piece in terms((text or "").encode()) for t in piece)
            yield pa.record_batch([pa.array([item] * len(found), pa.int64()), pa.array([t.decode() for t in found], pa.string()), pa.array(found.values(), pa.int64())], ["item_id", "term", "times"])


def _posted(number: dict[bytes, int]):
    """(doc_id, n, terms, tfs) of each document that has a term: its length, and how often it holds each of the asked terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, which, times, keep = [], [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                found, total = Counter(), 0
                for piece in terms(text or b""):
                    total += len(piece)
                    found.update(map(number.get, piece))
                found.pop(None, None)
                keep.append(total > 0)
                if total:
                    n.append(total)
                    which.append(list(found))
                    times.append(list(found.values()))
            ids = b.column("doc_id").filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return run


def block_starts(lists: list[np.ndarray], grain: int = 8, longest: int = 64, price: float = 16.0) -> list[np.ndarray]:
    """For each list of scores, where its blocks begin.

    A block's error is its largest score times its length, less its scores. Dynamic programming finds the cut with the least
    error plus a price a block (`price` mean scores of the list), over cuts at every `grain` postings and blocks of at most
    `longest` grains. All lists advance together, longest first.
    """
    order = sorted(range(len(lists)), key=lambda i: -len(lists[i]))
    cells = np.array([-(-len(lists[i]) // grain) for i in order])
    n, wide = len(order), int(cells.max(initial=0))
    top, size, cost = np.zeros((n, wide)), np.zeros((n, wide)), np.zeros((n, 1))
    for r, i in enumerate(order):
        at = np.arange(0, len(lists[i]), grain)
        top[r, : len(at)] = np.maximum.reduceat(lists[i], at)
        size[r, : len(at)] = np.diff(at, append=len(lists[i]))
        cost[r] = price * lists[i].mean()
    before = np.zeros((n, wide + 1))
    before[:, 1:] = size.cumsum(axis=1)
    best, came = np.zeros((n, wide + 1)), np.zeros((n, wide + 1), np.int64)
    peak = np.zeros((n, longest))  # of the block that begins k grains before
    for j in range(1, wide + 1):
        live = int(np.searchsorted(-cells, -j, side="right"))
        most = min(j, longest)
        peak[:live, 1:] = peak[:live, :-1]
        peak[:live, 0] = 0
        np.maximum(peak[:live], top[:live, j - 1, None], out=peak[:live])
        begin = np.arange(j - 1, j - 1 - most, -1)
        total = best[:live, begin] + (before[:live, j, None] - before[:live, begin]) * peak[:live, :most]
        k = total.argmin(axis=1)
        best[:live, j] = total[np.arange(live), k] + cost[:live, 0]
        came[:live, j] = j - 1 - k
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for r, i in enumerate(order):
        starts, j = [], int(cells[r])
        while j > 0:
            j = int(came[r, j])
            starts.append(j * grain)
        out[i] = np.array(starts[::-1], np.int64)
    return out


class Shard:
    """Posting lists of some documents: by term, documents (numbers within the shard) in order and their scores, in blocks."""

    def __init__(self, docs: int, doc: np.ndarray, term: np.ndarray, score: np.ndarray):
        keep = score > 0
        doc, term, score = doc[keep], term[keep], score[keep]
        by = np.argsort(term, kind="stable")
        doc, term, score = doc[by], term[by], score[by]
        names, begin = np.unique(term, return_index=True)
        end = np.append(begin[1:], len(term))
        self.docs = [doc[a:b] for a, b in zip(begin, end, strict=True)]
        self.scores = [score[a:b] for a, b in zip(begin, end, strict=True)]
        self.at = {int(t): i for i, t in enumerate(names)}
        starts = block_starts(self.scores)
        #: For each list, where its bound changes and by how much.
        self.places, self.steps = [], []
        for d, s, b in zip(self.docs, self.scores, starts, strict=True):
            self.places.append(np.append(d[b], d[-1] + 1))
            self.steps.append(np.diff(np.maximum.reduceat(s, b), prepend=0, append=0))
        self.sum = np.zeros(docs, np.int64)
        self.read = 0

    def best(self, asked: Iterable[tuple[int, int]], top: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, bar): all documents that may be among the `top` best, none below `floor`; asked: terms and times.

        Between two block borders of any list the sum of block maxima is constant: a bound for all documents there. Stretches
        are read from the highest bound down until it is below the score of the document at rank `top`.
        """
        lists = [(self.at[t], times) for t, times in asked if t in self.at]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), floor
        place = np.concatenate([self.places[i] for i, _ in lists])
        step = np.concatenate([self.steps[i] * times for i, times in lists])
        by = np.argsort(place, kind="stable")
        border, first = np.unique(place[by], return_index=True)
        bound = np.add.reduceat(step[by], first).cumsum()[:-1]
        low, high = border[:-1], border[1:]
        order = np.argsort(-bound, kind="stable")
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, many = 0, 32
        while at < len(order) and bound[order[at]] >= floor:
            some = order[at : at + many]
            some = np.sort(some[bound[some] >= floor])
            at, many = at + many, many * 2
            touched = []
            for i, times in lists:
                d = self.docs[i]
                a, b = np.searchsorted(d, low[some]), np.searchsorted(d, high[some])
                n = b - a
                if not n.any():
                    continue
                which = np.repeat(a - np.append(0, n.cumsum()[:-1]), n) + np.arange(n.sum())
                self.sum[d[which]] += self.scores[i][which] * times
                touched.append(d[which])
            if not touched:
                continue
            seen = np.concatenate(touched)
            self.read += len(seen)
            seen = seen[self.sum[seen] >= floor]
            new = np.unique(seen)
            found, scores = np.append(found, new), np.append(scores, self.sum[new])
            for t in touched:
                self.sum[t] = 0
            if len(scores) >= top:
                floor = max(floor, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
                good = scores >= floor
                found, scores = found[good], scores[good]
        return found, scores, floor


def _searched(items: list[tuple[int | None, list[tuple[int, int]]]], weight: np.ndarray, n_docs: int, n_terms: int, top: int, postings: int):
    """The best documents of each item among a task's documents, shard by shard; what one shard finds bars the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]

        def search(parts: list[tuple[np.ndarray, ...]]) -> None:
            ids, none, n, count, term, tf = map(np.concatenate, zip(*parts, strict=True))
            doc = np.repeat(np.arange(len(ids)), count)
            m = 75 + (25 * n * n_docs) // n_terms
            shard = Shard(len(ids), doc, term, weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])))
            for k, (_, asked) in enumerate(items):
                bar = -best[k][-1][0] if len(best[k]) == top else 1
                found, scores, _ = shard.best(asked, top, bar)
                best[k] = sorted(best[k] + [(-s, z, i) for s, z, i in zip(scores.tolist(), none[found].tolist(), ids[found].tolist(), strict=True)])[:top]

        parts, held = [], 0
        for b in batches:
            count = np.asarray(b.column("terms").value_lengths(), np.int64)
            whole = (np.asarray(b.column("doc_id").fill_null(0), np.int64), np.asarray(b.column("doc_id").is_null()), np.asarray(b.column("n"), np.int64), count)
            term, tf = np.asarray(b.column("terms").flatten(), np.int64), np.asarray(b.column("tfs").flatten(), np.int64)
            parts.append((*whole, term, tf))
            held += len(term)
            if held >= postings:
                search(parts)
                parts, held = [], 0
        if parts:
            search(parts)
        for (item, _), rows in zip(items, best, strict=True):
            if rows:
                yield pa.record_batch([pa.array([item] * len(rows), pa.int64()), pa.array([None if z else i for _, z, i in rows], pa.int64()), pa.array([-s for s, _, _ in rows], pa.int64())], ["item_id", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = 20, doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = 1 << 17, postings: int = 1 << 21) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item by a BM25 score in integers, the lower id of equals first.

    Items are taken in blocks of about `block` distinct terms (a hash of the id decides the block). For a block, one pass over
    the documents writes a row for each with its length and its counts of the asked terms; lengths and document frequencies are
    sums over that table. A second pass makes shards of about `postings` postings within each task, with block borders by dynamic
    programming, and searches them exactly; tasks return `top` rows an item, and a window ranks those. No shuffle carries postings, so
    no term or source can make a task large. A task holds one shard, and a text is cut into terms a megabyte at a time.

    Null and empty texts have no terms: such documents do not count, such items have no rows. Equal rows of items count once; rows that
    share an id otherwise are one item with the terms of all. Every row of documents is a document of its own, repeated
    ids included; a null id comes after others. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    counted = asked.mapInArrow(_counted_items, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))
    queries = kept(counted, "asked-terms")
    blocks = max(1, -(-queries.count() // block))
    out = None
    for k in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        names = sorted({r.term for r in mine})
        number = {t.encode(): i for i, t in enumerate(names)}
        with small_batches(spark):
            table = kept(rows.mapInArrow(_posted(number), "doc_id long, n long, terms array<int>, tfs array<long>"), "postings")
            size = table.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
            having = dict(table.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
            weight = np.array([math.floor(1000 * math.log((2 * size.docs + 2) / (2 * having.get(i, 0) + 1))) for i in range(len(names))], np.int64)
            wanted: dict[int | None, list[tuple[int, int]]] = {}
            for r in mine:
                wanted.setdefault(r.item_id, []).append((number[r.term.encode()], r.times))
            search = _searched(list(wanted.items()), weight, size.docs, size.terms, top, postings)
            found = kept(table.filter(F.size("terms") > 0).mapInArrow(search, "item_id long, doc_id long, score long"), "found")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _found(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


SQL = f"""
with q as materialized (select item_id, t, count(*) c from (select item_id, unnest({_found("text")}) t from (select distinct item_id, text from benchmark)) group by 1, 2),
d as materialized (select row_number() over () r, doc_id, {_found("text")} ts from documents), n as (select r, doc_id, len(ts) n from d where len(ts) > 0),
tot as materialized (select count(*) all_docs, sum(n)::bigint all_terms from n),
p as materialized (select r, t, count(*) tf from (select r, unnest(ts) t from d) where t in (select t from q) group by 1, 2),
w as (select t, floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)))::bigint w from (select t, count(*) df from p group by 1), tot),
s as (select item_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))))::bigint score, any_value(doc_id) doc_id
  from q join p using (t) join w using (t) join n using (r), tot group by 1, 2)
select item_id, rank, doc_id, score from (select item_id, doc_id, score, (row_number() over (partition by item_id order by score desc, doc_id))::int rank from s where score > 0) where rank <= 20"""
