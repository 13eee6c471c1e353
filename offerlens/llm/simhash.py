"""SimHash near-duplicates: fingerprints linked at a small Hamming distance through sharded vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .graph import components
from .storage import kept
from .text import slices

#: Hashes whose bits are counted at once; bounds memory for very long texts.
CHUNK = 1 << 15
#: Comparisons made in one numpy call.
BLOCK = 1 << 21


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def _ones(h: np.ndarray) -> np.ndarray:
    """For hashes of shape (n, parts): how many have each bit set, (parts, 64). Bits are added up in the bytes of a long, 255
    hashes at most at a time."""
    n, parts = h.shape
    lanes = (h[:, None, :] >> np.arange(8, dtype=np.uint64)[:, None]) & np.uint64(0x0101010101010101)
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 8, parts, 8).sum(axis=0, dtype=np.int64).transpose(1, 2, 0).reshape(parts, 64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included, by their XXH64; 0 if it has no word."""
    words = _words(text)
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes, count, ones = map(xxh64_intdigest, grams, repeat(seed)), 0, np.zeros((1, 64), np.int64)
    while len(h := np.fromiter(islice(hashes, CHUNK), np.uint64)):
        count += len(h)
        ones += _ones(h[:, None])
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The set of a text's word shingles as sorted hashes, polynomials of their words' hashes; none if it has no word."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return np.unique(h)


def _signed(h: np.ndarray, parts: int) -> np.ndarray:
    ones = np.zeros((parts, 64), np.int64)
    salts = np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
    for i in range(0, len(h), CHUNK):
        ones += _ones(_mixed(h[i : i + CHUNK, None] + salts))
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view(np.uint64).reshape(parts)


def signature(text: str | None, parts: int, shingle: int = 5) -> np.ndarray:
    """A SimHash of 64 * parts bits of a text's set of word shingles, each mixed anew for each part; zeros if it has no word."""
    return _signed(shingle_hashes(text, shingle), parts)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row a document, fp the fingerprint's bits as a signed long. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


class Tree:
    """A vantage-point tree over Hamming distance, fitted on a bounded sample; its leaves are shards.

    At a node, points within `radius` of its vantage point are inner, the others outer. Two points at most k apart differ by
    at most k in their distance to the vantage point. So if they part at a node, the outer one lies within radius + k, and
    visiting the inner side with such points alone finds the pair; from there a visitor follows each side that the same
    bound leaves open.
    """

    def __init__(self, sample: np.ndarray, leaf: int, k: int, seed: int = 7):
        self.k, self.leaves = k, 0
        self.root = self._grow(np.unique(sample), max(1, leaf), np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, leaf: int, rng) -> tuple | int:
        if len(points) > leaf:
            best = None
            for v in rng.choice(points, min(8, len(points)), replace=False):
                d = np.bitwise_count(points ^ v).astype(np.int64)
                counts = np.bincount(d, minlength=66)
                below = np.cumsum(counts)
                # the share that would visit from across the border, and how far from even the halves are
                border = np.array([counts[r + 1 : r + 1 + self.k].sum() for r in range(65)])
                cost = np.maximum(below[:65] + border, len(points) - below[:65]) + np.where((below[:65] == 0) | (below[:65] == len(points)), 1 << 40, 0)
                r = int(cost.argmin())
                if best is None or cost[r] < best[0]:
                    best = int(cost[r]), v, r, d
            cost, v, r, d = best
            if cost < len(points):
                return v, r, self._grow(points[d <= r], leaf, rng), self._grow(points[d > r], leaf, rng)
        self.leaves += 1
        return self.leaves - 1

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of point, shard, 1 if the point lives there or 0 if it visits)."""
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        stack = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                out.append((at, node, home))
                continue
            v, r, inner, outer = node
            d = np.bitwise_count(points[at] ^ v).astype(np.int64)
            near = d <= r + self.k
            stack.append((inner, at[near], home[near] & (d[near] <= r)))
            far = np.where(home, d > r, d + self.k > r)
            stack.append((outer, at[far], home[far]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate([a for a, _, _ in out]), np.concatenate([np.full(len(a), s) for a, s, _ in out]), np.concatenate([h for _, _, h in out])


def close_pairs(points: np.ndarray, queries: np.ndarray, k: int, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (of query, of point) of all pairs at most k apart, from a vantage-point tree walked for all queries at once."""
    rng = np.random.default_rng(seed)
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > 256:
            v = points[rng.choice(p)]
            dp, dq = (np.bitwise_count(x ^ v).astype(np.int64) for x in (points[p], queries[q]))
            r = int(np.median(dp))
            r -= int(r == dp.max())
            inner, outer = dq - k <= r, dq + k > r
            # splitting pays only while the bounds prune
            if (a := (dp <= r).sum()) and a * inner.sum() + (len(p) - a) * outer.sum() < 0.9 * len(p) * len(q):
                stack += [(p[dp <= r], q[inner]), (p[dp > r], q[outer])]
                continue
        step = max(1, BLOCK // len(p))
        for i in range(0, len(q), step):
            x, y = np.nonzero(np.bitwise_count(queries[q[i : i + step], None] ^ points[p]) <= k)
            yield q[i + x], p[y]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For n nodes joined by pairs: each node's smallest node reachable. Pairs are taken in blocks, never held together."""
    low = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = low[a], low[b]
            if not len(todo := np.nonzero(x != y)[0]):
                break
            a, b, x, y = a[todo], b[todo], x[todo], y[todo]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := low[low], low):
                low = up
    return low


def _shard_links(k: int):
    def run(_: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("fp")
        fp, home = t["fp"].to_numpy(), t["home"].to_numpy().astype(bool)
        own = np.nonzero(home)[0]
        bits = fp.view(np.uint64)
        low = forest(len(fp), ((q, own[p]) for q, p in close_pairs(bits[own], bits, k)))
        tied = np.nonzero(low != np.arange(len(fp)))[0]
        return pd.DataFrame({"a": fp[tied], "b": fp[low[tied]]})

    return run


def link_fingerprints(fps: DataFrame, k: int = 2, shard_rows: int = 8192, sample_rows: int = 1 << 20) -> DataFrame:
    """(fp, component): every distinct value of fps.fp, with the smallest (as a signed long) reachable over links of at most k bits.

    The top of the tree is fitted on a bounded sample (32 values a shard, at most `sample_rows`, those of least hash) and
    sent to the tasks. Every value lives in one shard and visits those whose border it is near.
    A shard walks its own tree and returns a spanning forest of its links, not the links.
    """
    fps = fps.select("fp").filter("fp is not null").distinct()
    total = fps.count()
    shards = max(1, -(-total // shard_rows))
    size = min(sample_rows, max(1 << 14, 32 * shards)) if shards > 1 else 0
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(size).collect()], np.int64).view(np.uint64)
    tree = Tree(sample, max(16, len(sample) // shards), k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            at, shard, home = tree.route(fp.view(np.uint64))
            yield pa.record_batch([pa.array(fp[at]), pa.array(shard.astype(np.int32)), pa.array(home.astype(np.int8))], ["fp", "shard", "home"])

    links = fps.mapInArrow(route, "fp long, shard int, home byte").groupBy("shard").applyInPandas(_shard_links(k), "a long, b long")
    found = components(links)
    return fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, k: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document; component_id is the smallest doc_id reachable.

    Null and empty texts have the fingerprint 0 and link like any other. Rows with a null id get the component of their
    fingerprint but never name one. Repeated rows give repeated rows. An empty table gives an empty result. Columns other
    than the id and the text are not read, whatever their names.
    """
    prints = kept(with_fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    first = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    group = kept(first.join(link_fingerprints(first, k), "fp"), "fingerprint-groups")
    lowest = kept(group.groupBy("component").agg(F.min("low").alias("component_id")), "group-lowest")
    named = kept(group.join(lowest, "component").select("fp", "component_id"), "named-groups")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: 64-bit parts of the long fingerprints; each gives two words of 32 bits. At a Jaccard similarity of 0.8 a word is within 2
#: bits for 12 % of pairs, one of 32 words for 98 %.
PARTS = 16


def _names(parts: int) -> list[str]:
    return [f"s{i}" for i in range(parts)]


#: What tells shingle sets apart: their size and two sums of hashes.
SET = ("n", "d0", "d1")


def with_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, parts: int = PARTS) -> DataFrame:
    """(doc_id, n, d0, d1, s0, s1, ...): one row a document, its shingle set's size and sums and its long fingerprint as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = np.empty((b.num_rows, len(SET) + parts), np.uint64)
            for i, t in enumerate(b.column("text").to_pylist()):
                h = shingle_hashes(t, shingle)
                rows[i, :3] = len(h), _mixed(h).sum(dtype=np.uint64), _mixed(h ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
                rows[i, 3:] = _signed(h, parts)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x) for x in np.ascontiguousarray(rows.view(np.int64).T))], ["doc_id", *SET, *_names(parts)])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in (*SET, *_names(parts)))]))


def differing_bits(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of texts differ at most whose shingle sets have this Jaccard similarity: five standard
    deviations over the mean, since only candidates are judged by it."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + 5 * np.sqrt(bits * p * (1 - p))))


def _keyed(sigs: DataFrame, parts: int) -> DataFrame:
    """(key, low, component) from sigs (low, component, s0, ...): a row for each word of 32 bits, with its position above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _names(parts)], 1)
            words = np.ascontiguousarray(sig).view(np.uint32)
            for w in range(2 * parts):
                yield pa.record_batch([pa.array(words[:, w].astype(np.int64) | (w << 32)), b.column("low"), b.column("component")], ["key", "low", "component"])

    return sigs.select("low", "component", *_names(parts)).mapInArrow(run, "key long, low long, component long")


def _word_links(values: DataFrame, sigs: DataFrame, total: int, k: int, parts: int, shard_rows: int) -> DataFrame:
    """(x, y): pairs of keys at the same position whose words differ in at most k bits, unless all their rows are of one
    component already. values: (key, c0, c1), every key once with the least and greatest component of its rows, so that a
    shard's frame holds a word once however many rows share it."""
    shards = max(1, -(-total // shard_rows))
    size = min(1 << 20, max(1 << 14, 32 * shards)) if shards > 1 else 0
    sample = np.array([r.s0 for r in sigs.select("s0").orderBy(F.xxhash64("s0"), "s0").limit(size).collect()], np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
    tree = Tree(sample, max(16, len(sample) // shards), k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            at, shard, home = tree.route((key & 0xFFFFFFFF).astype(np.uint64))
            rows = b.take(pa.array(at))
            yield pa.record_batch([pa.array((shard * 2 * parts + (key[at] >> 32)).astype(np.int32)), pa.array(home), *(rows.column(c) for c in ("key", "c0", "c1"))], ["shard", "home", "key", "c0", "c1"])

    def links(_: tuple, t: pd.DataFrame) -> pd.DataFrame:
        key, c0, c1, own = t["key"].to_numpy(), t["c0"].to_numpy(), t["c1"].to_numpy(), np.nonzero(t["home"].to_numpy())[0]
        word = (key & 0xFFFFFFFF).astype(np.uint64)
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, p in close_pairs(word[own], word, k):
            p = own[p]
            open_ = (key[q] != key[p]) & ((c0[q] != c1[p]) | (c1[q] != c0[p]))
            x.append(np.minimum(key[q], key[p])[open_])
            y.append(np.maximum(key[q], key[p])[open_])
        return pd.DataFrame({"x": np.concatenate(x), "y": np.concatenate(y)})

    routed = values.mapInArrow(route, "shard int, home boolean, key long, c0 long, c1 long")
    near = routed.groupBy("shard").applyInPandas(links, "x long, y long")
    return near.union(values.filter("c0 <> c1").select("key", "key")).toDF("x", "y").distinct()


def _within(pairs: DataFrame, sigs: DataFrame, similarity: float, parts: int) -> DataFrame:
    """The pairs (a, b) whose long fingerprints and set sizes leave the similarity open."""
    names, most = _names(parts), differing_bits(similarity, 64 * parts)
    side = lambda c: sigs.select(F.col("low").alias(c), F.col("n").alias(f"{c}_n"), *(F.col(s).alias(f"{c}_{s}") for s in names))
    differ = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in names[1:]), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter((differ <= most) & (small >= large * similarity)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of ids of docs (doc_id, text) whose shingle sets have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_hashes(t, shingle).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "grams"])

    ids = kept(pairs.select("a").union(pairs.select("b")).distinct().toDF("doc_id"), "candidates")
    sets = kept(docs.join(ids.hint("shuffle_hash"), "doc_id").select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>"), "shingle-sets")
    met = pairs.join(sets.toDF("a", "a_grams"), "a").join(sets.toDF("b", "b_grams"), "b")
    met = met.select("a", "b", F.size("a_grams").alias("m"), F.size("b_grams").alias("n"), F.size(F.array_intersect("a_grams", "b_grams")).alias("both"))
    return met.filter(F.col("both") / (F.col("m") + F.col("n") - F.col("both")) >= similarity).select("a", "b").distinct()


def link_signatures(sigs: DataFrame, docs: DataFrame, similarity: float = 0.8, shingle: int = 5, k: int = 2, parts: int = PARTS, shard_rows: int = 8192) -> DataFrame:
    """(a, b): links between rows of sigs (low: long, n, s0, s1, ...) that connect all of them that candidates connect.

    Long fingerprints are cut into words of 32 bits. Two rows are candidates if some word differs in at most k bits and the
    long fingerprints leave the similarity open; they link if the shingle sets of their texts in docs (doc_id, text) have it.
    First each row is compared with the first row of its equal words, which joins most near copies. Then a vantage-point tree of words,
    fitted on a bounded sample, deals each distinct word to its shard, and as a visitor to the shards whose border it is near;
    words at the same position meet, and rows of different components so far are compared pair by pair. A
    single 64-bit fingerprint would need a radius of a dozen bits here, at which triangle bounds prune nothing.
    """
    keyed = _keyed(sigs.withColumn("component", F.col("low")), parts)
    first = keyed.groupBy("key").agg(F.min("low").alias("a"), F.count("*").alias("rows")).filter("rows > 1").select("key", "a")
    stars = keyed.join(first, "key").filter("low <> a").select("a", F.col("low").alias("b")).distinct()
    stars = kept(_within(stars, sigs, similarity, parts).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star-pairs")
    joined = kept(verified(stars, docs, similarity, shingle), "star-links")
    so_far = components(joined).toDF("low", "c")
    known = kept(sigs.join(so_far, "low", "left").withColumn("component", F.coalesce("c", "low")).drop("c"), "star-groups")

    keyed = _keyed(known, parts)
    values = kept(keyed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")), "signature-words")
    near = kept(_word_links(values, known, known.count(), k, parts, shard_rows), "word-pairs")
    side = lambda key, row, of: keyed.toDF(key, row, of)
    rows = near.join(side("x", "p", "pc"), "x").join(side("y", "q", "qc"), "y").filter("pc <> qc")
    pairs = rows.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    open_ = kept(_within(pairs, known, similarity, parts), "open-pairs")
    return joined.union(verified(open_, docs, similarity, shingle))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The documents whose id is the smallest of their group, one row each, with the columns of docs.

    A group is what links of link_signatures reach, each of them verified on the shingle sets. Null and empty texts are one group. Rows with a null id stay and take no
    part. Of rows that repeat an id one stays, any of them. An empty table gives an empty result. Texts are shuffled to meet
    the ids that are candidates, and those that stay; they are not sorted.
    """
    names = _names(PARTS)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = f"c{docs.columns.index(id_col)}"
    sigs = kept(with_signatures(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, shingle), "signatures")
    first = kept(sigs.groupBy(*SET, *names).agg(F.min("doc_id").alias("low")), "distinct-signatures")
    texts = plain.filter(F.col(own).isNotNull()).select(F.col(own).cast("long").alias("doc_id"), F.col(f"c{docs.columns.index(text_col)}").alias("text"))
    groups = components(link_signatures(first, texts, similarity, shingle)).toDF("low", "component")
    firsts = first.join(groups, "low", "left").filter(F.coalesce("component", "low") == F.col("low")).select(F.col("low").alias("__id"))
    times = sigs.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"))
    stay = kept(firsts.distinct().join(times, "__id"), "group-firsts")
    met = plain.join(stay.hint("shuffle_hash"), F.col(own).cast("long") == F.col("__id"))
    once = met.filter("__n = 1").select(*plain.columns)
    again = met.filter("__n > 1").select(*plain.columns).dropDuplicates([own])
    return once.union(again).union(plain.filter(F.col(own).isNull())).toDF(*docs.columns)
