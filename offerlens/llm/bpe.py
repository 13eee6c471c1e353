"""Byte-level BPE encoding and decoding in length-bucketed padded matrices of numpy."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

NONE = np.int32(2**31 - 1)
#: Cells of a matrix, pieces of text handled at once, pieces remembered: bounds on a task's memory, not on what it handles.
CELLS, PIECES, REMEMBERED = 1 << 20, 1 << 17, 1 << 18
#: Longer pieces are merged from a heap of pairs, in the same order; a matrix would take the square of their length.
LONG = 2048


class PairTable:
    """An open-addressing hash table from (left id, right id) to the id of the merged token, probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(4 * len(merged) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.vals[slot[won]] = merged[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, NONE where there is none; an id of -1 (padding) merges with nothing."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.nonzero((left >= 0) & (right >= 0))
        keys = left[at].astype(np.int64) << 32 | right[at]
        slot, found = self._slot(keys), np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[slot]
            hit = held == keys[todo]
            found[todo[hit]] = self.vals[slot[hit]]
            more = ~hit & (held >= 0)
            todo, slot = todo[more], (slot[more] + 1) & (len(self.keys) - 1)
        out[at] = found
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of ranks (base64 token, rank). A token's rank is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class ByteBpe:
    """Encoder over a file of ranks."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bytes_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get, pairs = self.ranks.get, []
        for token, rank in self.ranks.items():
            pairs += [(a, b, rank) for cut in range(1, len(token)) if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.seen: dict[str, tuple[int, ...]] = {}

    def _merge_rows(self, rows: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Merge rows of at most `width` bytes: each round, every row merges its leftmost pair of least rank; rows that have
        none left go out, the others close the gap."""
        n, out = len(rows), [()] * len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, n)
        m = np.full((n, width + 1), -1, np.int32)
        m[:, :width][np.arange(width) < lengths[:, None]] = self.bytes_id[np.frombuffer(b"".join(rows), np.uint8)]
        r = self.pairs.get(m[:, :-1], m[:, 1:])
        at, cols = np.arange(n), np.arange(width + 1)
        while True:
            j = r.argmin(axis=1)
            best = r[np.arange(len(r)), j]
            done = best == NONE
            if done.any():
                for i, row in zip(at[done].tolist(), m[done], strict=True):
                    out[i] = tuple(row[row >= 0].tolist())
                live = ~done
                if not live.any():
                    return out
                at, m, r, j, best = at[live], m[live], r[live], j[live], best[live]
                filled = int((m >= 0).sum(axis=1).max())
                m, r, cols = m[:, : filled + 1], r[:, :filled], cols[: filled + 1]
            i = np.arange(len(m))
            m[i, j] = best
            take = np.minimum(cols + (cols > j[:, None]), len(cols) - 1)
            m = np.take_along_axis(m, take, 1)
            m[:, -1] = -1
            r = np.take_along_axis(r, np.minimum(take[:, :-1], r.shape[1] - 1), 1)
            r[:, -1] = NONE
            r[i, j] = self.pairs.get(m[i, j], m[i, j + 1])
            left = np.nonzero(j > 0)[0]
            r[left, j[left] - 1] = self.pairs.get(m[left, j[left] - 1], m[left, j[left]])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        ids = self.bytes_id[np.frombuffer(piece, np.uint8)]
        first = self.pairs.get(ids[:-1], ids[1:])
        ids, after, before = ids.tolist(), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.nonzero(first != NONE)[0].tolist()]
        heapq.heapify(heap)
        one = lambda a, b: int(self.pairs.get(np.array([a]), np.array([b]))[0])
        known: dict[tuple[int, int], int] = {}
        while heap:
            merged, i, a, b = heapq.heappop(heap)
            k = after[i]
            if ids[i] != a or k >= len(ids) or ids[k] != b:
                continue
            ids[i], ids[k], after[i] = merged, -1, after[k]
            if after[i] < len(ids):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids):
                    pair = ids[x], ids[y]
                    rank = known.get(pair)
                    if rank is None:
                        rank = known[pair] = one(*pair)
                    if rank != NONE:
                        heapq.heappush(heap, (rank, x, *pair))
        return tuple(x for x in ids if x >= 0)

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces not seen yet."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            pieces = list(dict.fromkeys(pieces))
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in {p for p in pieces if p not in self.seen}:
            b = p.encode()
            if (whole := self.ranks.get(b)) is not None:
                self.seen[p] = (whole,)
            elif len(b) > LONG:
                self.seen[p] = self._merge_long(b)
            else:
                buckets.setdefault(1 << (len(b) - 1).bit_length(), []).append((p, b))
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                self.seen.update(zip((p for p, _ in part), self._merge_rows([b for _, b in part], width), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. The texts' pieces are merged together."""
        out, held, pieces = [], [], []

        def flush() -> None:
            self._learn([p for part in pieces for p in part])
            for ids, part in zip(held, pieces, strict=True):
                ids.extend(chain.from_iterable(map(self.seen.__getitem__, part)))
            held.clear()
            pieces.clear()

        n = 0
        for text in texts:
            ids = array("I")
            out.append(ids)
            found = (m.group() for m in self.pattern.finditer(text)) if text and len(text) > PIECES else iter(self.pattern.findall(text or ""))
            while part := list(islice(found, PIECES)):
                held.append(ids)
                pieces.append(part)
                n += len(part)
                if n >= PIECES:
                    flush()
                    n = 0
        flush()
        return [np.frombuffer(ids, np.uint32).astype("<u4").tobytes() if len(ids) else b"" for ids in out]


class ByteDecoder:
    """The bytes of ids, from the same file of ranks."""

    def __init__(self, path: str):
        by_id = sorted(read_ranks(path).items(), key=lambda x: x[1])
        self.token_at = np.full(by_id[-1][1] + 2, 0, np.int64)
        lengths = np.zeros(by_id[-1][1] + 1, np.int64)
        lengths[[r for _, r in by_id]] = [len(t) for t, _ in by_id]
        self.token_at[1:] = np.cumsum(lengths)
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        parts = []
        for i in range(0, len(ids), 1 << 20):
            start = self.token_at[ids[i : i + (1 << 20)]]
            size = self.token_at[ids[i : i + (1 << 20)] + 1] - start
            to = np.cumsum(size)
            parts.append(self.token_bytes[np.repeat(start - to + size, size) + np.arange(to[-1])].tobytes())
        return b"".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBpe:
    """Made once in a worker process, and shared by the tasks that it runs."""
    return ByteBpe(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> ByteDecoder:
    return ByteDecoder(path)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text's ids as little-endian unsigned 32-bit integers (binary); null and empty texts have none.

    Texts of any length are encoded whole. Ids may be null or repeated. An empty table gives an empty result. Other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in slices(batches):
            yield pa.record_batch([b.column("doc_id"), pa.array(bpe.encode(b.column("text").to_pylist()), pa.binary())], ["doc_id", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """tokens (doc_id, ids) with one more column, `decoded`: the bytes of the text; null and empty ids give none. Rows may
    repeat, in any number; an empty table gives an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = decoder(path)
        for b in slices(batches, "ids"):
            yield pa.record_batch([*b.columns, pa.array([bpe.decode(x or b"") for x in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: digests of its ids and of the bytes decoded from them;
    `with_ids` adds the ids, as `encoded` gives them.

    Null texts count as empty: no ids, the digests of nothing. Repeated rows give repeated rows; texts of any length are taken
    whole; an empty table gives an empty result; other columns are not read.
    """
    both = decoded(encoded(docs, path, pattern), path)
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), *digests, *(["ids"] if with_ids else []))
