"""Signed feature hashing of texts: sparse vectors of 256 buckets, worked out in numpy where a text is read."""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, UNIT = 256, 10**6  # weights are whole millionths
#: Bytes of text and texts that are cut into words at a time; vectors that are put together at a time; words whose features a process remembers.
PIECE, TEXTS, VECTORS, WORDS = 1 << 21, 2048, 1024, 1 << 18


@cache
def _letters() -> np.ndarray:
    """For each code point whether it stands in a word: letters and digits of any script, _ and -."""
    return np.array([unicodedata.category(c)[0] in "LN" or c in "_-" for c in map(chr, range(sys.maxunicode + 1))])


def _hashed(word: str) -> tuple[int, int]:
    digest = hashlib.sha256(word.encode()).digest()
    return int.from_bytes(digest[:4], "big") % BUCKETS, -1 if digest[4] % 2 else 1


def _features(word: str) -> tuple[int, int, int, int]:
    """Bucket and weight of a word, and of its first six letters: of weight 0 where it is shorter."""
    bucket, sign = _hashed(word)
    weight = sign * round(UNIT * (24 + min(len(word), 24)) / 24)
    if len(word) < 6:
        return bucket, weight, 0, 0
    begins, sign = _hashed(word[:6])
    return bucket, weight, begins, sign * UNIT // 2


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of about PIECE bytes and TEXTS texts each that cut no word: they fall between texts or behind an ASCII sign."""
    outside, low = ~_letters()[:128], int(offsets[0])
    while low < offsets[-1]:
        n = np.searchsorted(offsets, low, "right")  # the next text
        high = min(low + PIECE, int(offsets[min(n - 1 + TEXTS, len(offsets) - 1)]))
        at = int(offsets[np.searchsorted(offsets, high, "right") - 1])
        while at <= low:  # this text goes on
            signs = np.flatnonzero((data[low:high] < 128) & outside[data[low:high] & 127])
            at = int(offsets[n]) if high >= offsets[n] else low + int(signs[-1]) + 1 if len(signs) else low
            high = min(2 * high - low, int(offsets[n]))
        yield low, at
        low = at


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that lie end to end in UTF-8, and the byte at which each starts. `starts`: the texts' first bytes."""
    first = np.flatnonzero((data & 0xC0) != 0x80)  # a character's first byte
    points = data if len(first) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    inside, new = _letters()[points], np.zeros(len(first) + 1, bool)
    new[np.searchsorted(first, starts)] = new[-1] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | new[1:-1]
    ends[:-1] &= ~inside[1:] | new[1:-1]
    bounds = np.append(first, len(data))
    low, high = first[begins], bounds[np.flatnonzero(ends) + 1]
    kept = data[inside if points is data else np.repeat(inside, np.diff(bounds))]
    offsets = np.append(0, np.cumsum(high - low)).astype(np.int32)
    return pa.StringArray.from_buffers(len(low), pa.py_buffer(offsets), pa.py_buffer(kept)), low


def _rows(ids: pa.Array, sums: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each id, with the buckets that are not 0 and their weights."""
    at, bucket = np.nonzero(sums)
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=len(ids)))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (bucket.astype(np.int16), sums[at, bucket])]
    return pa.record_batch([ids, *lists], names)


def _summed(names: list[str]):
    """A vector for each id in each piece of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int, int, int]] = {}
        for b in batches:
            ids, texts = b.column(0), pc.cast(b.column(1), pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for low, high in _pieces(data, offsets):
                from_, to = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
                cut = np.clip(offsets[from_ : to + 1] - low, 0, high - low)
                piece = pc.utf8_lower(pa.LargeStringArray.from_buffers(to - from_, pa.py_buffer(cut), pa.py_buffer(data[low:high])))
                starts = np.frombuffer(piece.buffers()[1], np.int64)[: to - from_ + 1]
                words, at = _words(np.frombuffer(piece.buffers()[2], np.uint8)[: starts[-1]], starts[:-1])
                if not len(words):
                    continue
                some = ids.slice(from_, to - from_).dictionary_encode()  # rows of one id go together
                row = some.indices.to_numpy()[np.searchsorted(starts[:-1], at, "right") - 1].astype(np.int64)
                words = words.dictionary_encode()
                different = words.dictionary.to_pylist()
                if len(known) + len(different) > WORDS:
                    known.clear()
                table = np.array([known.get(w) or known.setdefault(w, _features(w)) for w in different], np.int64)[words.indices.to_numpy()]
                cells = np.concatenate([row * BUCKETS + table[:, 0], row * BUCKETS + table[:, 2]])
                # doubles hold these sums exactly: a piece has far fewer than 2**53 millionths
                sums = np.bincount(cells, np.concatenate([table[:, 1], table[:, 3]]), len(some.dictionary) * BUCKETS)
                yield _rows(some.dictionary, sums.astype(np.int64).reshape(-1, BUCKETS), names)

    return run


def _united(names: list[str]):
    """Vectors of one id, which follow each other, added and set to a length of one, as a row a bucket."""

    def scaled(ids: pa.Array, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, bucket = np.nonzero(sums)
        weights = sums / UNIT
        x = weights[at, bucket] / np.sqrt((weights * weights).sum(1))[at] * UNIT
        whole = np.trunc(x)  # halves away from 0
        yield pa.record_batch([ids.take(pa.array(at)), pa.array(bucket), pa.array((whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0)) / UNIT + 0.0)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the id that may go on in the next batch
        for batch in batches:
            for low in range(0, batch.num_rows, VECTORS):
                b = batch.slice(low, VECTORS)
                some, size = b.column(0).dictionary_encode(), pc.list_value_length(b.column(1)).to_numpy()
                ids, sums = some.dictionary, np.zeros((len(some.dictionary), BUCKETS), np.int64)
                np.add.at(sums, (np.repeat(some.indices.to_numpy(), size), b.column(1).flatten().to_numpy()), b.column(2).flatten().to_numpy())
                if held is not None and last[0] == ids[0]:
                    sums[0] += held[0]
                elif held is not None:
                    yield from scaled(last, held)
                yield from scaled(ids.slice(0, len(ids) - 1), sums[:-1])
                last, held = ids.slice(len(ids) - 1), sums[-1:]
        if held is not None:
            yield from scaled(last, held)

    return run


def hashed_vectors(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, bucket, weight) of each id: the buckets that are not 0, at a length of one, rounded to six places.

    A word (letters and digits of any script, _ and -, in lower case) counts 1 + its length / 24, at most 2, and its first six letters 0.5
    where it has so many; bucket and sign come from the SHA-256. Texts are read where they lie and leave a task as
    vectors of whole millionths, so a sum does not depend on its order; those of one id meet after a shuffle. Rows that repeat an id count
    together; null texts, texts without words and rows without an id have no row; long texts are read whole, in pieces.
    """
    kind = dict(docs.dtypes)[id_]
    narrow = docs.filter(F.col(id_).isNotNull() & F.col(text).isNotNull()).select(id_, F.make_valid_utf8(text).alias("text"))
    vectors = narrow.mapInArrow(_summed([id_, "buckets", "weights"]), f"{id_} {kind}, buckets array<short>, weights array<long>")
    dealt = vectors.repartition(id_).sortWithinPartitions(id_)
    return dealt.mapInArrow(_united([id_, "bucket", "weight"]), f"{id_} {kind}, bucket long, weight double")
