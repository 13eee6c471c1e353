"""Token ids in binary files: Simple-8b words, with escapes and the place of every block."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import kept, small_batches
from .text import slices

#: (values in a word, bits of each) by selector, the top four bits of a word. Selector 0 escapes: its word holds the place
#: of one value of any size in the file's table of escapes. Selector 1 is a run of zeros.
PACKS = ((1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS, BITS = (np.array(x, np.int64) for x in zip(*PACKS, strict=True))
#: Widths that selectors have, with 64 for escapes; the largest value of each; the widths of all small values.
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.uint8)
LIMITS = np.array([(1 << int(b)) - 1 for b in WIDTHS], np.uint64)
SMALL = WIDTHS[np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64))]
BLOCK = 1024
#: Ids after which a file image is closed, at the next end of a document.
IMAGE = 1 << 17
#: Bytes of text in a range of documents: the number of ranges follows the input.
RANGE = 32 << 20
#: Shards up to which their sums are sent to every task: 16 bytes each.
BROADCAST_SHARDS = 1 << 17
MAGIC = 0x31423853


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block of 1024 values, escapes) of unsigned 64-bit values. All blocks are walked at once."""
    v = np.ascontiguousarray(values, np.uint64)
    n, blocks = len(v), -(-len(v) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    width = np.zeros((blocks, BLOCK + 128), np.uint8)
    bits = np.zeros(blocks * BLOCK, np.uint8)
    bits[:n] = WIDTHS[np.searchsorted(LIMITS, v, side="left")] if v.max() >= len(SMALL) else SMALL[v.astype(np.int64)]
    width[:, :BLOCK] = bits.reshape(blocks, BLOCK)
    flat = width.reshape(-1)
    longest = {1: flat}
    for k in (1, 2, 4, 8, 16, 32):
        longest[2 * k] = np.maximum(longest[k], np.concatenate([longest[k][k:], np.zeros(k, np.uint8)]))
    choice = np.zeros(len(flat), np.int8)
    for s in range(len(PACKS) - 1, 0, -1):
        count, b = PACKS[s]
        k = 1 << (count.bit_length() - 1)
        most = longest[k] if k == count else np.maximum(longest[k], np.concatenate([longest[k][count - k :], np.zeros(count - k, np.uint8)]))
        choice[most <= b] = s
    choice = choice.reshape(blocks, -1)
    ends = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    at, live, found = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        s = choice[live, at[live]].astype(np.int64)
        found.append((live, at[live].copy(), s))
        at[live] += COUNTS[s]
        live = live[at[live] < ends[live]]
    block, place, sel = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(block, kind="stable")
    block, place, sel = block[order], place[order], sel[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([v, np.zeros(BLOCK + 128, np.uint64)])
    start, left = block * BLOCK + place, ends[block] - place
    for s in range(2, len(PACKS)):
        w = np.nonzero(sel == s)[0]
        count, b = PACKS[s]
        for i in range(count):
            inside = w[left[w] > i]
            words[inside] |= padded[start[inside] + i] << np.uint64(i * b)
    w = np.nonzero(sel == 0)[0]
    words[w] |= np.arange(len(w), dtype=np.uint64)
    return words, np.searchsorted(block, np.arange(blocks)).astype(np.uint32), padded[start[w]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values; blocks start at known words, so every word's place in the result is known at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    upto = np.concatenate([[0], np.cumsum(counts)])[:-1]
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets.astype(np.int64), len(words))))
    start = upto - (upto[offsets.astype(np.int64)][block] if len(words) else 0) + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in range(2, len(PACKS)):
        w = np.nonzero(sel == s)[0]
        count, b = PACKS[s]
        for i in range(count):
            inside = w[start[w] + i < end[w]]
            out[start[inside] + i] = (words[inside] >> np.uint64(i * b)) & np.uint64((1 << b) - 1)
    w = np.nonzero(sel == 0)[0]
    out[start[w]] = escapes[(words[w] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def image(lengths: np.ndarray, values: np.ndarray) -> bytes:
    """A file: header (magic, documents, ids, blocks, words, escapes), ids of each document, block offsets, words, escapes."""
    words, offsets, escapes = pack(values)
    head = np.array([MAGIC, len(lengths), len(values), len(offsets), len(words), len(escapes)], "<u8")
    return b"".join(x.tobytes() for x in (head, lengths.astype("<u8"), offsets.astype("<u8"), words.astype("<u8"), escapes.astype("<u8")))


def from_image(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each document, ids) of a file."""
    x = np.frombuffer(data, "<u8")
    magic, docs, n, blocks, words, escapes = x[:6].astype(np.int64).tolist()
    if magic != MAGIC or len(x) != 6 + docs + blocks + words + escapes:
        raise ValueError("not a token file, or cut short")
    lengths, offsets, w, e = np.split(x[6:], np.cumsum([docs, blocks, words]))
    return lengths.astype(np.int64), unpack(w, offsets, e, n)


#: What a byte is: white space, a letter, a digit, a sign, the first of two that may be a letter of Latin-1, or another
#: (apostrophes start pieces that hold letters; signs and letters beyond Latin-1 may change when they are normalised).
SPACE, LETTER, DIGIT, SIGN, LEAD, OTHER = range(6)
KINDS = np.full(256, OTHER, np.uint8)
for _kind, _bytes in ((SPACE, b" \t\n\v\f\r"), (SIGN, bytes(range(33, 127))), (DIGIT, b"0123456789"), (LETTER, bytes((*range(65, 91), *range(97, 123)))), (OTHER, b"'"), (LEAD, b"\xc3")):
    KINDS[list(_bytes)] = _kind
#: Bytes that are a letter behind a lead; every byte in lower case, alone and behind a lead.
BEHIND_LEAD = np.isin(np.arange(256), [c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)])
LOWER, LOWER_BEHIND_LEAD = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BEHIND_LEAD[0x80:0x9F] += 32
#: Texts by which an encoder tells whether it may cut words: every plain letter and sign, alone, twice and between others.
_LETTERS = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
_SIGNS = [chr(c) for c in range(33, 127) if KINDS[c] == SIGN]
PROBE = [x for c in (*_LETTERS, *_SIGNS, *"0123456789") for x in (c, 2 * c, f"ab{c}{c}", f"Ab{c}7.", f"{c}x{c}42{c}", f"-{c}é.")] + ["".join(_LETTERS), "".join(_SIGNS), "the", "Straße", "2024-05-01T10:30"]


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all these spans, one after the other; where each begins in them, and the end)."""
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    places = np.repeat((starts - upto[:-1]).astype(np.int32), sizes)
    places += np.arange(upto[-1], dtype=np.int32)
    return ids[places], upto


def cut(texts: pa.Array, kinds: np.ndarray = KINDS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pieces, whether each is plain, the place in them where each text begins, and the end) of texts; none for null.

    A word of letters, digits and signs is cut into runs of letters, in lower case, single digits and runs of signs, which are
    plain; any other word is one piece, as it stands.
    """
    whole = pa.compute.fill_null(texts.cast(pa.binary()), b"")
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int32)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]

    kind, lower = kinds[data], LOWER[data]
    lead = np.flatnonzero(kind[:-1] == LEAD)
    lead = lead[BEHIND_LEAD[data[lead + 1]]]  # what is behind the others makes their words no plain ones
    kind[lead] = kind[lead + 1] = LETTER
    lower[lead + 1] = LOWER_BEHIND_LEAD[data[lead + 1]]

    inside = kind != SPACE
    turns = np.ones(len(data) + 1, bool)  # one more, for texts that are empty at the end
    turns[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    turns[at] = True
    starts = np.flatnonzero(turns[:-1] & inside)  # of pieces
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = ~inside[:-1]
    first[at] = True
    first = first[starts]  # pieces at which a word starts
    words = starts[first]
    plain = np.ones(len(words), bool)
    plain[np.searchsorted(words, np.flatnonzero(kind == OTHER), side="right") - 1] = False

    there = np.zeros(len(data) + 1, np.int32)  # the place of each byte when white space is left out
    np.cumsum(inside, out=there[1:])
    lower = lower[inside]
    if not plain.all():
        as_is = np.repeat(~plain, np.diff(there[np.append(words, len(data))]))
        lower[as_is] = data[inside][as_is]
    of = plain[np.cumsum(first) - 1] if len(words) else np.zeros(0, bool)
    starts, of = starts[first | of], of[first | of]
    bounds = there[np.append(starts, len(data))]
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(lower)])
    return pieces, of, np.searchsorted(starts, at)


class WordEncoder:
    """Ids of texts under a tokenizers file that drops white space and ends every piece with a token of its suffix.

    ASCII white space ends every piece there, and where a probe finds that runs of letters, digits and runs of signs are pieces
    too, whatever their case, a text's ids are those of its pieces as `cut` finds them; else all words are pieces. Pieces are
    remembered, up to a bound; then the half met most stays (none, if they are very long). The library encodes new plain pieces
    joined by spaces, as their last tokens tell them apart, and the others one by one.
    """

    def __init__(self, path: str, remembered: int = 1 << 18, suffix: str = "</w>"):
        # tasks are the unit of parallel work; threads of the library's own would only compete with them
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        vocabulary = self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        #: the same model for plain pieces: they need no normalising and no search for cuts
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: tokens that are found in a text before it is cut: words with a sign of which one starts stay whole
        self.kinds = KINDS.copy()
        self.kinds[[t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]] = OTHER
        self.forget()
        probe = pa.array(PROBE)
        if not all(map(np.array_equal, self(probe), map(self._singly_ids, PROBE))):
            self.kinds[self.kinds != SPACE] = OTHER
        self.forget()

    def forget(self) -> None:
        """Remember no piece."""
        #: the pieces known; how often each was met, where its ids start in `ids`, and how many they are
        self.known, self.ids = pa.array([], pa.binary()), np.zeros(0, np.uint32)
        self.met, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _forget_half(self) -> None:
        """Keep the half of the pieces that was met most."""
        stay = np.sort(np.argsort(-self.met, kind="stable")[: self.remembered // 2])
        self.ids, upto = _gather(self.ids, self.starts[stay], self.sizes[stay])
        self.known, self.met, self.starts, self.sizes = self.known.take(pa.array(stay)), self.met[stay], upto[:-1].astype(np.int32), self.sizes[stay]

    def _singly_ids(self, word: str) -> np.ndarray:
        return self._singly([word])[0]

    def _singly(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        own = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(own), np.uint32), [len(x) for x in own]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | tuple[np.ndarray, list[int]]:
        """(ids of all pieces, how many each has); one by one where the tokenizer cuts them further."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.nonzero(self.is_last[ids])[0]
        if len(ends) != len(pieces) or ends[-1] != len(ids) - 1:
            return self._singly(pieces)
        return ids, np.diff(ends, prepend=-1)

    def _learn(self, new: pa.Array, plain: np.ndarray) -> None:
        starts, sizes, parts, total = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.ids], len(self.ids)
        for which, encode in ((np.flatnonzero(plain), self._joined), (np.flatnonzero(~plain), self._singly)):
            for i in range(0, len(which), 4096):
                some = which[i : i + 4096]
                ids, sizes[some] = encode(new.take(pa.array(some)).cast(pa.string()).to_pylist())
                starts[some] = total + np.cumsum(sizes[some]) - sizes[some]
                parts.append(ids)
                total += len(ids)
        self.ids, self.known = np.concatenate(parts), pa.concat_arrays([self.known, new])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.starts, self.sizes = np.concatenate([self.starts, starts.astype(np.int32)]), np.concatenate([self.sizes, sizes.astype(np.int32)])

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; none for null."""
        if self.known.nbytes > 64 * self.remembered:
            self.forget()
        elif len(self.known) > self.remembered:
            self._forget_half()
        pieces, plain, at = cut(texts, self.kinds)
        codes = pa.compute.fill_null(pa.compute.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        missed = np.flatnonzero(codes < 0)
        if len(missed):
            new = pieces.take(pa.array(missed)).dictionary_encode()
            codes[missed] = own = new.indices.to_numpy()
            is_plain = np.zeros(len(new.dictionary), bool)
            is_plain[own] = plain[missed]
            codes[missed] += len(self.known)
            self._learn(new.dictionary, is_plain)
        self.met += np.bincount(codes, minlength=len(self.met))
        ids, upto = _gather(self.ids, self.starts[codes], self.sizes[codes])
        bounds = upto[at].tolist()
        return (ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """Made once in a worker process: the tasks that it runs share the words it has met."""
    return WordEncoder(path)


def word_tokenizer(path: str) -> Callable[[], WordEncoder]:
    """An encoder for write_tokens from a tokenizers file that drops white space."""
    return lambda: word_encoder(path)


def range_bounds(docs: DataFrame, ranges: int) -> np.ndarray:
    """The least id of each but the first of about `ranges` ranges of docs.doc_id with as many rows each: Spark samples and
    deals the ids, which are all that is shuffled, and a range's least comes back, 8 bytes for 32 MB of text."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [low for b in batches if (low := pa.compute.min(b.column("doc_id")).as_py()) is not None]
        if found:
            yield pa.record_batch([pa.array([min(found)], pa.int64())], ["least"])

    if ranges < 2:
        return np.zeros(0, np.int64)
    ids = docs.select("doc_id").filter("doc_id is not null")
    return np.sort(np.array([r.least for r in ids.repartitionByRange(ranges, "doc_id").mapInArrow(least, "least long").collect()], np.int64))[1:]


def encoded(docs: DataFrame, encoder: Callable, end_id: int | None, bounds: np.ndarray) -> DataFrame:
    """(shard, doc_id, n_ids, ids) from docs (doc_id, text): the range of the document's id, and its ids with the end id,
    little-endian, in two bytes each where all of them fit, four else (`n_ids` tells which)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for b in slices(batches, limit=2 << 20):
            sizes, packed = [], []
            for own in encode(b.column("text")):
                ids = np.concatenate([own, end])
                sizes.append(len(ids))
                packed.append(ids.astype("<u4" if len(ids) and ids.max() >> 16 else "<u2").tobytes())
            known = pa.compute.fill_null(b.column("doc_id"), np.iinfo(np.int64).min).to_numpy()
            shard = np.searchsorted(bounds, known, side="right").astype(np.int32)
            yield pa.record_batch([pa.array(shard), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["shard", "doc_id", "n_ids", "ids"])

    return docs.mapInArrow(run, "shard int, doc_id long, n_ids long, ids binary")


def write_tokens(docs: DataFrame, path: str, encoder: Callable, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents in ascending order of their ids (null ids first) to the folder `path`.

    Documents are encoded where they lie, so ids are shuffled and not texts, to ranges of document ids, as many as the texts'
    bytes ask for. A range is sorted and written as file images of about 2^17 ids, the rows of a Parquet table (shard,
    seq, before, doc_ids, n_ids, image), so writing commits and retries like any table's, in any store. Null and empty texts
    have the end id alone; repeated ids keep a row each, in one range; an empty table gives a table without images.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = 1 + int(narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_encoder.cache_clear()  # its words have no more use in this worker
        shard, seq, before = None, 0, 0
        ids, lengths, values, total = [], [], [], 0

        def row() -> pa.RecordBatch:
            cols = [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([total], pa.int64())]
            return pa.record_batch([*cols, pa.array([image(np.array(lengths), np.concatenate(values))], pa.binary())], ["shard", "seq", "before", "doc_ids", "n_ids", "image"])

        for b in batches:
            for of, i, n, packed in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "n_ids")), b.column("ids"), strict=True):
                if ids and (total >= IMAGE or of != shard):
                    yield row()
                    ids, lengths, values, before, total, seq = [], [], [], before + total, 0, seq + 1
                if of != shard:
                    shard, seq, before = of, 0, 0
                own = packed.as_buffer()
                values.append(np.frombuffer(own, "<u2" if own.size == 2 * n else "<u4") if n else np.zeros(0, np.uint32))
                ids.append(i)
                lengths.append(n)
                total += n
        if ids:
            yield row()

    tokens = encoded(narrow, encoder, end_id, range_bounds(narrow, ranges))
    dealt = tokens.repartitionById(ranges, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    with small_batches(docs.sparkSession):
        dealt.mapInArrow(run, "shard int, seq int, before long, doc_ids array<long>, n_ids long, image binary").write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files of write_tokens, ids as unsigned 32-bit
    little-endian integers (binary), left out without `with_ids`; start counts the ids of all documents before it. Null and empty texts have
    their end id only; repeated rows are read as often as they were written; files of an empty table give an empty result."""
    files = spark.read.parquet(path)
    sums = kept(files.groupBy("shard").agg(F.sum("n_ids").alias("n")), "token-shards")
    # one row a range of documents: the window over all of them is small, and so is what is sent to the tasks
    bases = sums.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if sums.count() <= BROADCAST_SHARDS else bases

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pydict()
                lengths, values = from_image(b["image"][0])
                raw = memoryview(values.astype("<u4").tobytes())
                to = np.cumsum(lengths)
                at = to - lengths
                for j in range(0, len(lengths), 512):
                    ids = [raw[4 * x : 4 * y] for x, y in zip(at[j : j + 512].tolist(), to[j : j + 512].tolist(), strict=True)]
                    crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                    cols = [pa.array(b["doc_ids"][0][j : j + 512], pa.int64()), pa.array(at[j : j + 512] + b["start"][0]), pa.array(lengths[j : j + 512]), crc]
                    yield pa.record_batch(cols + ([pa.array(map(bytes, ids), pa.binary())] if with_ids else []), names)

    rows = files.join(bases, "shard").select("doc_ids", "image", (F.col("base") + F.col("before")).alias("start"))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
