"""Overlapping chunks of long texts, for retrieval."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = re.compile(r"\s+")


def spans(text: str, size: int = 1500, overlap: int = 200, least: int = 120) -> list[tuple[int, int, str]]:
    """(start, end, piece) over a text whose white space is single spaces.

    All places behind a space are listed once, and a search in them finds how far the chunk that begins at a place reaches: to the last of them
    within its size, or through a word if that is too near to its start. A chunk begins `overlap` characters before the end of the one
    before. Pieces shorter than `least` are left out, and so are texts.
    """
    size, n = max(least, size), len(text)
    back = max(0, min(overlap, size // 2))
    places = [m.end() for m in re.finditer(" ", text)]

    def reach(start: int) -> int:
        most = start + size
        behind = bisect.bisect_right(places, most)
        place = places[behind - 1] if behind else 0
        return n if most >= n else place if place > start + least // 2 else most

    bounds = [(0, reach(0))] if n >= least else []
    while bounds and bounds[-1][1] < n:
        low, high = bounds[-1]
        start = max(high - back, low + 1)
        start += text[start] == " "
        bounds.append((start, reach(start)))
    pieces = ((low, high, text[low:high].strip()) for low, high in bounds)
    return [p for p in pieces if len(p[2]) >= least]


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int = 1500, overlap: int = 200, least: int = 120) -> DataFrame:
    """(id, chunk_index, char_start, char_end, token_estimate, text_hash, text): a row a chunk; null and short texts have none.

    Where a cut falls depends on the one before, so a text is cut inside its task; equal chunks of a document count once, and the
    index runs over those that stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 64):  # a few texts at a time, so that memory follows the texts and not the batch
                part, found = b.slice(low, 64), []
                for i in range(part.num_rows):
                    seen: set[str | bytes] = set()
                    for start, end, piece in spans(SPACES.sub(" ", part.column(1)[i].as_py() or "").strip(), size, overlap, least):
                        key = piece if len(piece) < 32 else hashlib.sha256(piece.encode("utf-8", "surrogatepass")).digest()
                        if key not in seen:
                            found.append((i, len(seen), start, end, piece))
                            seen.add(key)
                        if len(found) == 512:
                            yield batch(part.column(0), found)
                            found = []
                if found:
                    yield batch(part.column(0), found)

    def batch(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True))
        return pa.record_batch([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string())], [id_col, "chunk_index", "char_start", "char_end", "text"])

    narrow = docs.select(id_col, F.col(text_col).alias("text"))
    rows = narrow.mapInArrow(run, f"{id_col} {dict(narrow.dtypes)[id_col]}, chunk_index long, char_start long, char_end long, text string")
    return rows.select(id_col, "chunk_index", "char_start", "char_end", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("token_estimate"), F.sha2("text", 256).alias("text_hash"), "text")


def new_chunks(now: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of `now` that `stored` has neither at their place with their text nor elsewhere in the document."""
    return now.join(stored.select(key, "text_hash").distinct(), [key, "text_hash"], "left_anti")


def upserted(stored: DataFrame, now: DataFrame, key: str = "doc_id") -> DataFrame:
    """`stored` after `now`: a chunk that stands elsewhere in the document is skipped, others replace what has their place."""
    new = new_chunks(now, stored, key).select(*stored.columns)
    return stored.join(new.select(key, "chunk_index"), [key, "chunk_index"], "left_anti").select(*stored.columns).unionByName(new)
