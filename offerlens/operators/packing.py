"""Batches of fragments in order under a limit of tokens and one of fragments, for cases of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold

#: Place of fragments whose document or chunk has no number: after all others.
NO_DOCUMENT, NO_CHUNK = 2**31 - 1, 2**63 - 1


def fragment_place(document: Column, chunk: Column, fragment: Column) -> list[Column]:
    """Columns to order fragments by: document, chunk, id. What is no number goes last."""
    whole = lambda c, none: F.coalesce(c.cast("string").try_cast("long"), F.lit(none).cast("long"))
    return [whole(document, NO_DOCUMENT), whole(chunk, NO_CHUNK), fragment]


def _ends(tokens: np.ndarray, limit: int, most: int) -> np.ndarray:
    """For each fragment, the number of the first one that a batch beginning with it no longer holds; a fragment over the limit is a batch alone."""
    total = np.concatenate([[0], tokens.cumsum()])
    at = np.arange(len(tokens))
    fits = np.searchsorted(total, total[:-1] + limit, side="right") - 1
    return np.maximum(np.minimum(fits, at + most), at + 1)


def _first_start(tokens: np.ndarray, limit: int, most: int, used: int, held: int) -> int:
    """The first fragment that does not go into a batch that holds `held` fragments of `used` tokens already."""
    if not held:
        return 0
    total = np.concatenate([[0], tokens.cumsum()])
    return int(max(0, min(np.searchsorted(total, limit - used, side="right") - 1, most - held, len(tokens))))


def packed(fragments: DataFrame, case: str, order: list[str], tokens: str, limit: int, most: int) -> DataFrame:
    """Each fragment (case, order..., tokens) with `batch` (from 1), `batch_tokens_before` and `oversized`: fragments fill a batch in order
    until the next one would exceed `limit` tokens or `most` fragments; one that exceeds the limit alone is a batch of its own.

    A stretch of a case knows where each batch that begins in it ends. What enters a stretch is an open batch, and all that
    matters of it is where the first new one begins: within the first `most` fragments. For each such place the stretch tells how
    many batches follow and what it leaves open; composing that along a case's stretches needs none of its fragments, so a case of
    millions of fragments is spread over tasks. Null tokens count as 0, negative ones too.
    """
    value = lambda run: np.maximum(np.asarray(run.column(tokens).fill_null(0).combine_chunks(), np.int64), 0)

    def summarise(run: pa.Table) -> tuple[np.ndarray, dict[int, tuple[int, int, int]], int, int]:
        t = value(run)
        ends = _ends(t, limit, most)
        n = len(t)
        batches, left, held = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        total = np.concatenate([[0], t.cumsum()])
        for i in range(n - 1, -1, -1):  # from the back, so that no walk is made twice
            e = int(ends[i])
            batches[i], left[i], held[i] = (1, total[n] - total[i], n - i) if e >= n else (batches[e] + 1, left[e], held[e])
        after = {i: (int(batches[i]), int(left[i]), int(held[i])) for i in range(min(n, most + 1))}
        return t[: most + 1], after, n, int(total[n])

    def advance(state: tuple[int, int, int], described: tuple) -> tuple[int, int, int]:
        number, used, held = state
        head, after, n, total = described
        start = _first_start(head, limit, most, used, held)
        if start >= n:
            return number, used + total, held + n
        batches, left, kept = after[start]
        return number + batches, left, kept

    def replay(run: pa.Table, state: tuple[int, int, int]) -> pa.Table:
        t = value(run)
        number, used, held = state
        start = _first_start(t, limit, most, used, held)
        ends = _ends(t, limit, most)
        batch, before = np.full(len(t), number, np.int64), np.zeros(len(t), np.int64)
        before[:start] = used + np.concatenate([[0], t[:start].cumsum()])[:start]
        while start < len(t):
            e, number = int(ends[start]), number + 1
            batch[start:e] = number
            before[start:e] = np.concatenate([[0], t[start:e].cumsum()])[: len(t[start:e])]
            start = e
        return run.append_column("batch", pa.array(batch)).append_column("batch_tokens_before", pa.array(before)).append_column("oversized", pa.array(t > limit))

    rows = fragments.select(case, *order, F.col(tokens).cast("long").alias(tokens))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", batch long, batch_tokens_before long, oversized boolean"
    return ordered_fold(rows, case, order, summarise, advance, (0, 0, 0), replay, schema)
