"""Product codes of vectors in integers: Lloyd's rounds with a lower bound for each group of codebook entries (Yinyang)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept, removed, small_batches

#: Components beyond this are held at it, so that squared distances of parts fit 64 bits (x of about 131,072 at a scale of 4,096).
MOST = 1 << 29
FAR = np.iinfo(np.int64).max
#: Room for rounding in square roots, which are compared as doubles; distances themselves are compared as integers.
SLACK = 1e-12


@dataclass
class Codebook:
    """Entries of each part as integer rows; their groups, and how far each group's entries moved in the last update."""

    entries: list[np.ndarray]
    groups: list[np.ndarray]
    drift: list[np.ndarray] | None = None

    @staticmethod
    def first(rows: np.ndarray, parts: int, group_of: int = 4) -> Codebook:
        bounds = [rows.shape[1] * p // parts for p in range(parts + 1)]
        entries = [rows[:, a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return Codebook(entries, [grouped(e, -(-len(rows) // group_of)) for e in entries])

    @property
    def dim(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def moved(self, totals: dict[int, int]) -> Codebook:
        """The book after an update. totals: by slot, see `slots`."""
        entries, drift, at = [], [], 0
        for e, g in zip(self.entries, self.groups, strict=True):
            width = e.shape[1] + 1
            new = e.copy()
            for i in range(len(e)):
                count = totals.get(at + i * width, 0)
                if count:
                    new[i] = [totals.get(at + i * width + 1 + j, 0) // count for j in range(e.shape[1])]
            at += len(e) * width
            far = np.sqrt(((new - e) ** 2).sum(axis=1)) * (1 + SLACK)
            entries.append(new)
            drift.append(np.array([far[g == k].max(initial=0) for k in range(g.max() + 1)]))
        return Codebook(entries, self.groups, drift)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each entry, by a few rounds of Lloyd's over the entries; any grouping gives right results."""
    centres = entries[:groups].astype(float)
    for _ in range(rounds):
        of = ((entries[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (of == g).any():
                centres[g] = entries[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        gap = x[:, j, None] - entries[:, j]
        out += gap * gap
    return out


def nearest(x: np.ndarray, entries: np.ndarray, groups: np.ndarray, drift: np.ndarray | None = None, old: np.ndarray | None = None, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance, bounds, distances computed) of each row of x: the nearest entry, the lower index of equals.

    bounds: for each group, no entry of it but the row's own is nearer. Given the last entry and bounds, only groups whose bound
    less the drift does not exceed the distance to the last entry are scanned; in these and there, integers decide.
    """
    n, every, n_groups = len(x), np.arange(len(x)), groups.max() + 1
    gaps = np.full((n, len(entries)), FAR)
    scanned = np.ones((n, n_groups), bool)
    work = 0
    if old is None:
        low = np.full((n, n_groups), np.inf)
    else:
        own = ((x - entries[old]) ** 2).sum(axis=1)
        gaps[every, old] = own
        low = low.astype(float) - drift
        scanned = low <= (np.sqrt(own) * (1 + SLACK) + SLACK)[:, None]
        work += n
    for g in range(n_groups):
        rows, of = np.nonzero(scanned[:, g])[0], np.nonzero(groups == g)[0]
        if len(rows):
            gaps[rows[:, None], of] = squared(x[rows], entries[of])
            work += len(rows) * len(of)
    new = gaps.argmin(axis=1)
    best = gaps[every, new]
    gaps[every, new] = FAR
    second = np.stack([gaps[:, groups == g].min(axis=1) for g in range(n_groups)], axis=1)
    root = np.where(second == FAR, np.inf, np.sqrt(second) * (1 - SLACK))
    return new, best, np.where(scanned, root, np.minimum(low, root)), work


def lower(bounds: np.ndarray) -> np.ndarray:
    """As 32-bit floats, none above the 64-bit value."""
    return np.nextafter(bounds.astype(np.float32), np.float32(-np.inf))


def integers(lists: pa.Array, dim: int, scale: int) -> np.ndarray:
    x = np.asarray(lists.flatten(), np.float64).reshape(len(lists), dim)
    return np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _rows(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _assign(book: Codebook, scale: int, last: bool):
    """Rows with their code and bounds, and at the end of a task its sums: slot and total in rows of their own."""
    parts, n_groups = len(book.entries), max(g.max() + 1 for g in book.groups)
    widths = [e.shape[1] + 1 for e in book.entries]
    starts = np.cumsum([0, *(len(e) * w for e, w in zip(book.entries, widths, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(starts[-1], np.int64)
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                fits = pc.equal(pc.list_value_length(batch.column("embedding")), book.dim)
                other, batch = batch.filter(pc.invert(fits)), batch.filter(fits)
                n = batch.num_rows
                x = integers(batch.column("embedding"), book.dim, scale)
                code, low = np.zeros((n, parts), np.uint8), np.full((n, parts, n_groups), np.inf, np.float32)
                if book.drift is not None:
                    old, was = _rows(batch.column("code"), np.uint8, (parts,)), _rows(batch.column("bounds"), np.float32, (parts, n_groups))
                error, at = np.zeros(n, np.int64), 0
                for p, (entries, groups) in enumerate(zip(book.entries, book.groups, strict=True)):
                    of = groups.max() + 1
                    piece = np.ascontiguousarray(x[:, at : at + entries.shape[1]])
                    state = () if book.drift is None else (book.drift[p], old[:, p], was[:, p, :of])
                    new, best, bounds, _ = nearest(piece, entries, groups, *state)
                    code[:, p], low[:, p, :of] = new, lower(bounds)
                    error += best
                    sums = np.zeros((len(entries), widths[p]), np.int64)
                    np.add.at(sums, new, np.concatenate([np.ones((n, 1), np.int64), piece], axis=1))
                    totals[starts[p] : starts[p + 1]] += sums.ravel()
                    at += entries.shape[1]
                ids = [batch.column("vec_id"), batch.column("label")]
                if last:
                    yield pa.record_batch([*ids, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
                    yield pa.record_batch([other.column("vec_id"), other.column("label"), pa.nulls(len(other), pa.string()), pa.nulls(len(other), pa.int64())], ["vec_id", "label", "code", "error"])
                else:
                    for part, c, b in ((batch, _binary(code), _binary(low)), (other, pa.nulls(len(other), pa.binary()), pa.nulls(len(other), pa.binary()))):
                        none = pa.nulls(len(part), pa.int64())
                        yield pa.record_batch([part.column("vec_id"), part.column("label"), part.column("embedding"), c, b, none, none], NAMES)
        used = np.nonzero(totals)[0]
        if len(used) and not last:
            like = lambda kind: pa.nulls(len(used), kind)
            yield pa.record_batch([like(pa.int64()), like(batch.schema.field("label").type), like(batch.schema.field("embedding").type), like(pa.binary()), like(pa.binary()), pa.array(used), pa.array(totals[used])], NAMES)

    return run


NAMES = ["vec_id", "label", "embedding", "code", "bounds", "slot", "total"]


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector without null or non-finite components.

    A component x is floor(scale * x), and vectors are cut into `parts` consecutive parts. A part's codebook begins as that part
    of the first vectors by id (then by their components); a round assigns every part to its nearest entry and moves entries to
    the floor of their parts' means. Entries are bounded (parts * entries rows), so the book goes with the tasks; vectors are
    never shuffled. A round writes each vector with its code and a bound for each group of entries as a table in the shared
    folder, then deletes the table before. A task's sums are rows of that same table, so each counts once however often a task runs.

    Rows with a null vector are dropped, as are those with null, NaN or infinite components. Fewer vectors than entries make a
    smaller book, an empty table an empty result. Vectors of another length than the first one have no code: their code and
    error are null. Components beyond 2^29 count as 2^29, since distances are 64-bit integers. Lengths that `parts` does not divide are cut as
    evenly as can be. Repeated rows and null ids (last in order) are coded like others; equal distances go to the lower index.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    rows = rows.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    kind = dict(rows.dtypes)
    ahead = [r.embedding for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    if not ahead:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    ahead = [e for e in ahead if len(e) == len(ahead[0])]
    book = Codebook.first(np.clip(np.floor(np.array(ahead, np.float64).reshape(len(ahead), -1) * scale), -MOST, MOST).astype(np.int64), parts)
    table = rows
    with small_batches(spark):
        for _ in range(rounds):
            shape = f"vec_id long, label {kind['label']}, embedding {kind['embedding']}, code binary, bounds binary, slot long, total long"
            new = kept(table.mapInArrow(_assign(book, scale, last=False), shape), "vector-codes")
            if table is not rows:
                removed(spark, table)
            sums = new.filter("slot is not null").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
            book = book.moved({r.slot: int(r.total) for r in sums.collect()})
            table = new.filter("slot is null").drop("slot", "total")
        out = kept(table.mapInArrow(_assign(book, scale, last=True), f"vec_id long, label {kind['label']}, code string, error long"), "vector-codes")
        if table is not rows:
            removed(spark, table)
    per_label = kept(out.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    named = out.join(per_label, out["label"].eqNullSafe(per_label["of"]))
    return named.select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


def sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same result in DuckDB, each round as tables of its own, every distance computed."""
    steps = [
        "k as (select *, row_number() over (order by vec_id) - 1 rn, len(embedding) // " + str(parts) + " d from embeddings where embedding is not null"
        " and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)",
        f"x as materialized (select vec_id, label, rn, p, list_transform(embedding[p * d + 1:p * d + d], lambda v: floor({scale} * v::double)::bigint) a from k, range({parts}) t(p))",
        f"c0 as materialized (select p, rn e, a from x where rn < {entries})",
    ]
    for r in range(rounds + 1):
        gap = "list_sum(list_transform(list_zip(x.a, c.a), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{r} as materialized (select vec_id, label, p, min({gap} * {entries} + e) m, any_value(x.a) a from x join c{r} c using (p) group by 1, 2, 3)")
        if r < rounds:
            steps.append(f"s{r} as (select p, (m % {entries}) e, pos, sum(v) s, count(*) n from (select p, m, unnest(a) v, generate_subscripts(a, 1) pos from a{r}) group by 1, 2, 3)")
            steps.append(f"c{r + 1} as materialized (select c.p, c.e, coalesce(n.a, c.a) a from c{r} c left join (select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by pos) a from s{r} group by 1, 2) n on c.p = n.p and c.e = n.e)")
    steps.append(f"o as (select vec_id, label, string_agg(printf('%02x', (m % {entries})::bigint), '' order by p) code, sum(m // {entries})::bigint error from a{rounds} group by 1, 2)")
    digest = f"(select sha256(string_agg(array_to_string(a, ','), ',' order by p, e)) from c{rounds})"
    return "with " + ",\n".join(steps) + f"\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, {digest} codebooks_sha256 from o"


SQL = sql()
