"""Embedding near-duplicates: a subspace pigeonhole join of rotated unit vectors, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .simhash import forest
from .storage import kept

#: Rounding allowed for in distances; every candidate is verified from the vectors themselves.
SLACK = 1e-9


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A fixed random orthogonal matrix; it spreads a difference evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int, blocks: int) -> np.ndarray:
    return np.unique(np.linspace(0, dim, min(blocks, dim) + 1).astype(int))


def valid(vectors: DataFrame) -> DataFrame:
    """Rows with an id, a label and a vector that has a direction: no null, infinite or NaN component, not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(fine & F.exists("embedding", lambda x: x != 0))


def placed(classes: DataFrame, least: float, blocks: int, grid: int) -> DataFrame:
    """Each vector in each block: in its own cell of a grid over the block's first coordinates, and as a visitor in half of the
    cells around, so that any two vectors in reach of each other meet in exactly one cell of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                lists = batch.column("embedding").to_pylist()
                for dim in {len(x) for x in lists}:
                    at = [i for i, x in enumerate(lists) if len(x) == dim]
                    x = np.array([lists[i] for i in at], np.float64)
                    turn = turns.setdefault(dim, rotation(dim))
                    y = unit(x) @ turn
                    part, bounds = batch.take(pa.array(at)), block_bounds(dim, blocks)
                    for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        reach = np.sqrt((2 - 2 * least) * (hi - lo) / dim * (1 + SLACK)) * (1 + 1e-6) + 1e-12
                        cell = np.floor(y[:, lo : min(hi, lo + grid)] / reach).astype(np.int64)
                        for shift in product((-1, 0, 1), repeat=cell.shape[1]):
                            if shift > (0,) * len(shift):
                                continue
                            names = ["_".join(map(str, c)) for c in (cell + np.array(shift)).tolist()]
                            n, home = len(at), not any(shift)
                            cols = [pa.array([dim] * n, pa.int32()), pa.array([b] * n, pa.int32()), pa.array(names), pa.array([home] * n), *(part.column(c) for c in ("label", "low", "n", "embedding"))]
                            yield pa.record_batch(cols, ["dim", "block", "cell", "home", "label", "low", "n", "embedding"])

    kind = dict(classes.dtypes)
    rows = classes.select("label", "low", "n", "embedding")
    return rows.mapInArrow(run, f"dim int, block int, cell string, home boolean, label {kind['label']}, low long, n long, embedding {kind['embedding']}")


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _tile_links(least: float, blocks: int):
    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        dim, block, i, j = int(key[0]), int(key[1]), int(key[4]), int(key[5])
        u = unit(np.array(t["embedding"].tolist(), np.float64).reshape(len(t), dim))
        y, bounds = u @ rotation(dim), block_bounds(dim, blocks)
        budgets = (2 - 2 * least) * np.diff(bounds) / dim * (1 + SLACK) + 1e-12
        z = np.ascontiguousarray(y[:, bounds[block] : bounds[block + 1]])
        norm, home, tile = (z * z).sum(axis=1), t["home"].to_numpy(), t["tile"].to_numpy()
        n, low = t["n"].to_numpy(), t["low"].to_numpy()
        left, right = np.nonzero(tile == i)[0], np.nonzero(tile == j)[0]
        count = np.zeros(len(t), np.int64)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for s in range(0, len(left), 512):
                a = left[s : s + 512]
                near = norm[a, None] + norm[right] - 2 * (z[a] @ z[right].T) <= budgets[block] + 1e-7
                near &= home[a, None] | home[right]
                if i == j:
                    near &= a[:, None] < right
                p, q = np.nonzero(near)
                for c in range(0, len(p), 1 << 15):
                    x, w = a[p[c : c + (1 << 15)]], right[q[c : c + (1 << 15)]]
                    x, w = (v[np.einsum("ij,ij->i", u[x], u[w]) >= least] for v in (x, w))
                    gap = np.add.reduceat((y[x] - y[w]) ** 2, bounds[:-1], axis=1) if len(x) else np.zeros((0, len(budgets)))
                    first = (gap <= budgets).argmax(axis=1) == block
                    x, w = x[first], w[first]
                    np.add.at(count, x, n[w])
                    np.add.at(count, w, n[x])
                    yield x, w

        root = forest(len(t), found())
        tied = np.nonzero(count)[0]
        return pd.DataFrame({"a": low[tied], "b": low[root[tied]], "count": count[tied]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, blocks: int = 4, grid: int = 2, tile: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector: links are pairs with equal labels and a cosine of at least `least`.

    Unit vectors link if their squared distance is at most 2 - 2 * least. If so, some block of the rotated coordinates has at
    most its share of that, so joining each block within its share finds every link; the pair counts in the first such block,
    after its cosine is verified. Equal vectors are joined once, as a class. A cell with many vectors is cut into tiles, and each
    pair of tiles is a group of its own: no group holds more than two tiles. Groups return counts and a spanning forest.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id, link with
    nothing. Vectors of different lengths never link. Repeated rows count as vectors. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    good = valid(rows)
    classes = kept(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")), "vector-classes")
    at = placed(classes, least, blocks, grid)
    cell = ["dim", "block", "label", "cell"]
    sizes = kept(at.groupBy(*cell).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "vector-cells")
    tiled = at.join(sizes, cell).withColumn("tile", F.pmod(F.xxhash64("low"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    groups = tiled.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    found = kept(groups.groupBy(*cell, "i", "j").applyInPandas(_tile_links(least, blocks), "a long, b long, count long"), "vector-links")
    counts = found.groupBy(F.col("a").alias("low")).agg(F.sum("count").alias("links"))
    named = components(found).toDF("low", "component")
    of = classes.join(counts, "low", "left").join(named, "low", "left").select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    linked = good.join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    ok = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    alone = rows.filter(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ok)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
