"""The nearest vectors of each of a stated set of queries, by cosine, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(lists.flatten(), np.float64).reshape(len(lists), dim)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def top_cosine(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, block: int = 1024) -> DataFrame:
    """(qid, vec_id, score, rank_order): the k vectors (vec_id, embedding) nearest to each query (qid, embedding), without itself: the highest cosine,
    rounded to `digits`, and the lower id of equals.

    Queries are taken `block` at a time (a hash of the id decides); a block goes to the tasks as a matrix, which is multiplied
    with each batch of vectors; a task keeps k candidates a query and returns these, and a window ranks them. Vectors that are null, hold nulls
    or have another length than the query match nothing; a vector of zeros has a cosine of 0.
    """
    good = lambda df, i: df.filter(F.col(i).isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())).select(i, F.col("embedding").cast("array<double>").alias("embedding"))
    asked, rows = good(queries, "qid"), good(vectors, "vec_id")
    blocks = max(1, -(-asked.count() // block))
    out = None

    def search(qid: np.ndarray, matrix: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, scores = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))
            for whole in batches:
                fits = whole.filter(pc.equal(pc.list_value_length(whole.column("embedding")), matrix.shape[1]))
                for b in (fits.slice(i, 2048) for i in range(0, fits.num_rows, 2048)):
                    new = np.asarray(b.column("vec_id"), np.int64)
                    got = np.round(matrix @ _unit(b.column("embedding"), matrix.shape[1]).T, digits)
                    got[qid[:, None] == new] = -np.inf
                    ids, scores = np.concatenate([ids, np.broadcast_to(new, got.shape)], axis=1), np.concatenate([scores, got], axis=1)
                    best = np.lexsort((ids, -scores), axis=-1)[:, :k]
                    ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
            at = np.nonzero(scores > -np.inf)
            yield pa.record_batch([pa.array(qid[at[0]]), pa.array(ids[at]), pa.array(scores[at] + 0.0)], ["qid", "vec_id", "score"])

        return run

    for n in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n).orderBy("qid").collect()
        for dim in sorted({len(r.embedding) for r in mine}):
            some = [r for r in mine if len(r.embedding) == dim]
            matrix = _unit(pa.array([r.embedding for r in some], pa.list_(pa.float64())), dim)
            found = rows.mapInArrow(search(np.array([r.qid for r in some], np.int64), matrix), "qid long, vec_id long, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.limit(0).select(F.col("vec_id").alias("qid"), "vec_id", F.lit(0.0).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank_order", F.row_number().over(order)).filter(F.col("rank_order") <= k)
