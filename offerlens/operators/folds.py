"""Folds over the ordered rows of a key, cut into ranges: a key of any size is spread over many tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import kept


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        at = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, key in enumerate(at):
            if key != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        if len(at) > start:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def by_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], body: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """body over the rows of each combination of keys, in order. Rows are streamed, so a task holds one combination at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, keys):
            yield from body(rows).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def ordered_fold(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    summarise: Callable[[pa.Table], Any],
    advance: Callable[[Any, Any], Any],
    first: Any,
    replay: Callable[[pa.Table, Any], pa.Table],
    schema: str,
) -> DataFrame:
    """What a fold over each key's rows in order gives, row by row, without one task for a key.

    Rows are sorted into ranges of (key, order), and a key's part of a range is a segment. `summarise` describes what a segment does
    to any state it may begin with; `advance` applies such a description to a state; with these the state at the start of each
    segment follows from `first` along the key's few segments. `replay` then walks a segment from its state. Keys within one range, nearly
    all of them, are only replayed. The order has to be total for results that do not vary; rows with a null key are a key of their own.
    """
    parts = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("part", F.spark_partition_id())
    table = kept(parts, "ranges")
    spread = table.groupBy(key).agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select(F.col(key).alias("wide"))
    name = dict(rows.dtypes)[key]
    wide = table.join(spread, table[key].eqNullSafe(spread["wide"]), "left_semi")

    def described(run: pa.Table) -> pa.Table:
        one = run.slice(0, 1)
        return pa.table([one.column(key), one.column("part"), pa.array([pickle.dumps(summarise(run))], pa.binary())], names=[key, "part", "summary"])

    def walked(run: pa.Table) -> pa.Table:
        state, starts = first, []
        for s in run.column("summary").to_pylist():
            starts.append(pickle.dumps(state))
            state = advance(state, pickle.loads(s))
        return pa.table([run.column(key), run.column("part"), pa.array(starts, pa.binary())], names=[key, "part", "start"])

    summaries = by_run(wide, [key, "part"], order, described, f"{key} {name}, part int, summary binary")
    starts = kept(by_run(summaries, [key], ["part"], walked, f"{key} {name}, part int, start binary"), "starts")
    starts = starts.withColumnsRenamed({key: "start_key", "part": "start_part"})
    at = table.join(starts, table[key].eqNullSafe(starts["start_key"]) & (table["part"] == starts["start_part"]), "left").drop("start_key", "start_part")

    def replayed(run: pa.Table) -> pa.Table:
        start = run.column("start")[0].as_py()
        return replay(run.drop_columns(["start", "part"]), first if start is None else pickle.loads(start))

    return by_run(at, [key, "part"], order, replayed, schema)


def running(rows: DataFrame, key: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """`rows` with the sum of the whole numbers `value` over the key's rows up to and with this one, in order; nulls count as 0."""

    def add(run: pa.Table, before: int) -> pa.Table:
        v = np.asarray(run.column(value).fill_null(0).combine_chunks(), np.int64)
        return run.append_column(name, pa.array(before + v.cumsum()))

    total = lambda run: int(np.asarray(run.column(value).fill_null(0).combine_chunks(), np.int64).sum())
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{name}` long"
    return ordered_fold(rows, key, order, total, lambda a, b: a + b, 0, add, schema)
