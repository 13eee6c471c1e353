"""Matching by a cascade of keys: the first key that decides wins, and a key that several known rows share decides nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _exploded(df: DataFrame, id_: Column, keys: Sequence[Column], extra: Sequence[Column] = ()) -> DataFrame:
    """A row for each key that is neither null nor empty: id, rank of the key, key."""
    pairs = F.array(*(F.struct(F.lit(i).alias("rank"), k.cast("string").alias("key")) for i, k in enumerate(keys)))
    return df.select(id_.alias("id"), *extra, F.explode(pairs).alias("p")).select("id", *(F.col(c) for c in ("at",) if extra), "p.rank", "p.key").filter("key <> ''")


def cascade(asked: DataFrame, asked_id: Column, asked_keys: Sequence[Column], known: DataFrame, known_id: Column, known_keys: Sequence[Column], order: Column, unique: Sequence[bool]) -> DataFrame:
    """(id, known_id, rank) of each asked row that a key decides: of the keys in turn, the first that known rows have.

    Where `unique` says so, a key that more than one known id has is passed over and the next one is tried; elsewhere the first
    known row in `order` is taken. All keys go through one join: both sides are exploded to (rank, key), and known rows are combined to one
    row a key before, so a key that many rows share costs no more than its rows. An array of keys on either side may be exploded by the
    caller. Null and empty keys match nothing; asked rows that share an id count as one with the keys of all.
    """
    held = _exploded(known, known_id, known_keys, [order.alias("at")]).groupBy("rank", "key").agg(F.min(F.struct("at", "id")).alias("first"), (F.min("id") == F.max("id")).alias("single"))
    must = F.element_at(F.array(*(F.lit(u) for u in unique)), F.col("rank") + 1)
    usable = held.filter(~must | F.col("single")).select("rank", "key", F.col("first.id").alias("known_id"))
    met = _exploded(asked, asked_id, asked_keys).join(usable, ["rank", "key"])
    return met.groupBy("id").agg(F.min(F.struct("rank", "known_id")).alias("best")).select("id", F.col("best.known_id").alias("known_id"), F.col("best.rank").alias("rank"))
