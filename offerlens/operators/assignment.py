"""One-to-one assignment: the pairs that a greedy walk over all edges in order would take, found in rounds of joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept, removed


def greedy_one_to_one(edges: DataFrame, left: Sequence[str], right: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The edges that a walk in the order of the columns `order` takes if each left and each right node is taken once.

    An edge that comes first among the edges left at both its ends is taken whatever else the walk does, so a round takes all of
    these at once and drops the edges at their ends; rounds go on until no edge is left. Firsts are minima, combined before the
    shuffle, so no node's edges come together in one task. Equal edges count once; the order decides between all
    others, so it has to be total. Edges with a null end are left out; an empty table gives an empty result. The ends may have columns in common
    (a group that assigns apart): then rounds go on within the groups, see `_in_groups`.
    """
    if set(left) & set(right):
        return _in_groups(edges, left, right, order)
    ends = list(dict.fromkeys([*left, *right]))
    columns = edges.columns
    key, rest = F.struct(*order).alias("first"), [c for c in columns if c not in ends]
    live = kept(edges.dropna(subset=ends).distinct(), "edges")
    taken = live.limit(0)
    while not live.isEmpty():
        by_left = live.groupBy(*left).agg(F.min(key).alias("first"))
        by_right = live.groupBy(*right).agg(F.min(key).alias("first"))
        now = live.withColumn("first", F.struct(*order)).join(by_left, [*left, "first"]).join(by_right, [*right, "first"])
        now = kept(now.groupBy(*ends, "first").agg(*(F.first(c).alias(c) for c in rest)).select(*columns), "taken")
        left_over = kept(live.join(now.select(*left), list(left), "left_anti").join(now.select(*right), list(right), "left_anti"), "edges")
        taken = taken.unionByName(now)
        removed(live)
        live = left_over
    return taken


def _in_groups(edges: DataFrame, left: Sequence[str], right: Sequence[str], order: Sequence[str], rounds: int = 2) -> DataFrame:
    """The same where groups assign apart. Edges that lie dealt by the group's columns stay where they are: windows over the ends need no shuffle
    then, and `rounds` rounds go on in one plan, before anything is written. What they leave is dealt by group and goes on."""
    group, columns = [c for c in left if c in right], edges.columns
    by_left, by_right, key = Window.partitionBy(*left), Window.partitionBy(*right), F.struct(*order)
    live = edges.dropna(subset=list(dict.fromkeys([*left, *right]))).distinct()
    taken = None
    while True:
        state = live.withColumn("__taken", F.lit(False))
        for _ in range(rounds):
            still = F.when(~F.col("__taken"), key)
            state = state.withColumn("__left", F.min(still).over(by_left)).withColumn("__right", F.min(still).over(by_right))
            state = state.withColumn("__now", ~F.col("__taken") & (key == F.col("__left")) & (key == F.col("__right"))).drop("__left", "__right")
            state = state.withColumn("__gone", F.max("__now").over(by_right)).withColumn("__gone", F.col("__gone") | F.max("__now").over(by_left))
            state = state.withColumn("__taken", F.col("__taken") | F.col("__now")).filter("__taken or not __gone").drop("__now", "__gone")
        state = kept(state, "edges")
        now = state.filter("__taken").select(*columns)
        taken = now if taken is None else taken.unionByName(now)
        live = state.filter("not __taken").select(*columns)
        if live.isEmpty():
            return taken
        live = live.repartition(*group)


def without_ties(edges: DataFrame, node: Sequence[str], other: Sequence[str], score: str) -> DataFrame:
    """Edges of nodes whose highest score goes to one other node only."""
    of, item = Window.partitionBy(*node), F.struct(*other)
    known = lambda names: reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names))
    best = edges.withColumn("__top", F.max(score).over(of))
    at = F.when((F.col(score) == F.col("__top")) & known(other), item)
    best = best.withColumn("__low", F.min(at).over(of)).withColumn("__high", F.max(at).over(of))
    tied = F.coalesce(F.col("__low") != F.col("__high"), F.lit(False)) & known(node)
    return best.filter(~tied).drop("__top", "__low", "__high")
