"""Connected components by contraction, for link sets of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept


def _links(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Each link once, smaller end first, without loops or null ends."""
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long), component being the smallest node reachable.

    Each round points every node at its smallest neighbour, contracts the graph along these pointers and drops loops and
    repeats, so the graph shrinks fast. A hub costs no more than its rows: minima are combined before the shuffle, and the
    joins are plain ones between kept tables, which AQE can split. Links with a null end and loops are ignored; an empty
    input gives an empty result.
    """
    graph = kept(_links(edges.select("a", "b"), F.col("a"), F.col("b")), "edges")
    labels = None
    for _ in range(rounds):
        if graph.isEmpty():
            break
        both = graph.union(graph.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        parents = kept(lowest.select(F.col("a").alias("node"), F.least("a", "low").alias("parent")), "parents")
        moved = graph.join(parents.toDF("a", "a_up"), "a").join(parents.toDF("b", "b_up"), "b")
        graph = kept(_links(moved, F.col("a_up"), F.col("b_up")), "edges")
        if labels is None:
            labels = parents.toDF("node", "component")
        else:
            next_ = labels.join(parents.toDF("component", "parent"), "component", "left")
            labels = kept(next_.select("node", F.coalesce("parent", "component").alias("component")), "labels")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels if labels is not None else graph.toDF("node", "component")
