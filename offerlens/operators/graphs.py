"""Trees and graphs as tables of edges: roots and ancestors by pointer doubling, and the nodes that lie on cycles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import kept, removed


def _doubled(at: DataFrame) -> DataFrame:
    """Each node's pointer after twice as many steps: (node, up, steps), up being null past the end of the pointers."""
    on = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
    return at.join(on.hint("merge"), "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))


def roots(parents: DataFrame) -> DataFrame:
    """(node, root, depth, on_cycle) of every node of `parents` (node, parent), a node having one parent at most.

    A node without a parent, or whose parent has none or no row, leads to a root; the depth is the number of steps to it. Nodes
    that lead into a cycle have null root and depth, and on_cycle says whether they lie on it. Pointers double in each round, so
    a chain of n nodes takes about log2(n) rounds; after that many steps only cycles still move, and the pointers into a
    cycle have just its nodes as ends. Joins are by sorting: tables of nodes are not broadcast, which would send them through the driver in each round. Rows with a null node are left out; equal rows count once; an empty table gives an empty result.
    """
    rows = kept(parents.select("node", "parent").filter("node is not null").distinct(), "parents")
    at = kept(rows.filter("parent is not null").select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps")), "pointers")
    size = at.count()
    ends = kept(at.select(F.col("up").alias("end")).distinct().join(at.select(F.col("node").alias("end")).hint("merge"), "end", "left_anti"), "ends")
    for _ in range(max(1, math.ceil(math.log2(size + 1)) + 1)):
        moving = at.join(ends.hint("merge"), at["up"] == ends["end"], "left_anti")
        if moving.isEmpty():
            break
        new = kept(_doubled(at), "pointers")
        removed(at)
        at = new
    settled = at.join(ends.hint("merge"), at["up"] == ends["end"], "left_semi").select("node", F.col("up").alias("root"), F.col("steps").alias("depth"), F.lit(False).alias("on_cycle"))
    loose = at.join(ends.hint("merge"), at["up"] == ends["end"], "left_anti")
    on = loose.select(F.col("up").alias("node")).distinct().withColumn("on", F.lit(True))
    none = F.lit(None).cast(dict(at.dtypes)["node"])
    circling = loose.join(on.hint("merge"), "node", "left").select("node", none.alias("root"), F.lit(None).cast("long").alias("depth"), F.coalesce("on", F.lit(False)).alias("on_cycle"))
    top = rows.select("node").distinct().unionByName(ends.withColumnRenamed("end", "node")).distinct().join(at.select("node").hint("merge"), "node", "left_anti")
    return settled.unionByName(circling).unionByName(top.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("on_cycle")))


def is_ancestor(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs` (ancestor, node) with `holds`: whether a walk from the node up its parents meets the ancestor, itself included.

    The pair holds if the node's ancestor as many steps up as their depths differ is the one asked for; steps are taken by powers
    of two, a join each. Nodes without a row are their own root. False where either leads into a cycle or is null.
    """
    every = kept(roots(parents), "depths")
    depth, loops = every.filter("depth is not null").select("node", "depth"), every.filter("depth is null").select("node")
    one = parents.select("node", F.col("parent").alias("up")).filter("node is not null and parent is not null").distinct()
    asked = pairs.select("ancestor", "node").distinct()
    level = depth.select(F.col("node").alias("ancestor"), F.col("depth").alias("above"))
    known = asked.join(depth, "node", "left").join(level, "ancestor", "left")
    walk = kept(known.select("ancestor", "node", F.col("node").alias("at"), (F.coalesce("depth", F.lit(0)) - F.coalesce("above", F.lit(0))).alias("left")), "walks")
    deepest = depth.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first().d
    jump, k = kept(one, "jumps"), 1
    while k <= deepest:
        step = F.col("left").bitwiseAND(F.lit(k)) != 0
        hop = jump.select(F.col("node").alias("at"), "up")
        new = kept(walk.join(hop, "at", "left").select("ancestor", "node", F.when(step & (F.col("left") > 0), F.col("up")).otherwise(F.col("at")).alias("at"), "left"), "walks")
        removed(walk)
        walk = new
        twice = kept(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")), "jumps")
        removed(jump)
        jump, k = twice, k * 2
    holds = walk.select("ancestor", "node", ((F.col("left") >= 0) & (F.col("at") == F.col("ancestor"))).alias("held"))
    sure = holds.join(loops, "node", "left_anti")
    return pairs.join(sure, ["ancestor", "node"], "left").select(*pairs.columns, F.coalesce("held", F.lit(False)).alias("holds"))


def _peeled(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges whose ends both have edges in and out, however often ends without are dropped; and the rounds that took.

    A chain goes as a whole: where a node has one edge out, pointer doubling finds the end of the chain that begins there, and all
    of it goes if the end has no edge out; likewise backwards. So the rounds grow with the branchings on a path, not its length.
    """
    rounds = 0
    while True:
        before = edges.count()
        if not before:
            return edges, rounds
        for a, b in (("a", "b"), ("b", "a")):
            single = edges.groupBy(a).agg(F.count("*").alias("n"), F.min(b).alias("to")).filter("n = 1").select(F.col(a).alias("node"), F.col("to").alias("parent"))
            found = kept(roots(single).filter("not on_cycle and root is not null").select("node", "root"), "chains")
            final = edges.select(F.col(b).alias("root")).distinct().join(edges.select(F.col(a).alias("root")).distinct(), "root", "left_anti")
            dead = kept(found.join(final, "root", "left_semi").select("node").unionByName(final.withColumnRenamed("root", "node")).distinct(), "dead")
            left = kept(edges.join(dead, edges["a"] == dead["node"], "left_anti").join(dead, edges["b"] == dead["node"], "left_anti"), "edges")
            removed(edges)
            edges = left
        rounds += 1
        if edges.count() == before:
            return edges, rounds


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): the nodes of `edges` (a, b) that lie on a directed cycle, loops included, and the greatest node of the set of
    nodes that reach each other and it.

    What leads to no cycle or comes from none is peeled off first. In the rest, each node takes the greatest node that reaches
    it; the nodes that such a node is reached from among those it marks form its set, which is put out and taken away. Every
    step is a join of edges with node values, and minima and maxima are combined before the shuffle. Rounds grow with the
    longest path within the rest. Edges with a null end are left out; an empty table gives an empty result.
    """
    live = kept(edges.select("a", "b").dropna().distinct(), "edges")
    out = live.limit(0).select(F.col("a").alias("node"), F.col("a").alias("cycle"))
    while True:
        live, _ = _peeled(live)
        if live.isEmpty():
            return out
        mark = kept(live.select(F.col("a").alias("node")).unionByName(live.select(F.col("b").alias("node"))).distinct().withColumn("mark", F.col("node")), "marks")
        while True:
            got = live.join(mark, live["a"] == mark["node"]).groupBy(F.col("b").alias("node")).agg(F.max("mark").alias("got"))
            new = kept(mark.join(got, "node", "left").select("node", F.greatest("mark", F.coalesce("got", "mark")).alias("mark"), (F.col("got") > F.col("mark")).alias("moved")), "marks")
            moved = not new.filter("moved").isEmpty()
            removed(mark)
            mark = new.drop("moved")
            if not moved:
                break
        mark = kept(mark, "marks")
        inner = live.join(mark.select(F.col("node").alias("a"), F.col("mark").alias("a_mark")), "a").join(mark.select(F.col("node").alias("b"), F.col("mark").alias("b_mark")), "b").filter("a_mark = b_mark")
        inner = kept(inner.select("a", "b", F.col("a_mark").alias("mark")), "edges")
        reach = kept(mark.filter("node = mark"), "reach")
        while True:
            more = inner.join(reach.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "mark").distinct().join(reach, ["node"], "left_anti")
            more = kept(more, "reach")
            if more.isEmpty():
                break
            reach = kept(reach.unionByName(more), "reach")
        looped = live.filter("a = b").select(F.col("a").alias("node"))
        many = reach.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark")
        sets = kept(reach.join(many, "mark", "left_semi").select("node", F.col("mark").alias("cycle")).unionByName(reach.join(looped, "node", "left_semi").select("node", F.col("mark").alias("cycle"))).distinct(), "cycles")
        out = out.unionByName(sets)
        gone = reach.select("node")
        live = kept(live.join(gone, live["a"] == gone["node"], "left_anti").join(gone, live["b"] == gone["node"], "left_anti"), "edges")
