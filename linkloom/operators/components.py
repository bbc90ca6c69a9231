"""Graphs that span documents: connected components by alternating stars, and the maximum spanning forest by rounds of best edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.graph import parts_by_doc
from linkloom.operators.lineage import cut

#: Edges that one task joins by itself.
FEW = 1 << 18


def star(edges: DataFrame, inward: bool) -> DataFrame:
    """Edges (u, v) with u > v: each node links its larger neighbours (or, if ``inward``, its smaller ones and itself) to the smallest node it knows."""
    if inward:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge (a, b), whatever the order of its ends; the component is its smallest node. Loops over edges only, each round cut off from the last; no more than ``FEW`` are one task's."""
    edges, before = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()), None
    if edges.count() <= FEW:
        return parts_by_doc(edges.select(F.lit(0).alias("doc"), F.col("u").alias("src"), F.col("v").alias("dst"))).select("node", "component")
    while True:
        edges = cut(star(star(edges, False), True))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of all of ``nodes`` (node); one without an edge is its own component."""
    return nodes.join(connected_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def global_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, affinity): the maximum spanning forest of a graph of any size; ties by src, dst.

    In each round every component takes its best edge to another one, and what these join is one component in the next: at most half as many are left.
    """
    best = F.struct((-F.col("affinity")).alias("d"), "src", "dst", "cu", "cv", "affinity")
    left = cut(edges.select("src", "dst", "affinity", F.col("src").alias("cu"), F.col("dst").alias("cv")).filter("src <> dst"))
    taken = None
    while not left.isEmpty():
        ends = left.select(F.col("cu").alias("c"), best.alias("e")).unionByName(left.select(F.col("cv").alias("c"), best.alias("e")))
        chosen = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        joined = connected_components(chosen.select(F.col("cu").alias("a"), F.col("cv").alias("b")))
        fresh = chosen.select("src", "dst", "affinity")
        taken = fresh if taken is None else taken.unionByName(fresh)
        u, v = (joined.withColumnsRenamed({"node": c, "component": f"{c}2"}) for c in ("cu", "cv"))
        left = left.join(u, "cu", "left").join(v, "cv", "left").select("src", "dst", "affinity", F.coalesce("cu2", "cu").alias("cu"), F.coalesce("cv2", "cv").alias("cv"))
        left = cut(left.filter("cu <> cv"))
    return edges.select("src", "dst", "affinity").limit(0) if taken is None else taken
