"""Connected components by alternating large-star and small-star.

Rows are pairs of longs, so a hub's task is small until a hub has tens of millions of
neighbours; beyond, adaptive execution splits its partition in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small


def _to_minimum(edges: DataFrame) -> DataFrame:
    """Each row (u, v) with m, the least of u and its neighbours in v."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of that node's neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are tied to the least of them."""
    tied = _to_minimum(edges)
    down = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionAll(tied.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v): each node that is not the least of its component with the least one.

    Edges are pairs of longs; loops and repeats are dropped, and nodes without an
    edge don't appear. Each step writes a table, so lineage stays short, and the
    loop ends when a pass of both steps leaves the edges as they were.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = scratch.keep(e, f"{name}-0")
    sign = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, step = sign(e), 0
    while before[0]:
        step += 1
        e = scratch.keep(small_star(large_star(e)), f"{name}-{step}")
        after = sign(e)
        scratch.drop(f"{name}-{step - 1}")
        if after == before:
            break
        before = after
    return e


def merged_components(stars: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """stars, as connected_components returns them, after new edges (a, b): only edges between components are walked again."""
    if edges.isEmpty():
        return stars
    ends = edges
    for end, as_ in (("a", "u"), ("b", "v")):
        now = stars.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
        ends = ends.join(now, F.col(end) == F.col("_u"), "left").withColumn(as_, F.coalesce("_v", end)).drop("_u", "_v")
    found = connected_components(ends.select("u", "v"), scratch, name)
    moved = found.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return scratch.keep(stars.join(broadcast_if_small(moved), F.col("v") == F.col("_u"), "left").select("u", F.coalesce("_v", "v").alias("v")).unionAll(found), f"{name}-stars")
