"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, keep) -> DataFrame:
    """edges: (u, v). Each v of u's list that keep(u, v, m) admits is linked to m, the least of u and its list. The least is found by partial aggregation and joined back, so a node of very many edges is never one group in memory."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the least node that it reaches) of every node of the edges (u, v). No edges: no rows."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(down, F.lit(True))
        least = down.groupBy("u").agg(F.min("v").alias("v"))
        after = materialize(small.unionByName(least).where("u <> v").distinct(), "edges")
        new = _state(after)
        discard(now)
        now = after
        if new == state:
            break
        state = new
    parents = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct()
    return parents.select(F.col("u").alias("node"), "component").unionByName(roots.join(parents.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component")))
