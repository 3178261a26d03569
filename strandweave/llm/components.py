"""Connected components of an edge table, by alternating large-star and small-star steps.

(Kiveris et al., Connected Components in MapReduce and Beyond, 2014.) Every step is a
pre-aggregated groupBy plus a join on the vertex, whose hot keys adaptive execution can split; nothing
is gathered in the driver but two numbers a round. Each round is staged in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stage

#: Rounds after which something must be wrong: a path of 2**50 vertices needs fewer.
MAX_ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each vertex's neighbours (the larger ones, or the smaller ones) under their minimum."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) for every vertex that has an edge; component: the smallest vertex reachable.

    Vertices are longs. Loops, repeated edges and edges in both directions are fine; an edge with
    a null end links nothing. No edges: no rows.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stage(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        e = _star(e, True).where("u != v").distinct()
        e = stage(_star(e, False).where("u != v").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return stars.unionByName(e.select("v", F.col("v").alias("component")).distinct())
