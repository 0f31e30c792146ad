"""Connected components of an edge table by alternating star contraction; no step needs a node's neighbours in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Each node's chosen neighbours (the larger, or the smaller and itself) are linked to its least neighbour instead."""
    seen = both if large else both.where("v < u")
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.where("v > u" if large else "v < u").join(least, "u")
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id of an edge (columns a, b).

    Nulls and loops are ignored, repeated edges count once. Every round is written to the shared folder, so that a lost
    executor costs that round's work at most; the number of rounds grows with the logarithm of the longest path."""
    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _star(both, True)
        e = stored(_star(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), False), "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
