"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _state(edges: DataFrame):
    # a sum of hashes may wrap, so each is cut to 32 bits first
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)).alias("s")).first()
    return row.n, row.s


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least neighbour of each u. Stored, so that the join to it has two plain shuffles that AQE can split."""
    return stash(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """node, root for every node that has an edge to another; root is the component's least node.

    Every round hangs each node's larger neighbours on its least one, then its smaller ones; a path of n nodes takes
    about log n rounds. Rounds are joins of narrow rows, stored in the shared folder. Edges to nulls are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = stash(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "cc-edges")
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "cc-large")
        least = _least(large)
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        if (now := _state(e)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
