"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindlattice.llm.common import stage

MOST_ROUNDS = 60


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """For each u of (u, v) the least of u and its v's; partial sums keep hubs cheap."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_min_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = _min_neighbour(down)
    linked = down.join(least, "u")
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(linked.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.hash("v", "u").cast("long"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge; component is its least reachable node.

    ``edges`` holds undirected edges in the long columns a and b; self-loops,
    nulls and repeats add nothing, and no edges give no rows.  Each round is
    written to the shared folder, so lost executors cost one round at most.
    """
    now = stage(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    state = _state(now)
    if state[0]:
        for _ in range(MOST_ROUNDS):
            now = stage(_small_star(_large_star(now)), "stars")
            before, state = state, _state(now)
            if state == before:
                break
        else:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
