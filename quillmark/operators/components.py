"""Connected components over an edge table, by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
    return both.join(low, "src").where("dst > src and dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(low, "src").where("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionAll(low.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100, stash: Callable[[DataFrame], DataFrame] = stash) -> DataFrame:
    """(src, dst of one orderable type) -> (node, component): component is the smallest node reachable.

    Only nodes with an edge to another node appear; self loops, repeated edges and edges with a null end count
    for nothing; no edges give no rows. Every round writes its edges to the shared folder, so no lineage builds
    up and nothing but a count and a checksum reaches the driver. stash: what writes them.
    """
    state = stash(edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = None
    for _ in range(max_rounds):
        found = state.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
        after = stash(_small_star(_large_star(state)))
        discard(state)
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(state.select("dst", "dst").distinct())
