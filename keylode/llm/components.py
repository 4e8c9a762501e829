"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Both steps
are written as a minimum per node (aggregated before the shuffle) and a join, so no
node's neighbours are gathered in one row.  The minima of nodes with more than a
HOT-th of all edges (2 * HOT at most) are broadcast, so their edges stay where they
are; other nodes' edges are shuffled.  Every round is written to the shared folder,
which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylode.llm.work import Work


#: A node with more than this part of all edges isn't shuffled.
HOT = 1000


def _joined(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the least v of each u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = F.broadcast(least.where(F.col("n") > max(1, total // HOT)).drop("n"))
    cold = least.where(F.col("n") <= max(1, total // HOT)).drop("n")
    return edges.join(hot, "u").union(edges.join(hot.select("u"), "u", "left_anti").join(cold, "u"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _joined(both, 2 * total).where("v > u")
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    near = _joined(edges, total)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(near.where("v = m").select("u", "v")).distinct()


def components(edges: DataFrame, work: Work, name: str = "components", rounds: int = 60) -> DataFrame:
    """`edges` (a, b) of any comparable ids to (node, component): the smallest id that
    each node of an edge reaches.  Loops, nulls and repeated edges are ignored."""
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = work.table(edges.where("a <> b").select(high, low).distinct(), f"{name}-0")
    before = None
    for i in range(1, rounds + 1):
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before or state[0] == 0:
            break
        before = state
        large = work.table(_large_star(now, state[0]), f"{name}-{i}-large")
        after = work.table(_small_star(large, state[0]), f"{name}-{i}")
        work.drop(f"{name}-{i - 1}", f"{name}-{i}-large")
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
