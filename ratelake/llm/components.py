"""Connected components of links between long ids, by alternating large-star and small-star rounds.

Each round is two joins and two aggregations; the state is written to the shared folder between rounds, so a
lost executor costs one round at most. No vertex's neighbours are ever gathered: stars need only the smallest
neighbour, an aggregate that tasks combine before the shuffle; joins on a hot vertex are left to the
optimizer, which splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a vertex to the smallest of the vertex and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the smallest of them (edges point from larger to smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    ``links`` has long columns a and b; nulls and self-links are left out, repeated links count once. Nodes
    without links do not appear. Rounds needed grow with the logarithm of the number of nodes.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.materialize(edges, "edges")
    state = None
    for _ in range(max_rounds):
        edges = common.materialize(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
