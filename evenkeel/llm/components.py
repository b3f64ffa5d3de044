"""Connected components of a graph given as edges, by alternating star contraction.

Each round hangs every vertex's larger neighbours below the least one it knows, then its smaller
ones; trees become stars in a logarithmic number of rounds. Every round is an aggregate that
combines map-side and a join on the vertex, and ends in a checkpoint in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import landed


def _stars(edges: DataFrame, name: str) -> DataFrame:
    """The least neighbour of every vertex `u`, in a table of its own: where that is small, the
    planner sees its size and joins it without a shuffle."""
    return landed(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _stars(both, "large-stars").select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge goes from the larger to the smaller end already.
    least = _stars(edges, "small-stars")
    below = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of `edges` (u, v), both long; the root is the least vertex
    of the component. Nulls and loops are ignored; no edges give no rows."""
    edges = landed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    last = None
    while True:
        state = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == last:
            break
        last = state
        edges = landed(_small_star(landed(_large_star(edges), "edges")), "edges")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
