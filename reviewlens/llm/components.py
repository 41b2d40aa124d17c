"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.sources.scratch import materialise


def _stamp(edges: DataFrame) -> tuple:
    """Rows and an order-free sum of hashes: two equal edge sets have equal stamps."""
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    row = edges.agg(F.count(F.lit(1)).alias("n"), hashed.alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has an edge to another; the root is the smallest node reached.

    Large and small stars alternate until nothing changes, a logarithmic number of rounds. The minimum per
    node is a partial aggregate and is written first, so that the join that spreads it has two plain
    exchanges and a node with very many edges is split over tasks. Loops and nulls are ignored; an empty
    table gives an empty one.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = materialise(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    before, now = None, _stamp(edges)
    while now != before and now[0]:
        both = edges.union(edges.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.union(least.select("u", "m")).distinct(), "edges")
        before, now = now, _stamp(edges)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(edges.select("v", "v")).distinct()
