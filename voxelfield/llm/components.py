"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.llm.storage import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star then one small-star step over edges (hi, lo) with lo < hi."""
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "near")
    least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("root"))
    large = both.join(least, "node").where("near > node").select(F.col("near").alias("hi"), F.col("root").alias("lo"))
    large = large.where("hi <> lo").distinct()
    least = large.groupBy("hi").agg(F.min("lo").alias("root"))
    small = large.join(least, "hi")
    return (
        small.where("lo <> root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        .union(least.select("hi", F.col("root").alias("lo")))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; component is its least node.

    ``edges`` has two columns of one orderable type; direction, repeats and
    self-links do not matter. Neighbourhoods are never gathered: each step is
    a map-side combined minimum and a join, and ends in a stored table. Steps
    go on until the edges are stars, which takes about log(diameter) of them.
    """
    a, b = edges.columns
    current = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    current = stored(current, "edges")
    while True:
        # Stars: nobody has two parents and no parent has a parent.
        unsettled = current.groupBy("hi").count().where("count > 1").select("hi").union(
            current.select("hi").intersect(current.select("lo"))
        )
        if unsettled.isEmpty():
            break
        current = stored(_stars(current), "edges")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
