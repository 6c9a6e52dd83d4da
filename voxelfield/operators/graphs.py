"""Neighbour graphs as edge tables (src, dst), both directions present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both_ways(pairs: DataFrame) -> DataFrame:
    ways = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return pairs.select(F.explode(ways).alias("edge")).select("edge.src", "edge.dst")


def _offset_neighbors(points: DataFrame, id_col: str, axes: tuple[str, ...]) -> DataFrame:
    """Points one step apart along one axis, by equi-join on the shifted coordinates."""
    steps = F.array(*[F.struct(*[F.lit(int(a == b)).alias(b) for b in axes]) for a in axes])
    ahead = points.select(F.col(id_col).alias("src"), *axes, F.explode(steps).alias("step")).select(
        "src", *[(F.col(c) + F.col("step")[c]).alias(c) for c in axes]
    )
    target = points.select(F.col(id_col).alias("dst"), *axes)
    return _both_ways(ahead.join(target, list(axes)).select("src", "dst"))


def voxel_neighbors6(coords: DataFrame) -> DataFrame:
    """Face neighbours within the given (voxel_id, x, y, z) set."""
    return _offset_neighbors(coords, "voxel_id", ("x", "y", "z"))


def lattice_graph(lattice: DataFrame) -> DataFrame:
    """Four-neighbour graph of the vertices that are not excluded."""
    return _offset_neighbors(lattice.where(~F.col("excluded")), "voxel_id", ("row", "col"))


def channel_time_graph(nodes: DataFrame, channel_dist: DataFrame, dt: int = 1, dd: float = 2.0) -> DataFrame:
    """Edges between nodes at most ``dt`` steps and ``dd`` distance apart.

    Near channel pairs are taken first, then the time band is turned into
    2*dt + 1 shifted equi-keys. Every row joined is an edge or a node without
    partner; pairs of far channels are never formed. The channel distances of
    the lower-numbered node decide, and the mirror edge is added.
    """
    near = channel_dist.where(F.col("dist") <= F.lit(dd)).select("src", "dst")
    left = nodes.select(F.col("node").alias("a"), F.col("channel").alias("src"), F.col("timepoint").alias("t"))
    shifts = F.explode(F.array(*[F.lit(s) for s in range(-dt, dt + 1)]))
    reach = left.join(near, "src").select("a", "dst", "t", shifts.alias("shift"))
    reach = reach.select("a", F.col("dst").alias("channel"), (F.col("t") + F.col("shift")).alias("timepoint"))
    right = nodes.select(F.col("node").alias("b"), "channel", "timepoint")
    pairs = reach.join(right, ["channel", "timepoint"]).where("a < b")
    return _both_ways(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
