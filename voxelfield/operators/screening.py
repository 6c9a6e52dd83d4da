"""Scaling, voxel screening and voxel partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.operators.ranking import value_quantile
from voxelfield.session import settle


def scale_constant(images: DataFrame, k: float = 255.0) -> DataFrame:
    return images.withColumn("value", F.col("value") / F.lit(float(k)))


def scale_global_maxabs(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Divide both sets by the largest absolute value of the training set."""
    top = train.agg(F.max(F.abs("value")))
    scaled = [d.withColumn("value", F.try_divide(F.col("value"), top.scalar())) for d in (train, test)]
    return scaled[0], scaled[1]


def _without_information(mode: str) -> Column:
    if mode == "nonpos_sum":
        return F.sum("value") <= 0
    if mode == "all_zero":
        return F.max(F.abs("value")) == 0
    raise ValueError(f"unknown mode {mode!r}")


def excluded_voxels(images: DataFrame, mode: str = "nonpos_sum") -> DataFrame:
    """Voxels without information: ``nonpos_sum`` (sum <= 0) or ``all_zero``."""
    return images.groupBy("voxel_id").agg(_without_information(mode).alias("excluded"))


def voxel_variance(images: DataFrame) -> DataFrame:
    """Sample variance of every voxel over subjects (partial + final aggregate)."""
    return images.groupBy("voxel_id").agg(F.var_samp("value").alias("variance"))


def voxel_summary(images: DataFrame, mode: str = "nonpos_sum") -> DataFrame:
    """(voxel_id, excluded, variance) in one aggregate."""
    return images.groupBy("voxel_id").agg(_without_information(mode).alias("excluded"), F.var_samp("value").alias("variance"))


def partition_by_threshold(variance: DataFrame, threshold: float = 0.05) -> DataFrame:
    part = F.when(F.col("variance") > F.lit(threshold), 1).otherwise(2)
    return variance.select("voxel_id", part.alias("partition_id"))


def partition_by_quantile(variance: DataFrame, q: float = 0.5) -> DataFrame:
    """Partition 1 above the q-quantile of the variances, else 2.

    The variances are read three times (cut points, quantile, comparison), so
    they are settled first rather than recomputed from the images; further
    columns are kept.
    """
    variance = settle(variance)
    rest = [c for c in variance.columns if c not in ("voxel_id", "variance")]
    limit = value_quantile(variance, "variance", q)
    part = F.when(F.col("variance") > limit.scalar(), 1).otherwise(2)
    return variance.select("voxel_id", part.alias("partition_id"), *rest)


def block_starts(dim: int, n_part: int) -> list[int]:
    """1-based first row of each block: evenly spaced from 1 to dim - dim // n_part."""
    last = dim - dim // n_part
    if n_part == 1:
        return [1]
    return [int(1 + i * (last - 1) / (n_part - 1) + 1e-9) for i in range(n_part)]


def partition_grid(lattice: DataFrame, n_row: int, n_col: int, n_part: int = 4) -> DataFrame:
    """n_part x n_part blocks; a shared border row belongs to the later block.

    The block of a coordinate is the number of block starts at or before it,
    so no join with the blocks is needed.
    """

    def block(coord: str, dim: int):
        reached = [F.when(F.col(coord) + 1 >= s, 1).otherwise(0) for s in block_starts(dim, n_part)]
        return sum(reached[1:], reached[0])

    part = (block("row", n_row) - 1) * n_part + block("col", n_col)
    return lattice.withColumn("partition_id", part.cast("int"))
