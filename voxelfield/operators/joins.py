"""Joins of long images with tables of one row per voxel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest voxel table sent to every executor.
BROADCAST_BYTES = 256 * 1024 * 1024
COLUMN_BYTES = 16
UNKNOWN_BYTES = 1 << 55


def estimated_bytes(df: DataFrame) -> int:
    """The planner's own size estimate; costs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def known_bytes(df: DataFrame) -> int:
    """The planner's size estimate, 0 where it has none (it then assumes an absurdly large table)."""
    size = estimated_bytes(df)
    return size if size < UNKNOWN_BYTES else 0


def planner_threshold(df: DataFrame) -> int:
    jvm = df.sparkSession._jsparkSession
    return int(jvm.sessionState().conf().autoBroadcastJoinThreshold())


def theta_bytes(n_basis: int) -> int:
    """Size of one row of parameters with its coefficient array."""
    return 8 * n_basis + 4 * COLUMN_BYTES


def voxel_join(
    rows: DataFrame, voxels: DataFrame, on: Sequence[str], how: str = "inner", row_bytes: int | None = None
) -> DataFrame:
    """Join ``rows`` (subjects x voxels) with a table of one row per voxel.

    A volume's parameters exceed the planner's broadcast threshold, yet
    shuffling every image to meet them would cost far more than sending them
    out. Below the threshold, or with broadcasts switched off, the planner decides. Above it the table's rows
    are counted, up to the number that fits ``BROADCAST_BYTES``; only a table
    proven to fit is broadcast, any other is joined by shuffle.

    The count reads ``voxels``, so hand in a stored or settled table.
    """
    threshold = planner_threshold(voxels)
    if threshold < 0 or estimated_bytes(voxels) <= threshold:
        return rows.join(voxels, list(on), how)
    width = row_bytes or COLUMN_BYTES * len(voxels.columns)
    most = BROADCAST_BYTES // width
    fits = voxels.select(*on).limit(most + 1).count() <= most
    return rows.join(F.broadcast(voxels) if fits else voxels, list(on), how)
