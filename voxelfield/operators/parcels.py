"""Parcellations: labels, pooled means, contacts between parcels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.operators.joins import voxel_join
from voxelfield.operators.ranking import range_cuts, row_numbers

AXES = ("x", "y", "z")
VOXELS_PER_LIST = 1024
# Ids that one task compares.
IDS_PER_TASK = 250_000


def remap_labels(parcels: DataFrame) -> DataFrame:
    """Replace labels by their position among the sorted distinct labels, from 0."""
    labels = parcels.select("parcel_id").distinct()
    ranked = row_numbers(labels, [], "parcel_id", range_cuts(parcels, "parcel_id"), "__rank")
    lookup = ranked.select("parcel_id", (F.col("__rank") - 1).cast("int").alias("new_id"))
    return parcels.join(lookup, "parcel_id").select("voxel_id", "parcel_id", "new_id")


def parcel_means(images: DataFrame, parcels: DataFrame) -> DataFrame:
    """Mean per subject and parcel; NULL values are skipped, background 0 is kept.

    A voxel without a label, or a label whose voxel no image has, means that
    the shapes differ and fails the job.
    """
    unseen = parcels.select("voxel_id").join(images.select("voxel_id").distinct(), "voxel_id", "left_anti").limit(1).count()
    if unseen and not images.isEmpty():
        raise ValueError("parcel label without image voxel: shapes differ")
    known = parcels.select("voxel_id", F.col("parcel_id").alias("__parcel"))
    unlabelled = F.raise_error(F.lit("image voxel without parcel label: shapes differ")).cast("int")
    joined = voxel_join(images, known, ["voxel_id"], "left")
    labelled = joined.select("subject_id", "value", F.coalesce("__parcel", unlabelled).alias("parcel_id"))
    return labelled.groupBy("subject_id", "parcel_id").agg(F.avg("value").alias("value"))


def shape_mismatch(images: DataFrame, parcels: DataFrame) -> DataFrame:
    """Voxels on one side only; an empty result means equal shapes.

    An id without a label is listed once, a label without a value as often as
    it occurs; NULL ids match nothing. Ids are dealt over a number of partitions
    that follows from their number: they compress so well that partitions cut by
    bytes hold millions of them.
    """
    labelled, seen = parcels.select("voxel_id"), images.select("voxel_id")
    voxels = max(labelled.count(), seen.agg(F.approx_count_distinct("voxel_id")).head()[0])
    parts = max(1, math.ceil(voxels / IDS_PER_TASK))
    if "subject_id" in images.columns:
        seen = seen.distinct()  # each subject repeats them, so that they shrink before they are dealt
    sides = seen.select("voxel_id", F.lit(True).alias("__seen"), F.lit(0).alias("__labels")).unionByName(
        labelled.where("voxel_id is not null").select("voxel_id", F.lit(False).alias("__seen"), F.lit(1).alias("__labels"))
    )
    met = sides.repartition(parts, "voxel_id").groupBy("voxel_id").agg(
        F.bool_or("__seen").alias("__seen"), F.sum("__labels").cast("int").alias("__labels")
    )
    missing = F.when(F.col("__labels") == 0, F.array(F.lit("parcels"))).when(~F.col("__seen"), F.array_repeat(F.lit("images"), F.col("__labels")))
    nameless = labelled.where("voxel_id is null").withColumn("missing_in", F.lit("images"))
    return met.select("voxel_id", F.explode(missing).alias("missing_in")).unionByName(nameless)


def parcel_contacts(voxels: DataFrame, parcels: DataFrame) -> DataFrame:
    """Distinct ordered pairs of positive labels that share a voxel face."""
    labelled = voxels.join(parcels.where("parcel_id > 0"), "voxel_id").select(*AXES, "parcel_id")
    # Each face is met once, from its lower side; the mirror pair is added after
    # duplicates are gone.
    steps = F.array(*[F.struct(*[F.lit(int(a == b)).alias(b) for b in AXES]) for a in AXES])
    ahead = labelled.select("*", F.explode(steps).alias("step")).select(
        F.col("parcel_id").alias("a"), *[(F.col(c) + F.col("step")[c]).alias(c) for c in AXES]
    )
    touching = ahead.join(labelled.withColumnRenamed("parcel_id", "b"), list(AXES)).where("a <> b")
    pairs = touching.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                             F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(both.alias("edge")).select("edge.src", "edge.dst")


def parcel_adjacency(voxels: DataFrame, parcels: DataFrame) -> DataFrame:
    """(parcel_id, neighbors) with sorted neighbours; empty for label 0 and isolated labels."""
    contacts = parcel_contacts(voxels, parcels)
    lists = contacts.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))
    labels = parcels.select("parcel_id").distinct()
    filled = F.coalesce("neighbors", F.array().cast("array<int>"))
    return labels.join(lists, labels["parcel_id"] == lists["src"], "left").select("parcel_id", filled.alias("neighbors"))


def broadcast_parcel_means(means: DataFrame, parcels: DataFrame) -> DataFrame:
    """Give every voxel its parcel's mean, joined on the label.

    The background label can cover a third of the volume, so voxels are packed
    into short lists per (label, voxel range) before the join and unpacked
    after it: the join handles one row per list instead of one per voxel.
    """
    lists = parcels.groupBy("parcel_id", F.floor(F.col("voxel_id") / VOXELS_PER_LIST).alias("part")).agg(
        F.collect_list("voxel_id").alias("voxels")
    )
    return voxel_join(means, lists, ["parcel_id"], row_bytes=8 * VOXELS_PER_LIST).select("subject_id", F.explode("voxels").alias("voxel_id"), "value")


def roi_voxels(voxels: DataFrame, parcels: DataFrame, label: int) -> DataFrame:
    """Voxels of one label with coordinates, flat index and the label's size."""
    members = voxels.join(parcels.where(F.col("parcel_id") == F.lit(label)), "voxel_id")
    size = parcels.where(F.col("parcel_id") == F.lit(label)).agg(F.count("*"))
    return members.select(*AXES, F.col("voxel_id").alias("flat_index"), size.scalar().alias("n_voxels"))
