"""File readers: image listings, phenotype tables, distance matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelfield.operators.ingest import (
    IMAGE_SUFFIX,
    normalise_phenotype,
    parse_image_paths,
    wide_distance_to_edges,
)


def list_image_files(spark: SparkSession, folder: str, suffix: str = IMAGE_SUFFIX) -> DataFrame:
    """Image files of a folder with site and subject id parsed from the name.

    Only ``path`` is selected, so file contents are never read.
    """
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path")
    )
    return parse_image_paths(found, suffix)


def read_phenotype(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Phenotype CSV with an explicit schema (no inference scan)."""
    return normalise_phenotype(spark.read.csv(path, header=True, schema=schema))


def read_distance_csv(spark: SparkSession, path: str, names: list[str], row_column: str = "row_no") -> DataFrame:
    """Square distance CSV whose first column holds row names, or 1-based row numbers.

    A first column that is neither one of ``names`` nor a number of one fails the job.
    """
    schema = ", ".join([f"`{row_column}` STRING", *[f"`{n}` DOUBLE" for n in names]])
    known = F.array(*[F.lit(n) for n in names])
    place = F.array_position(known, F.trim(row_column))
    number = F.when(place > 0, place).otherwise(F.expr(f"try_cast(`{row_column}` as int)"))
    unknown = F.raise_error(F.concat(F.lit("unknown row name: "), F.coalesce(row_column, F.lit("NULL")))).cast("int")
    checked = F.when(number.between(1, len(names)), number.cast("int")).otherwise(unknown)
    table = spark.read.csv(path, header=True, schema=schema).withColumn(row_column, checked)
    return wide_distance_to_edges(table, row_column, names)


def read_parcels(spark: SparkSession, path: str) -> DataFrame:
    """Parcellation table: one label per voxel, 0 for background."""
    return spark.read.parquet(path).select(
        F.col("voxel_id").cast("int"), F.col("parcel_id").cast("int")
    )
