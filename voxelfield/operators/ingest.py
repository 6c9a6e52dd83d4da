"""From raw tables to images, labels and covariates in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File suffix and id width of the image listing.
IMAGE_SUFFIX = "_falff.nii.gz"
ID_DIGITS = 7

# Sex codes of the phenotype table.
SEX_NAMES = {1: "Male", 2: "Female"}


def parse_image_paths(paths: DataFrame, suffix: str = IMAGE_SUFFIX) -> DataFrame:
    """(path) -> (path, filename, site_id, sub_id) for names `<SITE>_<7 digits><suffix>`."""
    filename = F.element_at(F.split("path", "/"), -1)
    named = paths.select("path", filename.alias("filename")).where(F.col("filename").endswith(suffix))
    stem = F.expr(f"substr(filename, 1, length(filename) - {len(suffix)})")
    named = named.withColumn("__stem", stem)
    tail = rf"(\d{{{ID_DIGITS}}})$"
    sub_id = F.regexp_extract("__stem", tail, 1)
    return named.select(
        "path",
        "filename",
        F.upper(F.regexp_replace("__stem", "_" + tail, "")).alias("site_id"),
        F.when(sub_id != "", sub_id).alias("sub_id"),
    )


def normalise_phenotype(pheno: DataFrame, site: str = "SITE_ID", subject: str = "SUB_ID") -> DataFrame:
    """Upper-case sites; add the zero-padded id as ``sub_id``."""
    return pheno.withColumns({
        "site_id": F.upper(F.col(site).cast("string")),
        "sub_id": F.format_string(f"%0{ID_DIGITS}d", F.col(subject).cast("long")),
    })


def match_phenotype(files: DataFrame, pheno: DataFrame) -> DataFrame:
    """Inner join on (site_id, sub_id); the planner decides the strategy by size."""
    return files.join(pheno, ["site_id", "sub_id"], "inner")


def image_to_long(
    df: DataFrame, id_col: str, array_col: str, dims: Sequence[int], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per subject and voxel, column-major coordinates, names `Vox_k` from 1.

    Two dims give (row, col); three give (x, y, z). Columns in ``keep`` ride
    along: joining outcome or residual to the image row, before voxels are
    unpacked, spares a shuffle of all voxels later.
    """
    long = df.select(
        F.col(id_col).cast("long").alias("subject_id"),
        *keep,
        F.posexplode(array_col).alias("voxel_id", "value"),
    ).withColumn("value", F.col("value").cast("double"))
    names = ("row", "col") if len(dims) == 2 else ("x", "y", "z")
    stride, coords = 1, {}
    for name, size in zip(names, dims):
        step = F.floor(F.col("voxel_id") / stride)
        coords[name] = (step % size).cast("int")
        stride *= size
    return long.withColumns({
        **coords,
        "voxel_name": F.concat(F.lit("Vox_"), (F.col("voxel_id") + 1).cast("string")),
    })


def long_to_image(images: DataFrame) -> DataFrame:
    """Inverse of ``image_to_long``: one array per subject, voxels in order."""
    pairs = F.array_sort(F.collect_list(F.struct("voxel_id", "value")))
    return images.groupBy("subject_id").agg(F.transform(pairs, lambda p: p["value"]).alias("image"))


def events_to_lattice(
    df: DataFrame, id_col: str, row: Column, col: Column, value: Column, n_row: int, n_col: int
) -> DataFrame:
    """Mean value per subject and lattice cell; cells without events are 0.

    An empty row per subject and cell is added before one aggregate, so raw
    events combine map-side and nothing is gathered per subject.
    """
    cell = (row + col * n_row).cast("int")
    seen = df.select(F.col(id_col).cast("long").alias("subject_id"), cell.alias("voxel_id"), value.alias("value"))
    grid = seen.select("subject_id").distinct().select(
        "subject_id",
        F.explode(F.sequence(F.lit(0), F.lit(n_row * n_col - 1))).alias("voxel_id"),
        F.lit(None).cast("double").alias("value"),
    )
    inside = seen.where(F.col("voxel_id").between(0, n_row * n_col - 1))
    means = inside.unionByName(grid).groupBy("subject_id", "voxel_id")
    return means.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))


def wide_distance_to_edges(df: DataFrame, row_column: str, names: Sequence[str]) -> DataFrame:
    """Square matrix, one row per 1-based ``row_column`` -> (src, dst, dist)."""
    src = F.element_at(F.array(*[F.lit(n) for n in names]), F.col(row_column).cast("int"))
    labelled = df.select(src.alias("src"), *names)
    return labelled.unpivot("src", list(names), "dst", "dist")


def binarise_outcome(df: DataFrame, id_col: str, label_col: str, target) -> DataFrame:
    """(subject_id, y) with y = 1 where the label equals ``target``."""
    return df.select(
        F.col(id_col).cast("long").alias("subject_id"),
        (F.col(label_col) == F.lit(target)).cast("int").alias("y"),
    )


def covariate_projection(matched: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Covariates with named sex levels, plus the outcome column."""
    names = F.create_map(*[F.lit(v) for pair in SEX_NAMES.items() for v in pair])
    return matched.select(
        *keep,
        "AGE_AT_SCAN",
        F.try_element_at(names, F.col("SEX").cast("int")).alias("SEX"),
        "FIQ",
        F.col("HANDEDNESS_CATEGORY").cast("string").alias("HANDEDNESS_CATEGORY"),
        "DX_GROUP",
    )
