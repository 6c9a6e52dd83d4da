"""Datasets and fits saved under keys instead of encoded file names.

A dataset's folder holds ``data``, one folder per write (with one directory level
per key), and ``manifest``, one entry per finished write: its keys, its folder and whether it replaces what was
saved under the same keys. A write becomes visible when its entry appears, in
one step; what a failed or aborted writer leaves in ``data`` is never read, and
writers of different keys do not meet. Readers open the folders they need only.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelfield.session import file_names, write_text

DATASET_KEYS = ("dataset", "sample_size", "replicate", "chain")
WRITE = "__write"
ENTRY = "version string, at long, replaces boolean, keys string"


def _folder(path: str, version: str) -> str:
    return os.path.join(path, "data", f"{WRITE}={version}")


def save_dataset(df: DataFrame, path: str, keys: dict[str, str | int], mode: str = "append") -> None:
    """Write ``df`` below ``path``; ``mode`` append adds to what the keys hold, overwrite takes its place."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    spark, version = df.sparkSession, uuid.uuid4().hex
    tagged = df.withColumns({name: F.lit(value) for name, value in keys.items()})
    tagged.write.partitionBy(*keys).parquet(_folder(path, version))
    entry = {"version": version, "at": time.time_ns(), "replaces": mode == "overwrite", "keys": json.dumps(keys, sort_keys=True)}
    write_text(spark, os.path.join(path, "manifest", f"{version}.json"), json.dumps(entry))


def saved_versions(spark: SparkSession, path: str, **keys: str | int) -> list[str]:
    """Folders of the current writes whose keys agree with ``keys``, in the order of their entries."""
    where = os.path.join(path, "manifest")
    if not file_names(spark, where):
        return []
    # One entry per write: a list of folders, not data.
    entries = sorted(spark.read.schema(ENTRY).json(where).collect(), key=lambda e: (e.at, e.version))
    current: dict[str, list[str]] = {}
    for entry in entries:
        current[entry["keys"]] = [] if entry.replaces else current.get(entry["keys"], [])
        current[entry["keys"]].append(entry.version)
    wanted = [k for k in current if all(json.loads(k).get(name) == value for name, value in keys.items())]
    return [version for k in wanted for version in current[k]]


def load_dataset(spark: SparkSession, path: str, **keys: str | int) -> DataFrame:
    """Read what was saved under ``keys``; other folders are not opened. Nothing saved under them fails."""
    versions = saved_versions(spark, path, **keys)
    if not versions:
        raise ValueError(f"nothing saved in {path} under {keys}")
    df = spark.read.option("basePath", os.path.join(path, "data")).parquet(*[_folder(path, v) for v in versions]).drop(WRITE)
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def drop_unfinished(spark: SparkSession, path: str, older_than_s: float = 7 * 24 * 3600.0) -> list[str]:
    """Delete folders without an entry that nobody has touched for long, and folders that were replaced."""
    current, dropped = set(saved_versions(spark, path)), []
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for version in [name.removeprefix(f"{WRITE}=") for name in file_names(spark, os.path.join(path, "data"))]:
        where = fs_path(_folder(path, version))
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        age = time.time() - system.getFileStatus(where).getModificationTime() / 1000
        if version not in current and age >= older_than_s:
            system.delete(where, True)
            dropped.append(version)
    return dropped
