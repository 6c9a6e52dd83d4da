"""Session construction and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators are tuned for.

    On a cluster the session comes from spark-submit; none of the operators
    depends on these values for correctness.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName("voxelfield")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Where the setting is absent, which is the case in local tests, the
    context's checkpoint folder is used, or one is made for it.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="voxelfield-"))
    return context.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a table of our own in the shared folder."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared file system; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file in the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True).close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in the shared file system; it appears under its name in full or not at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder, name = os.path.split(path)
    part, where = hadoop(os.path.join(folder, f"_{name}")), hadoop(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not system.rename(part, where):
        raise OSError(f"cannot write {path}")


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    Used where a derived table is read several times, so that an expensive
    scan is not repeated and a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(os.path.join(shared_dir(spark), "checkpoints"))
    return df.checkpoint(eager=True)
