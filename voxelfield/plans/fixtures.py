"""Model inputs derived from the given tables. `oracle.py` holds the same
derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEGREE = 4
N_BASIS = DEGREE + 1
KERNEL_A = 0.01
KERNEL_B = 10.0
TAU = 1.5
SEED = 7
LATTICE_ROWS = 100


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its footer is read once for the schema."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def fixed_theta(n_basis: int) -> str:
    return f"transform(sequence(0, {n_basis - 1}), k -> ((voxel_id * (k + 3)) % 7 - 3) / 10.0D) as theta"


def images8(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8 x 8 images in long form."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("subject_id"), F.posexplode("embedding").alias("voxel_id", "value")
    ).withColumn("value", F.col("value").cast("double"))


def labels8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("subject_id"), (F.col("label") == 8).cast("int").alias("y")
    )


def voxels8(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct voxels of the images with a fixed state (delta, theta, p)."""
    ids = images8(spark, sf).select("voxel_id").distinct()
    return ids.selectExpr(
        "voxel_id", "voxel_id % 8 as row", "cast(voxel_id div 8 as int) as col",
        "cast((voxel_id * 7 + 3) % 5 < 2 as int) as delta", fixed_theta(N_BASIS), "(voxel_id % 9 + 1) / 10.0D as p",
        "voxel_id % 8 < 2 and voxel_id < 16 as excluded", "voxel_id % 3 + 1 as partition_id",
    )


def z8(spark: SparkSession, sf: str) -> DataFrame:
    return labels8(spark, sf).select(
        "subject_id", ((2 * F.col("y") - 1) * (0.1 + (F.col("subject_id") % 9) / 5.0)).alias("z")
    )


def scalars(spark: SparkSession, sf: str) -> DataFrame:
    """One row of scalar parameters; alpha is the share of positive subjects."""
    return labels8(spark, sf).agg(F.avg("y").alias("alpha")).withColumns({
        "inv_sigma_sq": F.lit(TAU), "inv_a": F.lit(0.8),
    })


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Orders laid out on a lattice of 100 rows, one cell per order."""
    key = F.col("o_orderkey")
    row, col = key % LATTICE_ROWS, F.floor(key / LATTICE_ROWS)
    return table(spark, sf, "orders").select(
        key.alias("voxel_id"),
        row.cast("int").alias("row"),
        col.cast("int").alias("col"),
        F.when(F.col("o_totalprice") > 250000, 1).otherwise(2).alias("partition_id"),
        ((F.col("o_orderpriority") == "1-URGENT") | ((row < 4) & (col < 4))).alias("excluded"),
        (F.col("o_custkey") % 5 < 2).cast("int").alias("delta"),
    )


def radius_by_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Radius 1 for the first partition, 2 for the second."""
    return cells(spark, sf).select("partition_id").distinct().withColumn("radius", F.col("partition_id"))


def volume(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as voxels of a 10 x 10 x n volume."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("voxel_id"),
        (key % 10).cast("int").alias("x"),
        (F.floor(key / 10) % 10).cast("int").alias("y"),
        F.floor(key / 100).cast("int").alias("z"),
    )


def volume_parcels(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of 5 x 5 x 10 voxels, labels in steps of ten; low orders are background."""
    key = F.col("o_orderkey")
    block = F.floor((key % 10) / 5) + 2 * F.floor((F.floor(key / 10) % 10) / 5) + 4 * F.floor(key / 1000)
    return table(spark, sf, "orders").select(
        key.alias("voxel_id"),
        F.when(F.col("o_totalprice") < 20000, 0).otherwise((block + 1) * 10).cast("int").alias("parcel_id"),
    )


def image_parcels(spark: SparkSession, sf: str) -> DataFrame:
    """4 x 4 blocks of the 8 x 8 images, labels 0, 10, 20, 30."""
    return voxels8(spark, sf).select(
        "voxel_id", ((F.floor(F.col("row") / 4) + 2 * F.floor(F.col("col") / 4)) * 10).cast("int").alias("parcel_id")
    )


def flashes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as flashes; users are characters, two target codes each."""
    code = (F.col("event_id") % 12 + 1).cast("int")
    user = F.col("user_id")
    true = ((code == user % 6 + 1) | (code == user % 6 + 7)).cast("int")
    return table(spark, sf, "events").select(
        user.alias("char_id"), F.col("event_id").alias("seq_no"), code.alias("code"), true.alias("is_true"),
        (F.col("value") + 30 * true).alias("score"),
        (F.col("value") + 10 * true).alias("score_b"),
    )


def flashes_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    code = ((F.col("l_orderkey") + F.col("l_linenumber")) % 12 + 1).cast("int")
    key = F.col("l_suppkey")
    true = ((code == key % 6 + 1) | (code == key % 6 + 7)).cast("int")
    return table(spark, sf, "lineitem").select(
        key.alias("char_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq_no"),
        code.alias("code"), true.alias("is_true"), (F.col("l_quantity") + 30 * true).alias("score"),
        (F.col("l_discount") * 100 + 5 * true).alias("score_b"),
    )


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as voxel draws of three chains with forty iterations."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf, "orders").select(
        (key % 3).cast("int").alias("chain_id"),
        (F.floor(key / 3) % 40).cast("int").alias("iter"),
        F.floor(key / 120).cast("int").alias("voxel_id"),
        (cents % 2).cast("int").alias("delta"),
        F.array(*[((cents % (17 + k)) - 8) / 10.0 for k in range(N_BASIS)]).alias("theta"),
    )


def subject_draws(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (key % 3).cast("int").alias("chain_id"),
        (F.floor(key / 3) % 40).cast("int").alias("iter"),
        F.floor(key / 120).alias("subject_id"),
        (F.col("o_totalprice") / 7000).alias("z"),
    )


def global_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar draws per (chain, iteration): averages over that iteration's orders."""
    rows = subject_draws(spark, sf)
    return rows.groupBy("chain_id", "iter").agg(
        F.avg("z").alias("alpha"),
        (1 + F.count_if(F.col("z") > 20) / F.count("*")).alias("inv_sigma_sq"),
        (1 + F.count_if(F.col("z") > 50) / F.count("*")).alias("inv_a"),
        (-F.sum("z")).alias("loglik"),
    )


def radius_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Radius per (chain, iteration, partition): one above the parity of the partition's size."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        (key % 3).cast("int").alias("chain_id"), (F.floor(key / 3) % 40).cast("int").alias("iter"),
        F.when(F.col("o_totalprice") > 250000, 1).otherwise(2).alias("partition_id"),
    )
    return rows.groupBy("chain_id", "iter", "partition_id").agg((F.count("*") % 2 + 1).cast("int").alias("radius"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two models' scores per order, rounded so that scores repeat."""
    price = F.col("o_totalprice")
    models = F.array(
        F.struct(F.lit("price").alias("model"), F.round(price / 500000, 3).alias("score")),
        F.struct(F.lit("customer").alias("model"), F.round((F.col("o_custkey") % 997) / 997.0, 3).alias("score")),
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("subject_id"), F.explode(models).alias("m")).select(
        "subject_id", "m.model", "m.score"
    )


def order_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("subject_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y")
    )


def order_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A probability per order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("subject_id"), (F.col("o_totalprice") / 500000).alias("prob")
    )


def channel_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Channels (users modulo 16) by hour: one node per channel and hour with events."""
    hour = F.dayofyear("ts") * 24 + F.hour("ts")
    seen = table(spark, sf, "events").select((F.col("user_id") % 16).cast("int").alias("channel"), hour.alias("timepoint")).distinct()
    return seen.select((F.col("timepoint") * 16 + F.col("channel")).alias("node"), "channel", "timepoint")


def channel_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distance between the channels at hand: index difference / 4."""
    ids = table(spark, sf, "events").select((F.col("user_id") % 16).cast("int").alias("src")).distinct()
    return ids.select("src", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("dst")).withColumn(
        "dist", F.abs(F.col("src") - F.col("dst")) / 4.0
    )
