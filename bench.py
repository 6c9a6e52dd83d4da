"""Headline timings; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads. Every query is run
twice in full and the faster run counts; fits report seconds per iteration.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelfield.operators import additive, characters, conditionals, inclusion, predict
from voxelfield.plans import fixtures as fx
from voxelfield.plans import queries as catalog
from voxelfield.plans.selection_fit import FitConfig, fit_selection_model
from voxelfield.session import build_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FIT_ITERATIONS = int(os.environ.get("BENCH_FIT_ITERATIONS", "20"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

# The model size of the workloads: 21 basis functions, image kernel.
DEGREE, A, B = 20, 0.01, 100.0


def images(spark: SparkSession) -> DataFrame:
    """All subjects, spread over the threads before voxels are unpacked."""
    wide = fx.table(spark, SF, "embeddings").repartition(int(CPUS))
    return wide.select(F.col("vec_id").alias("subject_id"), F.posexplode("embedding").alias("voxel_id", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


def state(spark: SparkSession) -> DataFrame:
    return fx.voxels8(spark, SF).drop("theta").selectExpr("*", fx.fixed_theta(DEGREE + 1))


def effects(spark: SparkSession) -> DataFrame:
    basis = additive.basis_expand(images(spark), DEGREE, A, B)
    return additive.voxel_effects(basis, state(spark), DEGREE + 1)


def eta(spark: SparkSession) -> DataFrame:
    return additive.linear_predictor(images(spark), state(spark), fx.scalars(spark, SF), DEGREE, A, B)


def window_million(spark: SparkSession) -> DataFrame:
    key = F.col("id")
    cells = spark.range(1_000_000).select(
        key.alias("voxel_id"), (key % 1000).cast("int").alias("row"), F.floor(key / 1000).cast("int").alias("col"),
        (key % 2 + 1).cast("int").alias("partition_id"), F.lit(False).alias("excluded"), (key * 7 % 5 < 2).cast("int").alias("delta"),
    )
    radius = spark.createDataFrame([(1, 1), (2, 2)], "partition_id int, radius int")
    return inclusion.window_inclusion(cells.drop("delta"), cells, radius, [1, 2])


def probit_odds(spark: SparkSession) -> DataFrame:
    return conditionals.inclusion_logodds_probit(effects(spark), eta(spark), fx.labels8(spark, SF), state(spark), 1)


TIMED: dict[str, Callable[[SparkSession], DataFrame]] = {
    "character_accuracy_curve_lineitem": lambda s: catalog.QUERIES["character_accuracy_lineitem"](s, SF),
    "code_scores_lineitem": lambda s: characters.code_scores(fx.flashes_lineitem(s, SF)),
    "window_inclusion_1e6": window_million,
    "window_inclusion_orders": lambda s: catalog.QUERIES["window_inclusion_masked"](s, SF),
    "basis_linear_predictor": eta,
    "inclusion_logodds_probit": probit_odds,
    "voxel_gram": lambda s: conditionals.voxel_gram(images(s), DEGREE, A, B),
    "inclusion_map": lambda s: catalog.QUERIES["inclusion_map"](s, SF),
    "events_to_lattice": lambda s: catalog.QUERIES["events_to_lattice"](s, SF),
    "parcel_means": lambda s: catalog.QUERIES["parcel_means"](s, SF),
    "parcel_adjacency": lambda s: catalog.QUERIES["parcel_adjacency"](s, SF),
    "voxel_neighbors6": lambda s: catalog.QUERIES["voxel_neighbors6"](s, SF),
    "stratified_split": lambda s: catalog.QUERIES["stratified_split"](s, SF),
    "roc_auc": lambda s: catalog.QUERIES["roc_auc"](s, SF),
    "posterior_mean": lambda s: catalog.QUERIES["posterior_mean"](s, SF),
}


def seconds(run: Callable[[], None]) -> float:
    best = float("inf")
    for _ in range(REPEATS):
        start = time.time()
        run()
        best = min(best, time.time() - start)
    return round(best, 3)


def fit_seconds(spark: SparkSession, chains: int, side: int = 8, subjects: int | None = None) -> float:
    """Seconds per iteration: a longer fit minus a shorter one, so set-up cancels.

    Beyond 8 x 8 the images repeat the vectors with changing weights.
    """
    labels, size = fx.labels8(spark, SF), side * side
    if side == 8:
        pictures, lattice = fx.images8(spark, SF), fx.voxels8(spark, SF).select("voxel_id", "row", "col", "partition_id", "excluded")
    else:
        labels = labels.orderBy("subject_id").limit(subjects)
        wide = fx.table(spark, SF, "embeddings").join(labels.select(F.col("subject_id").alias("vec_id")), "vec_id").repartition(int(CPUS))
        value = F.expr(f"transform(sequence(0, {size - 1}), v -> cast(embedding[v % 64] * cos(v) as double))")
        pictures = wide.select(F.col("vec_id").alias("subject_id"), F.posexplode(value).alias("voxel_id", "value"))
        key = F.col("id").cast("int")
        lattice = spark.range(size).select(
            key.alias("voxel_id"), (key % side).alias("row"), F.floor(key / side).cast("int").alias("col"),
            (key % 2 + 1).alias("partition_id"), F.lit(False).alias("excluded"),
        )

    def run(iterations: int) -> float:
        config = FitConfig(degree=DEGREE, a=A, b=B, burnin=0, mcmc_sample=iterations, thinning=1, chains=chains, radii=(1, 2), seed=1)
        start = time.time()
        fit_selection_model(pictures, labels, lattice, config)
        return time.time() - start

    run(1)
    return round((run(FIT_ITERATIONS + 1) - run(1)) / FIT_ITERATIONS, 3)


def main() -> None:
    spark = build_session(f"local[{CPUS}]", int(CPUS))
    spark.conf.set("spark.sql.shuffle.partitions", CPUS)
    found = {
        name: seconds(lambda: build(spark).write.format("noop").mode("overwrite").save()) for name, build in TIMED.items()
    }
    for chains in (1, 30):
        found[f"fit_iteration_{chains}_chains"] = fit_seconds(spark, chains)
    # 1,000 images of 28 x 28, and of about half as many voxels, as in the published workload.
    found["fit_iteration_784_voxels"] = fit_seconds(spark, 1, 28, 1000)
    found["fit_iteration_400_voxels"] = fit_seconds(spark, 1, 20, 1000)
    total = round(sum(found.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": found, "sf": SF.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
