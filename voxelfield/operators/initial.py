"""Starting states for the selection fit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.functions.hermite import dot, with_basis_columns
from voxelfield.functions.keyed import Key, keyed_normals, keyed_uniform
from voxelfield.functions.normal import norm_ppf
from voxelfield.operators.additive import active_delta
from voxelfield.operators.joins import theta_bytes, voxel_join
from voxelfield.operators.ranking import range_cuts, row_numbers
from voxelfield.session import settle


class ProbabilityError(Evaluator):
    """Mean squared difference between the outcome and P(y = 1)."""

    def _evaluate(self, dataset: DataFrame) -> float:
        miss = F.col("y") - vector_to_array("probability")[1]
        return dataset.agg(F.avg(miss * miss)).first()[0]

    def isLargerBetter(self) -> bool:
        return False


def penalty_path(images: DataFrame, labels: DataFrame, length: int, ratio: float) -> list[float]:
    """Penalties from the least one that selects nothing down to ``ratio`` of it, log-spaced.

    At zero coefficients the gradient of a voxel is the covariance of its
    standardised values with the outcome, so one aggregate over the images
    gives the start. Absent cells are 0.
    """
    people = labels.agg(F.count("*").alias("n"), F.avg("y").alias("mean")).head()
    rows = images.join(labels.select("subject_id", "y"), "subject_id")
    x, n = F.col("value"), F.lit(float(people["n"]))
    sums = rows.groupBy("voxel_id").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.sum(x * F.col("y")).alias("sy"))
    spread = F.sqrt((F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1))
    top = sums.agg(F.max(F.abs(F.try_divide((F.col("sy") - people["mean"] * F.col("s")) / n, spread)))).head()[0] or 1.0
    return [top * ratio ** (i / max(1, length - 1)) for i in range(length)]


def lasso_init(
    images: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    lambdas: Sequence[float] | None = None,
    seed: int = 0,
    path_length: int = 20,
    path_ratio: float = 0.01,
    max_iter: int = 1000,
) -> DataFrame:
    """(voxel_id, coef, delta, alpha, penalty) from an L1 logistic regression.

    The penalty is chosen by cross-validation, from ``lambdas`` or a path that
    the data give (``penalty_path``); folds are a function of the subject id.
    A subject's cells are placed by voxel, an absent cell is 0. A fit that has
    not converged after ``max_iter`` steps raises.
    """
    lambdas = list(lambdas) if lambdas is not None else penalty_path(images, labels, path_length, path_ratio)
    ids = settle(images.select("voxel_id").distinct())
    ranks = settle(row_numbers(ids, [], "voxel_id", range_cuts(ids, "voxel_id"), "__rank").withColumn("__rank", (F.col("__rank") - 1).cast("int")))
    size = ranks.count()
    cells = voxel_join(images, ranks, ["voxel_id"], row_bytes=48).groupBy("subject_id").agg(
        F.collect_list(F.struct("__rank", F.col("value").cast("double").alias("x"))).alias("cells")
    )
    fold = F.floor(keyed_uniform(seed, "fold", Key("subject_id")) * folds).cast("int")
    wide = labels.join(cells, "subject_id", "left").select(
        F.col("y").cast("int"), fold.alias("fold"), F.coalesce("cells.__rank", F.array().cast("array<int>")).alias("at"),
        F.coalesce("cells.x", F.array().cast("array<double>")).alias("x"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image = np.zeros((batch.num_rows, size))
            for i, (at, x) in enumerate(zip(batch.column("at"), batch.column("x"))):
                image[i, np.asarray(at.values)] = np.nan_to_num(np.asarray(x.values, dtype=float))
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("fold"), pa.array(list(image), pa.list_(pa.float64()))], names=["y", "fold", "image"]
            )

    dense = wide.mapInArrow(place, "y int, fold int, image array<double>")
    # Settled rather than cached: its partitions then follow the data's size.
    rows = settle(dense.select(array_to_vector("image").alias("features"), "y", "fold"))
    model = LogisticRegression(labelCol="y", elasticNetParam=1.0, maxIter=max_iter, tol=1e-9)
    grid = ParamGridBuilder().addGrid(model.regParam, lambdas).build()
    search = CrossValidator(
        estimator=model, estimatorParamMaps=grid, evaluator=ProbabilityError(), numFolds=folds, foldCol="fold",
        parallelism=4,
    )
    best = search.fit(rows).bestModel
    if best.summary.totalIterations >= max_iter:
        raise RuntimeError(f"the L1 fit has not converged after {max_iter} steps")
    spark = images.sparkSession
    # One coefficient per voxel: the fitted model itself, not data.
    coefs = spark.createDataFrame(
        [(best.coefficients.toArray().tolist(), float(best.intercept), float(best.getRegParam()))],
        "coef array<double>, alpha double, penalty double",
    )
    ranked = coefs.select("alpha", "penalty", F.posexplode("coef").alias("__rank", "coef"))
    state = ranks.join(ranked, "__rank")
    return state.select("voxel_id", "coef", (F.col("coef") != 0).cast("int").alias("delta"), "alpha", "penalty")


def random_state(lattice: DataFrame, n_basis: int, seed: int) -> DataFrame:
    """Per voxel delta ~ Bernoulli(1/2) and theta ~ N(0, 1); alpha ~ N(0, 1) and
    a = 1 / Gamma(1/2, 1), the same for all voxels.

    Half a squared standard normal is Gamma(1/2, 1).
    """
    staged = lattice.select(
        "voxel_id",
        keyed_uniform(seed, "delta0", Key("voxel_id")).alias("u"),
        keyed_normals(n_basis, seed, "theta0", Key("voxel_id")).alias("theta"),
        keyed_uniform(seed, "alpha0").alias("__u_alpha"),
        keyed_uniform(seed, "a0").alias("__u_a"),
    )
    root = norm_ppf("__u_a")
    return staged.select(
        "voxel_id", "u", (F.col("u") < 0.5).cast("int").alias("delta"), "theta",
        norm_ppf("__u_alpha").alias("alpha"), (2.0 / (root * root)).alias("a"),
    )


def random_latent(images: DataFrame, state: DataFrame, alpha: float, degree: int, a: float, b: float) -> DataFrame:
    """Starting z = alpha + sum of the selected effects of ``state``; excluded voxels have none."""
    params = state.select("voxel_id", active_delta(state).alias("delta"), "theta")
    rows = voxel_join(images, params, ["voxel_id"], row_bytes=theta_bytes(degree + 1))
    rows = rows.withColumn("__x", F.when(F.col("delta") == 1, F.col("value")))
    wide, names = with_basis_columns(rows, "__x", degree, a, b)
    effect = dot(names, "theta")
    return wide.groupBy("subject_id").agg((F.lit(alpha) + F.coalesce(F.sum(effect), F.lit(0.0))).alias("z"))
