"""Predictions from posterior means or from a linear probit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.functions.hermite import dot, with_basis_columns
from voxelfield.functions.keyed import Key, keyed_uniform
from voxelfield.functions.normal import norm_cdf
from voxelfield.operators.additive import active_voxels, linear_predictor
from voxelfield.operators.joins import theta_bytes, voxel_join


def predict_probability(
    images: DataFrame, post: DataFrame, alpha: DataFrame, degree: int, a: float, b: float, keys: Sequence[str] = ()
) -> DataFrame:
    eta = linear_predictor(images, post, alpha, degree, a, b, keys)
    return eta.select(*keys, "subject_id", norm_cdf("eta").alias("prob"))


def predict_label(pred: DataFrame, cutoff: float = 0.5, inclusive: bool = False) -> DataFrame:
    hit = F.col("prob") >= F.lit(cutoff) if inclusive else F.col("prob") > F.lit(cutoff)
    return pred.withColumn("pred", hit.cast("int"))


def predict_label_random(pred: DataFrame, seed: int) -> DataFrame:
    """y ~ Bernoulli(prob), keyed by subject."""
    u = keyed_uniform(seed, "label", Key("subject_id"))
    return pred.withColumn("pred", (u < F.col("prob")).cast("int"))


def predict_linear_probit(images: DataFrame, coef: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Phi(x . beta) and its label; voxels without coefficient count as 0."""
    rows = voxel_join(images, coef, ["voxel_id"], "left")
    sums = rows.groupBy("subject_id").agg(F.sum(F.col("value") * F.coalesce("beta", F.lit(0.0))).alias("__eta"))
    return predict_label(sums.select("subject_id", norm_cdf("__eta").alias("prob")), cutoff)


def effect_curve(images: DataFrame, post: DataFrame, degree: int, a: float, b: float) -> DataFrame:
    """(voxel_id, x, y) of every selected voxel's fitted function, ordered by x."""
    chosen = active_voxels(post).where("delta = 1").select("voxel_id", "theta")
    wide, names = with_basis_columns(voxel_join(images, chosen, ["voxel_id"], row_bytes=theta_bytes(degree + 1)), "value", degree, a, b)
    effect = dot(names, "theta")
    curve = wide.select("voxel_id", "subject_id", F.col("value").alias("x"), effect.alias("y"))
    return curve.orderBy("voxel_id", "x", "subject_id")
