"""The additive probit model: basis, effects, linear predictor, likelihood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelfield.functions.hermite import array_dot, dot, with_basis_columns
from voxelfield.functions.normal import EPSILON, norm_cdf
from voxelfield.operators.joins import theta_bytes, voxel_join


def basis_expand(images: DataFrame, degree: int, a: float, b: float) -> DataFrame:
    """(subject_id, voxel_id, b): degree + 1 eigenfunctions of every value."""
    wide, names = with_basis_columns(images, "value", degree, a, b)
    return wide.select(*[c for c in images.columns if c != "value"], F.array(*names).alias("b"))


def active_voxels(state: DataFrame) -> DataFrame:
    """Rows of a state that are not excluded; a state without the column excludes none."""
    return state.where(~F.col("excluded")) if "excluded" in state.columns else state


def active_delta(state: DataFrame) -> Column:
    """delta, 0 for excluded voxels."""
    return F.when(F.col("excluded"), 0).otherwise(F.col("delta")) if "excluded" in state.columns else F.col("delta")


def voxel_effects(basis: DataFrame, state: DataFrame, n_basis: int, keys: Sequence[str] = ()) -> DataFrame:
    """Effect f = b . theta of every subject and voxel, and delta * f.

    ``state`` holds one row per voxel (and key) with delta and theta. The
    basis has a fixed length, so the product is unrolled into plain arithmetic.
    Excluded voxels have no effect and no row. Further columns of ``basis`` (say the subject's outcome) are kept.
    """
    params = active_voxels(state).select(*keys, "voxel_id", "delta", "theta")
    shared = [k for k in keys if k in basis.columns]
    joined = voxel_join(basis, params, [*shared, "voxel_id"], row_bytes=theta_bytes(n_basis))
    f = array_dot("b", "theta", n_basis)
    rest = [c for c in basis.columns if c not in {*keys, "subject_id", "voxel_id", "b"}]
    effects = joined.select(*keys, "subject_id", "voxel_id", *rest, "delta", f.alias("f"))
    return effects.withColumn("df", F.col("delta") * F.col("f"))


def with_subject_columns(rows: DataFrame, subjects: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of each row's subject; joined only if the rows lack them.

    Rows unpacked from images that already carry the columns need no shuffle.
    """
    missing = [c for c in columns if c not in rows.columns]
    return rows.join(subjects.select("subject_id", *missing), "subject_id") if missing else rows


def linear_predictor(
    images: DataFrame,
    state: DataFrame,
    alpha: DataFrame,
    degree: int,
    a: float,
    b: float,
    keys: Sequence[str] = (),
) -> DataFrame:
    """eta = alpha + sum of the selected effects, one row per subject (and key).

    One scan of the images, one aggregate per subject. Values of voxels that
    are not selected, or excluded, become NULL before the basis, whose
    arithmetic is then skipped; a subject without selected voxels still gets
    eta = alpha. ``alpha`` has one row per key, or a single row without keys.
    """
    shared = [k for k in keys if k in images.columns]
    params = state.select(*keys, "voxel_id", active_delta(state).alias("delta"), "theta")
    rows = voxel_join(images, params, [*shared, "voxel_id"], row_bytes=theta_bytes(degree + 1))
    rows = rows.withColumn("__x", F.when(F.col("delta") == 1, F.col("value")))
    wide, names = with_basis_columns(rows, "__x", degree, a, b)
    sums = wide.groupBy(*keys, "subject_id").agg(F.coalesce(F.sum(dot(names, "theta")), F.lit(0.0)).alias("__sum"))
    if keys:
        eta = sums.join(alpha.select(*keys, "alpha"), list(keys))
        return eta.select(*keys, "subject_id", (F.col("alpha") + F.col("__sum")).alias("eta"))
    return sums.select("subject_id", (alpha.select("alpha").scalar() + F.col("__sum")).alias("eta"))


def log_likelihood(y: Column, cdf: Column) -> Column:
    return y * F.log(cdf + EPSILON) + (1 - y) * F.log(1 - cdf + EPSILON)


def probit_loglik(eta: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Log-likelihood of every subject."""
    on = [*[k for k in keys if k in labels.columns], "subject_id"]
    joined = eta.join(labels, on).withColumn("__cdf", norm_cdf("eta"))
    return joined.select(*keys, "subject_id", log_likelihood(F.col("y"), F.col("__cdf")).alias("loglik"))


def total_loglik(per_subject: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return per_subject.groupBy(*keys).agg(F.sum("loglik").alias("loglik"))


def sum_of_squares(array: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v * v)


def log_posterior_column(n_basis: int, voxels: str = "p") -> Column:
    """Log posterior density up to a constant, of rows with the scalars, theta_sq, loglik and the number of voxels."""
    tau, inv_a, alpha = F.col("inv_sigma_sq"), F.col("inv_a"), F.col("alpha")
    return (
        2 * F.log(inv_a) - inv_a + 2 * F.log(tau) - inv_a * tau - 0.5 * alpha * alpha * tau
        + 0.5 * n_basis * F.col(voxels) * F.log(tau) - 0.5 * tau * F.col("theta_sq") + F.col("loglik")
    )


def log_posterior(state: DataFrame, scalars: DataFrame, n_basis: int, keys: Sequence[str] = ()) -> DataFrame:
    """Log posterior density up to a constant.

    ``scalars`` has alpha, inv_sigma_sq, inv_a and loglik, one row per key.
    """
    sizes = state.groupBy(*keys).agg(F.sum(sum_of_squares("theta")).alias("theta_sq"), F.count("*").alias("p"))
    value = log_posterior_column(n_basis)
    if keys:
        return scalars.join(sizes, list(keys)).select(*keys, value.alias("logpost"))
    with_sizes = scalars.withColumns({
        "theta_sq": sizes.select("theta_sq").scalar(), "p": sizes.select("p").scalar(),
    })
    return with_sizes.select(value.alias("logpost"))
