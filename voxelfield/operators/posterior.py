"""Retained draws, posterior means, traces and chain selection.

Draw tables carry (chain_id, iter, ...), optionally led by a replicate key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.operators.additive import linear_predictor, probit_loglik


def retain_draws(draws: DataFrame, burnin: int, thinning: int) -> DataFrame:
    """Every ``thinning``-th iteration after ``burnin``; ``slot`` counts them from 1."""
    after = F.col("iter") - burnin
    kept = draws.where((F.col("iter") > burnin) & (after % thinning == 0))
    return kept.withColumn("slot", F.floor(after / thinning).cast("int"))


def posterior_mean_voxel(
    draws: DataFrame, n_basis: int, threshold: float = 0.5, keys: Sequence[str] = ("chain_id",)
) -> DataFrame:
    """Mean theta per voxel, and delta = 1 where its mean reaches the threshold."""
    means = draws.groupBy(*keys, "voxel_id").agg(
        F.avg("delta").alias("delta_mean"),
        *[F.avg(F.col("theta")[l]).alias(f"__t{l}") for l in range(n_basis)],
    )
    selected = F.when(F.col("delta_mean") >= F.lit(threshold), 1).otherwise(0)
    theta = F.array(*[f"__t{l}" for l in range(n_basis)])
    return means.select(*keys, "voxel_id", "delta_mean", selected.alias("delta"), theta.alias("theta"))


def posterior_mean_subject(draws: DataFrame, keys: Sequence[str] = ("chain_id",)) -> DataFrame:
    return draws.groupBy(*keys, "subject_id").agg(F.avg("z").alias("z"))


def posterior_mean_global(draws: DataFrame, keys: Sequence[str] = ("chain_id",)) -> DataFrame:
    """Means of alpha, sigma^2 and a (not of their inverses)."""
    return draws.groupBy(*keys).agg(
        F.avg("alpha").alias("alpha"),
        F.avg(1.0 / F.col("inv_sigma_sq")).alias("sigma_sq"),
        F.avg(1.0 / F.col("inv_a")).alias("a"),
    )


def last_radius(draws: DataFrame, keys: Sequence[str] = ("chain_id",)) -> DataFrame:
    return draws.groupBy(*keys, "partition_id").agg(F.max_by("radius", "iter").alias("radius"))


def selected_voxels(post: DataFrame, keys: Sequence[str] = ("chain_id",)) -> DataFrame:
    return post.where("delta = 1").select(*keys, "voxel_id")


def fit_trace(draws: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th iteration of the recorded likelihoods; none if 0."""
    return draws.where(F.col("iter") % every == 0) if every > 0 else draws.limit(0)


def subject_trace(
    draws: DataFrame,
    alpha: DataFrame,
    images: DataFrame,
    labels: DataFrame,
    every: int,
    degree: int,
    a: float,
    b: float,
    keys: Sequence[str] = ("chain_id", "iter"),
) -> DataFrame:
    """Log-likelihood of every subject at every ``every``-th iteration.

    All traced iterations share one pass over the images.
    """
    eta = linear_predictor(images, fit_trace(draws, every), fit_trace(alpha, every), degree, a, b, keys)
    return probit_loglik(eta, labels, keys)


def draw_table(draws: DataFrame, settings: dict[str, int | float]) -> DataFrame:
    """Retained draws with the run settings as constant columns."""
    return draws.withColumns({name: F.lit(value) for name, value in settings.items()})


def chain_dic(
    trace: DataFrame,
    post: DataFrame,
    alpha: DataFrame,
    images: DataFrame,
    labels: DataFrame,
    degree: int,
    a: float,
    b: float,
    keys: Sequence[str] = ("replicate", "chain_id"),
) -> DataFrame:
    """DIC of every chain: twice the mean deviance minus the deviance at the mean."""
    mean_deviance = trace.groupBy(*keys).agg((-2 * F.avg("loglik")).alias("__mean_dev"))
    eta = linear_predictor(images, post, alpha, degree, a, b, keys)
    at_mean = probit_loglik(eta, labels, keys).groupBy(*keys).agg((-2 * F.sum("loglik")).alias("__dev_at_mean"))
    both = mean_deviance.join(at_mean, list(keys))
    return both.select(*keys, (2 * F.col("__mean_dev") - F.col("__dev_at_mean")).alias("dic"))


def select_chain_dic(dics: DataFrame, replicate: str = "replicate") -> DataFrame:
    """The chain with the smallest DIC per replicate; the lowest id wins ties."""
    best = F.min(F.struct("dic", "chain_id"))
    return dics.groupBy(replicate).agg(best.alias("b")).select(replicate, "b.chain_id", "b.dic")
