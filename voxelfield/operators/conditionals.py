"""Full conditional distributions of the selection model, one state at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelfield.functions.gamma import gamma_sql
from voxelfield.functions.hermite import basis_array, dot, with_basis_columns
from voxelfield.functions.keyed import Key, keyed_normals, keyed_uniform
from voxelfield.functions.normal import EPSILON, EXPONENTIAL_TAIL, norm_cdf, norm_ppf
from voxelfield.operators.additive import active_voxels, log_likelihood, sum_of_squares, with_subject_columns
from voxelfield.operators.joins import theta_bytes, voxel_join

# Voxels whose Gram matrices one task adds up before handing them on.
GRAM_VOXELS = 4096


def voxel_gram(images: DataFrame, degree: int, a: float, b: float) -> DataFrame:
    """(voxel_id, l1, l2, g): the Gram matrix of every voxel's basis.

    Only the values travel to the tasks. A task adds outer products over the
    rows it reads, so what is shuffled is one matrix per task and voxel, not
    one per row.
    """
    size = degree + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"voxel_id": list(held), "cells": [g.ravel() for g in held.values()]})
            held.clear()
            return out

        for batch in batches:
            if not len(batch):
                continue
            ids = batch["voxel_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
            rows = basis_array(batch["value"].to_numpy()[order], degree, a, b)
            for voxel, part in zip(ids[order][starts], np.split(rows, starts[1:])):
                gram = part.T @ part
                held[voxel] = held[voxel] + gram if voxel in held else gram
            if len(held) > GRAM_VOXELS:
                yield flush()
        if held:
            yield flush()

    schema = f"voxel_id {images.schema['voxel_id'].dataType.simpleString()}, cells array<double>"
    values = images.where(F.col("value").isNotNull()).select("voxel_id", "value")
    cells = values.mapInPandas(partial, schema).select("voxel_id", F.posexplode("cells").alias("cell", "g"))
    sums = cells.groupBy("voxel_id", "cell").agg(F.sum("g").alias("g"))
    return sums.select(
        "voxel_id",
        F.floor(F.col("cell") / size).cast("int").alias("l1"),
        (F.col("cell") % size).alias("l2"),
        "g",
    )


def residual_crossprod(
    images: DataFrame, state: DataFrame, subjects: DataFrame, degree: int, a: float, b: float,
    state_degree: int | None = None,
) -> DataFrame:
    """(voxel_id, c): basis transposed times the residual without the voxel itself.

    ``subjects`` has one row per subject with z and eta, unless the images
    carry both. The voxel's own selected effect is recomputed from ``state``
    rather than joined back, and the basis stays in scalar columns, so the
    only wide shuffle is the one per subject, on single values. Excluded voxels
    are skipped.
    """
    own = degree if state_degree is None else state_degree
    params = active_voxels(state).select("voxel_id", "delta", "theta")
    rows = with_subject_columns(images, subjects, ["z", "eta"])
    rows = voxel_join(rows, params, ["voxel_id"], row_bytes=theta_bytes(own + 1))
    wide, names = with_basis_columns(rows, "value", max(degree, own), a, b)
    effect = dot(names[: own + 1], "theta")
    rest = F.col("z") - F.col("eta") + F.col("delta") * effect
    wide = wide.withColumn("__r", rest)
    size = degree + 1
    sums = wide.groupBy("voxel_id").agg(*[F.sum(F.col(names[l]) * F.col("__r")).alias(f"__c{l}") for l in range(size)])
    return sums.select("voxel_id", F.array(*[f"__c{l}" for l in range(size)]).alias("c"))


def theta_conditional(
    gram: DataFrame, crossprod: DataFrame, delta: DataFrame, tau: float, n_basis: int, seed: int
) -> DataFrame:
    """Mean, covariance diagonal and draw of every voxel's coefficients.

    ``delta`` carries (voxel_id, delta, excluded). A voxel that is not
    selected is drawn from its prior N(0, 1/tau); excluded voxels are skipped.
    Voxels are independent here, so whole Arrow batches are solved at once.
    """
    matrices = gram.groupBy("voxel_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l1", "l2", "g"))), lambda s: s["g"]).alias("gram")
    )
    wanted = delta.where(~F.col("excluded")).select("voxel_id", "delta")
    staged = wanted.join(matrices, "voxel_id").join(crossprod, "voxel_id")
    staged = staged.withColumn("eps", keyed_normals(n_basis, seed, "theta", Key("voxel_id")))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        eye = np.eye(n_basis)
        for batch in batches:
            if not len(batch):
                continue
            on = (batch["delta"].to_numpy() == 1)[:, None]
            precision = np.stack(batch["gram"].to_numpy()).reshape(-1, n_basis, n_basis) + tau * eye
            c = np.stack(batch["c"].to_numpy())
            eps = np.stack(batch["eps"].to_numpy())
            root = np.linalg.cholesky(precision)
            cov = np.linalg.inv(precision)
            mean = np.where(on, np.einsum("vij,vj->vi", cov, c), 0.0)
            spread = np.linalg.solve(np.swapaxes(root, 1, 2), eps[..., None])[..., 0]
            draw = mean + np.where(on, spread, eps / np.sqrt(tau))
            var = np.where(on, np.einsum("vii->vi", cov), 1.0 / tau)
            yield pd.DataFrame({
                "voxel_id": batch["voxel_id"], "delta": batch["delta"],
                "mean": list(mean), "var": list(var), "theta": list(draw),
            })

    voxel = gram.schema["voxel_id"].dataType.simpleString()
    schema = f"voxel_id {voxel}, delta int, mean array<double>, var array<double>, theta array<double>"
    return staged.select("voxel_id", F.col("delta").cast("int").alias("delta"), "gram", "c", "eps").mapInPandas(solve, schema)


def _posterior_odds(log_off: Column, log_on: Column) -> Column:
    """exp(on) / (exp(off) + exp(on)), with the larger one taken out first."""
    top = F.greatest(log_off, log_on)
    return F.exp(log_on - top) / (F.exp(log_off - top) + F.exp(log_on - top))


def inclusion_logodds_probit(
    effects: DataFrame, eta: DataFrame, labels: DataFrame, prob: DataFrame, seed: int
) -> DataFrame:
    """Posterior inclusion of every voxel from the probit likelihood of one state.

    Excluded voxels are skipped.
    Subjects are joined once (eta with label), or not at all if the effects
    carry both; the sums per voxel combine map-side, so the last shuffle is
    one row per task and voxel.
    """
    people = eta.join(labels, "subject_id").select("subject_id", "eta", "y")
    both = with_subject_columns(effects, people, ["eta", "y"]).select(
        "voxel_id", "y", (F.col("eta") - F.col("df")).alias("__off"), (F.col("eta") - F.col("df") + F.col("f")).alias("__on")
    )
    both = both.withColumns({"__cdf_off": norm_cdf("__off"), "__cdf_on": norm_cdf("__on")})
    sums = both.groupBy("voxel_id").agg(
        F.sum(log_likelihood(F.col("y"), F.col("__cdf_off"))).alias("loglik0"),
        F.sum(log_likelihood(F.col("y"), F.col("__cdf_on"))).alias("loglik1"),
    )
    scored = sums.join(active_voxels(prob).select("voxel_id", "p"), "voxel_id").withColumns({
        "__l0": F.col("loglik0") + F.log(1 - F.col("p") + EPSILON),
        "__l1": F.col("loglik1") + F.log(F.col("p") + EPSILON),
    })
    scored = scored.withColumn("posterior", _posterior_odds(F.col("__l0"), F.col("__l1")))
    draw = keyed_uniform(seed, "delta", Key("voxel_id")) < F.col("posterior")
    return scored.select("voxel_id", "loglik0", "loglik1", "posterior", draw.cast("int").alias("delta"))


def inclusion_logodds_gaussian(
    effects: DataFrame, subjects: DataFrame, prob: DataFrame, rule: str = "map", seed: int = 0
) -> DataFrame:
    """Posterior inclusion of every voxel that is not excluded given the latent z (Gaussian form).

    ``rule`` is ``map`` (1 where the posterior reaches 0.5) or ``bernoulli``.
    """
    rows = with_subject_columns(effects, subjects, ["z", "eta"])
    rows = rows.withColumn("__r", F.col("z") - F.col("eta") + F.col("df"))
    sums = rows.groupBy("voxel_id").agg(
        F.sum(F.col("f") * F.col("f")).alias("ff"), F.sum(F.col("__r") * F.col("f")).alias("rf")
    )
    scored = sums.join(active_voxels(prob).select("voxel_id", "p"), "voxel_id")
    against = 0.5 * F.col("ff") - F.col("rf") + F.log((1 - F.col("p") + EPSILON) / (F.col("p") + EPSILON))
    scored = scored.withColumn("__against", against)
    scored = scored.withColumn("posterior", _posterior_odds(F.col("__against"), F.lit(0.0)))
    if rule == "map":
        delta = F.col("posterior") >= 0.5
    elif rule == "bernoulli":
        delta = keyed_uniform(seed, "delta", Key("voxel_id")) < F.col("posterior")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return scored.select("voxel_id", "ff", "rf", "posterior", delta.cast("int").alias("delta"))


def radius_scores(
    effects: DataFrame, probs: DataFrame, candidates: DataFrame, radii: Sequence[int], z: DataFrame, alpha: DataFrame
) -> DataFrame:
    """(partition_id, radius, loglik): fit of the smoothed map at every candidate.

    A candidate changes the map inside one partition only, so each subject
    needs its base sum and one difference per partition and radius. All
    subjects of ``z`` count, also those without a cell in a partition or at all.
    """
    by_radius = candidates.groupBy("voxel_id", "partition_id").pivot("radius", list(radii)).agg(F.first("p"))
    voxels = by_radius.join(active_voxels(probs).select("voxel_id", F.col("p").alias("__p")), "voxel_id")
    shift = {f"__s{r}": F.sum((F.col(f"`{r}`") - F.col("__p")) * F.col("f")).alias(f"__s{r}") for r in radii}
    parts = voxel_join(effects, voxels, ["voxel_id"]).groupBy("subject_id", "partition_id").agg(
        F.sum(F.col("__p") * F.col("f")).alias("__base"), *shift.values()
    )
    moves = F.struct("partition_id", *[F.col(f"__s{r}") for r in radii])
    people = parts.groupBy("subject_id").agg(F.sum("__base").alias("__base"), F.collect_list(moves).alias("__moves"))
    people = z.select("subject_id", "z").join(people, "subject_id", "left")
    rest = F.col("z") - alpha.select("alpha").scalar() - F.coalesce("__base", F.lit(0.0))
    people = people.select(rest.alias("__rest"), "__moves")
    total = people.agg(F.sum(F.col("__rest") * F.col("__rest")).alias("total"))
    spread = people.select("__rest", F.explode("__moves").alias("m")).select("__rest", "m.*")
    # Without a cell in the partition the difference is 0, so only the others change the sum over all subjects.
    changes = spread.groupBy("partition_id").agg(
        *[F.sum(F.col(f"__s{r}") * (F.col(f"__s{r}") - 2 * F.col("__rest"))).alias(f"__c{r}") for r in radii]
    )
    fits = changes.select("partition_id", *[(-0.5 * (total.scalar() + F.col(f"__c{r}"))).alias(str(r)) for r in radii])
    long = fits.unpivot("partition_id", [F.col(f"`{r}`") for r in radii], "radius", "loglik")
    return long.withColumn("radius", F.col("radius").cast("int"))


def radius_select(scores: DataFrame, radii: Sequence[int]) -> DataFrame:
    """Best radius per partition; the first candidate wins ties."""
    position = F.array_position(F.array(*[F.lit(r) for r in radii]), F.col("radius"))
    best = F.max_by("radius", F.struct(F.col("loglik"), -position))
    return scores.groupBy("partition_id").agg(best.alias("radius"), F.max("loglik").alias("loglik"))


def alpha_conditional(subjects: DataFrame, tau: float, seed: int) -> DataFrame:
    """Mean, variance and draw of the intercept; ``subjects`` has z and eta0 (no intercept)."""
    totals = subjects.agg(F.sum(F.col("z") - F.col("eta0")).alias("__sum"), F.count("*").alias("__n"))
    moments = totals.select(
        (F.col("__sum") / (F.col("__n") + tau)).alias("mean"),
        (1.0 / (F.col("__n") + tau)).alias("var"),
        keyed_uniform(seed, "alpha").alias("__u"),
    )
    return moments.select("mean", "var", (F.col("mean") + F.sqrt("var") * norm_ppf("__u")).alias("alpha"))


def latent_draw(eta: DataFrame, labels: DataFrame, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """z ~ N(eta, 1) restricted to z > 0 for y = 1 and z < 0 for y = 0.

    Both cases are the positive case after mirroring; the smaller tail is
    inverted, so accuracy holds far from zero.
    """
    side = F.when(F.col("y") == 1, 1.0).otherwise(-1.0)
    on = [*[k for k in keys if k in labels.columns], "subject_id"]
    staged = eta.join(labels, on).withColumns({
        "__side": side,
        "__u": keyed_uniform(seed, "z", *[Key(k) for k in (*keys, "subject_id")]),
    })
    staged = staged.withColumn("__m", F.col("__side") * F.col("eta"))
    staged = staged.withColumn("__safe", F.greatest(F.col("__m"), F.lit(EXPONENTIAL_TAIL)))
    staged = staged.withColumn("__q", F.col("__u") * norm_cdf("__safe"))
    bulk = F.col("__safe") - norm_ppf("__q")
    far = F.log("__u") / F.col("__m")
    z = F.col("__side") * F.when(F.col("__m") < EXPONENTIAL_TAIL, far).otherwise(bulk)
    return staged.select(*keys, "subject_id", z.alias("z"))


def variance_conditional(
    state: DataFrame, scalars: DataFrame, n_basis: int, seed: int, cap: float | None = None
) -> DataFrame:
    """Shape, rate and draw of tau = 1/sigma^2, then the draw of 1/a.

    The sums are distributed; the draws are expressions on the one resulting
    row and take as many uniforms for few voxels as for many.
    """
    sums = state.agg(F.sum(sum_of_squares("theta")).alias("__sq"), F.count("*").alias("__p"))
    row = sums.withColumns({
        "__alpha": scalars.select("alpha").scalar(), "__inv_a": scalars.select("inv_a").scalar(),
    }).select(
        (0.5 * n_basis * F.col("__p") + 1).alias("shape"),
        (F.col("__inv_a") + 0.5 * F.col("__sq") + 0.5 * F.col("__alpha") * F.col("__alpha")).alias("rate"),
    )
    tau = F.expr(gamma_sql("shape", seed, "tau")) / F.col("rate")
    drawn = row.withColumn("inv_sigma_sq", F.least(tau, F.lit(float(cap))) if cap is not None else tau)
    inv_a = -F.log(keyed_uniform(seed, "inv_a")) / (F.col("inv_sigma_sq") + 1)
    return drawn.select("shape", "rate", "inv_sigma_sq", inv_a.alias("inv_a"))
