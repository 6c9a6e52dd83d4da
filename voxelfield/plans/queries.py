"""One query per operator, over the given tables.

Doubles are rounded to six places (``+ 0.0`` turns -0.0 into 0.0) so that the
order of additions does not show.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelfield.operators import (
    additive,
    characters,
    conditionals,
    evaluate,
    graphs,
    inclusion,
    ingest,
    initial,
    parcels,
    posterior,
    predict,
    screening,
    split,
)
from voxelfield.operators.ranking import range_cuts, row_numbers
from voxelfield.plans import fixtures as fx
from voxelfield.plans.selection_fit import Fit, FitConfig, summarise
from voxelfield.plans.selection_fit import fit_selection_model as run_fit
from voxelfield.session import settle, shared_dir
from voxelfield.sources import datasets, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

D, L, A, B, TAU, SEED = fx.DEGREE, fx.N_BASIS, fx.KERNEL_A, fx.KERNEL_B, fx.TAU, fx.SEED
SETTINGS = {"burnin": 20, "thinning": 4, "mcmc_sample": 5}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(name: str, source: str | None = None):
    return (F.round(F.col(source or name), 6) + 0.0).alias(name)


def items(df: DataFrame, array: str, index: str, value: str) -> DataFrame:
    """Array column as one row per element."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.posexplode(array).alias(index, value)).withColumn(value, F.round(value, 6) + 0.0)


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def basis8(spark: SparkSession, sf: str) -> DataFrame:
    return additive.basis_expand(fx.images8(spark, sf), D, A, B)


def effects8(spark: SparkSession, sf: str) -> DataFrame:
    return additive.voxel_effects(basis8(spark, sf), fx.voxels8(spark, sf), L)


def eta8(spark: SparkSession, sf: str) -> DataFrame:
    return additive.linear_predictor(fx.images8(spark, sf), fx.voxels8(spark, sf), fx.scalars(spark, sf), D, A, B)


def subjects8(spark: SparkSession, sf: str) -> DataFrame:
    return eta8(spark, sf).join(fx.z8(spark, sf), "subject_id")


def images_with(spark: SparkSession, sf: str, subjects: DataFrame, columns: list[str]) -> DataFrame:
    """Long images whose rows carry subject columns, joined before unpacking."""
    wide = fx.table(spark, sf, "embeddings").join(subjects.withColumnRenamed("subject_id", "vec_id"), "vec_id")
    return ingest.image_to_long(wide, "vec_id", "embedding", (8, 8), columns).select(
        "subject_id", "voxel_id", *columns, "value"
    )


def effects_with(spark: SparkSession, sf: str, subjects: DataFrame, columns: list[str]) -> DataFrame:
    basis = additive.basis_expand(images_with(spark, sf, subjects, columns), D, A, B)
    return additive.voxel_effects(basis, fx.voxels8(spark, sf), L)


# Sources and ingest


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    number = F.format_string("%07d", F.col("c_custkey"))
    return fx.table(spark, sf, "customer").select(
        F.concat(F.lit("/scans/"), F.lower("c_mktsegment"), F.lit("_"), number, F.lit(ingest.IMAGE_SUFFIX)).alias("path")
    )


def _phenotype(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select(
        F.lower("c_mktsegment").alias("SITE_ID"), key.alias("SUB_ID"), (key % 2 + 1).cast("int").alias("DX_GROUP"),
        (F.col("c_acctbal") / 100).alias("AGE_AT_SCAN"), (F.col("c_nationkey") % 3).alias("SEX"),
        (F.col("c_nationkey") + 80).alias("FIQ"),
        F.when(F.col("c_acctbal") > 5000, "R").otherwise("L").alias("HANDEDNESS_CATEGORY"),
    )


@query
def list_image_files(spark, sf):
    return ingest.parse_image_paths(_paths(spark, sf))


@query
def read_phenotype(spark, sf):
    path = scratch(spark, "phenotype")
    _phenotype(spark, sf).write.csv(path, header=True)
    schema = "SITE_ID STRING, SUB_ID LONG, DX_GROUP INT, AGE_AT_SCAN DOUBLE, SEX INT, FIQ INT, HANDEDNESS_CATEGORY STRING"
    return files.read_phenotype(spark, path, schema).select(
        "site_id", "sub_id", "DX_GROUP", r6("AGE_AT_SCAN"), "HANDEDNESS_CATEGORY"
    )


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    pheno = ingest.normalise_phenotype(_phenotype(spark, sf)).select(
        F.col("site_id"), "sub_id", "DX_GROUP", "AGE_AT_SCAN", "SEX", "FIQ", "HANDEDNESS_CATEGORY"
    )
    return ingest.match_phenotype(ingest.parse_image_paths(_paths(spark, sf)), pheno)


@query
def match_phenotype(spark, sf):
    return _matched(spark, sf).select("site_id", "sub_id", "filename", "DX_GROUP", r6("AGE_AT_SCAN"))


@query
def covariate_projection(spark, sf):
    return ingest.covariate_projection(_matched(spark, sf), ["sub_id"]).withColumn("AGE_AT_SCAN", r6("AGE_AT_SCAN"))


@query
def image_to_long(spark, sf):
    return ingest.image_to_long(fx.table(spark, sf, "embeddings"), "vec_id", "embedding", (4, 4, 4)).withColumn("value", r6("value"))


@query
def long_to_image(spark, sf):
    images = ingest.long_to_image(fx.images8(spark, sf))
    return items(images, "image", "voxel_id", "value")


@query
def events_to_lattice(spark, sf):
    lattice = ingest.events_to_lattice(
        fx.table(spark, sf, "events"), "user_id", F.hour("ts"), F.dayofweek("ts") - 1, F.col("value"), 24, 7
    )
    return lattice.withColumn("value", r6("value"))


@query
def wide_distance_to_edges(spark, sf):
    names = ["URGENT", "HIGH", "MEDIUM", "NOT_SPECIFIED", "LOW"]
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    wide = fx.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 5 + 1).alias("row_no")).agg(
        *[F.avg(F.when(rank == i + 1, F.col("o_totalprice"))).alias(n) for i, n in enumerate(names)]
    )
    return ingest.wide_distance_to_edges(wide, "row_no", names).withColumn("dist", F.round("dist", 4) + 0.0)


@query
def binarise_outcome(spark, sf):
    return ingest.binarise_outcome(fx.table(spark, sf, "embeddings"), "vec_id", "label", 8)


@query
def save_load_dataset(spark, sf):
    path = scratch(spark, "dataset")
    rows = fx.images8(spark, sf)
    for chain in (1, 2):
        keys = {"dataset": "digits", "sample_size": 150, "replicate": 1, "chain": chain}
        datasets.save_dataset(rows.withColumn("value", F.col("value") * chain), path, keys)
    loaded = datasets.load_dataset(spark, path, dataset="digits", chain=2)
    return loaded.select("subject_id", "voxel_id", r6("value"), "dataset", "sample_size", "replicate", "chain")


# Scaling, screening, partitions, split, starting values


@query
def scale_constant(spark, sf):
    return screening.scale_constant(fx.images8(spark, sf), 255.0).withColumn("value", r6("value"))


@query
def scale_global_maxabs(spark, sf):
    marked = split.stratified_split(fx.labels8(spark, sf), frac=0.9, seed=SEED)
    images = fx.images8(spark, sf)
    train = images.join(marked.where("in_train").select("subject_id"), "subject_id", "left_semi")
    test = images.join(marked.where("not in_train").select("subject_id"), "subject_id", "left_semi")
    scaled = screening.scale_global_maxabs(train, test)
    return scaled[0].withColumn("part", F.lit("train")).unionByName(scaled[1].withColumn("part", F.lit("test"))).withColumn(
        "value", r6("value")
    )


@query
def excluded_voxels(spark, sf):
    images = fx.images8(spark, sf)
    by_sum = screening.excluded_voxels(images, "nonpos_sum").withColumn("mode", F.lit("nonpos_sum"))
    zeroed = images.withColumn("value", F.when(F.col("voxel_id") % 8 < 1, 0.0).otherwise(F.col("value")))
    return by_sum.unionByName(screening.excluded_voxels(zeroed, "all_zero").withColumn("mode", F.lit("all_zero")))


@query
def voxel_variance(spark, sf):
    return screening.voxel_variance(fx.images8(spark, sf)).withColumn("variance", r6("variance"))


@query
def partition_by_threshold(spark, sf):
    return screening.partition_by_threshold(screening.voxel_variance(fx.images8(spark, sf)), 0.0156)


@query
def partition_by_quantile(spark, sf):
    return screening.partition_by_quantile(screening.voxel_variance(fx.images8(spark, sf)), 0.5)


@query
def partition_grid(spark, sf):
    lattice = fx.cells(spark, sf).select("voxel_id", "row", "col")
    n_col = lattice.agg(F.max("col") + 1).first()[0]
    return screening.partition_grid(lattice, fx.LATTICE_ROWS, n_col, 4)


@query
def stratified_split(spark, sf):
    people = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("subject_id"), F.col("o_orderstatus").alias("y"))
    return split.stratified_split(people, frac=0.9, seed=SEED)


@query
def lasso_init(spark, sf):
    """The start of the penalty path, and whether each voxel meets the optimality conditions of the penalty chosen."""
    images, labels = fx.images8(spark, sf), fx.labels8(spark, sf)
    path = initial.penalty_path(images, labels, 20, 0.01)
    state = settle(initial.lasso_init(images, labels, folds=5, seed=SEED, lambdas=path))
    people = images.join(state.select("voxel_id", "coef"), "voxel_id").groupBy("subject_id").agg(F.sum(F.col("value") * F.col("coef")).alias("eta"))
    miss = 1 / (1 + F.exp(-F.col("eta") - F.col("alpha"))) - F.col("y")
    alpha = state.select("alpha").limit(1)
    missed = people.join(labels, "subject_id").withColumn("alpha", alpha.scalar()).select("subject_id", miss.alias("miss"))
    slopes = images.join(missed, "subject_id").groupBy("voxel_id").agg(
        F.avg(F.col("value") * F.col("miss")).alias("slope"), F.stddev_samp("value").alias("spread")
    )
    slope, rest = F.col("slope") / F.col("spread"), F.col("penalty") * F.signum("coef")
    best = F.when(F.col("coef") == 0, F.abs(slope) <= F.col("penalty") + 1e-4).otherwise(F.abs(slope + rest) <= 1e-4)
    return state.join(slopes, "voxel_id").select(
        "voxel_id", F.round(F.lit(path[0]), 6).alias("first_penalty"), best.alias("optimal"),
        F.col("penalty").isin(*path).alias("on_path"),
    )


@query
def random_init(spark, sf):
    state = initial.random_state(fx.voxels8(spark, sf), L, SEED)
    return items(state, "theta", "l", "theta_l").withColumns({"u": r6("u"), "alpha": r6("alpha"), "a": r6("a")})


@query
def random_latent(spark, sf):
    state = fx.voxels8(spark, sf)
    return initial.random_latent(fx.images8(spark, sf), state, 0.3, D, A, B).withColumn("z", r6("z"))


# Parcels and graphs


@query
def remap_labels(spark, sf):
    return parcels.remap_labels(fx.volume_parcels(spark, sf))


@query
def parcel_means(spark, sf):
    return parcels.parcel_means(fx.images8(spark, sf), fx.image_parcels(spark, sf)).withColumn("value", r6("value"))


@query
def parcel_adjacency(spark, sf):
    lists = parcels.parcel_adjacency(fx.volume(spark, sf), fx.volume_parcels(spark, sf))
    return lists.withColumn("neighbors", F.array_join(F.col("neighbors").cast("array<string>"), ","))


@query
def broadcast_parcel_means(spark, sf):
    labels = fx.image_parcels(spark, sf)
    means = parcels.parcel_means(fx.images8(spark, sf), labels)
    return parcels.broadcast_parcel_means(means, labels).withColumn("value", r6("value"))


@query
def roi_voxels(spark, sf):
    return parcels.roi_voxels(fx.volume(spark, sf), fx.volume_parcels(spark, sf), 20)


@query
def shape_mismatch(spark, sf):
    labels = fx.volume_parcels(spark, sf).where("parcel_id > 0")
    return parcels.shape_mismatch(fx.volume(spark, sf), labels)


@query
def voxel_neighbors6(spark, sf):
    inside = fx.volume(spark, sf).join(fx.volume_parcels(spark, sf).where("parcel_id > 0"), "voxel_id", "left_semi")
    return graphs.voxel_neighbors6(inside)


@query
def channel_time_graph(spark, sf):
    return graphs.channel_time_graph(fx.channel_nodes(spark, sf), fx.channel_distances(spark, sf), 1, 2.0)


@query
def lattice_graph(spark, sf):
    return graphs.lattice_graph(fx.cells(spark, sf))


# Inclusion maps


@query
def window_inclusion(spark, sf):
    cells = fx.cells(spark, sf)
    lattice = cells.drop("delta")
    return inclusion.window_inclusion(lattice, cells, fx.radius_by_partition(spark, sf), [1, 2]).withColumn("p", r6("p"))


@query
def window_inclusion_masked(spark, sf):
    cells = fx.cells(spark, sf)
    probs = inclusion.window_inclusion_masked(
        cells.drop("delta"), cells, fx.radius_by_partition(spark, sf), [1, 2], 0.1, 0.9
    )
    return probs.withColumn("p", r6("p"))


@query
def window_inclusion_candidates(spark, sf):
    cells = fx.cells(spark, sf)
    return inclusion.window_inclusion_candidates(cells.drop("delta"), cells, [1, 2]).withColumn("p", r6("p"))


@query
def neighbor_inclusion(spark, sf):
    cells = fx.cells(spark, sf)
    return inclusion.neighbor_inclusion(graphs.lattice_graph(cells), cells).withColumn("p", r6("p"))


@query
def clamp_inclusion(spark, sf):
    cells = fx.cells(spark, sf)
    probs = inclusion.window_inclusion(cells.drop("delta"), cells, fx.radius_by_partition(spark, sf), [1, 2])
    return inclusion.clamp_inclusion(probs).withColumn("p", r6("p"))


# Basis, likelihood, conditionals


@query
def basis_expand(spark, sf):
    return items(basis8(spark, sf), "b", "l", "b_l")


@query
def voxel_effects(spark, sf):
    return effects8(spark, sf).withColumns({"f": r6("f"), "df": r6("df")})


@query
def linear_predictor(spark, sf):
    return eta8(spark, sf).withColumn("eta", r6("eta"))


@query
def probit_loglik(spark, sf):
    return additive.probit_loglik(eta8(spark, sf), fx.labels8(spark, sf)).withColumn("loglik", r6("loglik"))


@query
def total_loglik(spark, sf):
    each = additive.probit_loglik(eta8(spark, sf), fx.labels8(spark, sf))
    return additive.total_loglik(each).withColumn("loglik", r6("loglik"))


@query
def log_posterior(spark, sf):
    each = additive.probit_loglik(eta8(spark, sf), fx.labels8(spark, sf))
    row = fx.scalars(spark, sf).withColumn("loglik", additive.total_loglik(each).scalar())
    return additive.log_posterior(fx.voxels8(spark, sf), row, L).withColumn("logpost", r6("logpost"))


@query
def voxel_gram(spark, sf):
    return conditionals.voxel_gram(fx.images8(spark, sf), D, A, B).withColumn("g", r6("g"))


@query
def residual_crossprod(spark, sf):
    subjects = subjects8(spark, sf)
    images = images_with(spark, sf, subjects, ["z", "eta"])
    sums = conditionals.residual_crossprod(images, fx.voxels8(spark, sf), subjects, D, A, B)
    return items(sums, "c", "l", "c_l")


@query
def theta_conditional(spark, sf):
    """Two basis functions, where the posterior has a closed form."""
    images = fx.images8(spark, sf)
    gram = conditionals.voxel_gram(images, 1, A, B)
    subjects = subjects8(spark, sf)
    rows = images_with(spark, sf, subjects, ["z", "eta"])
    cross = conditionals.residual_crossprod(rows, fx.voxels8(spark, sf), subjects, 1, A, B, state_degree=D)
    drawn = conditionals.theta_conditional(gram, cross, fx.voxels8(spark, sf), TAU, 2, SEED)
    pairs = {f"{n}_{l}": F.round(F.col(n)[l], 6) + 0.0 for n in ("mean", "var", "theta") for l in (0, 1)}
    return drawn.select("voxel_id", "delta", *[c.alias(n) for n, c in pairs.items()])


@query
def inclusion_logodds_probit(spark, sf):
    people = eta8(spark, sf).join(fx.labels8(spark, sf), "subject_id")
    scored = conditionals.inclusion_logodds_probit(
        effects_with(spark, sf, people, ["eta", "y"]), eta8(spark, sf), fx.labels8(spark, sf), fx.voxels8(spark, sf), SEED
    )
    return scored.select("voxel_id", r6("loglik0"), r6("loglik1"), r6("posterior"), "delta")


@query
def inclusion_logodds_gaussian(spark, sf):
    subjects = subjects8(spark, sf)
    scored = conditionals.inclusion_logodds_gaussian(
        effects_with(spark, sf, subjects, ["z", "eta"]), subjects, fx.voxels8(spark, sf)
    )
    return scored.select("voxel_id", r6("ff"), r6("rf"), r6("posterior"), "delta")


def _radius_scores(spark: SparkSession, sf: str) -> DataFrame:
    voxels = fx.voxels8(spark, sf)
    candidates = inclusion.window_inclusion_candidates(voxels.drop("delta"), voxels, [1, 2])
    return conditionals.radius_scores(
        effects8(spark, sf), voxels, candidates, [1, 2], fx.z8(spark, sf), fx.scalars(spark, sf)
    )


@query
def radius_scores(spark, sf):
    return _radius_scores(spark, sf).withColumn("loglik", r6("loglik"))


@query
def radius_select(spark, sf):
    return conditionals.radius_select(_radius_scores(spark, sf), [1, 2]).withColumn("loglik", r6("loglik"))


@query
def alpha_conditional(spark, sf):
    people = subjects8(spark, sf).withColumn("eta0", F.col("eta") - fx.scalars(spark, sf).select("alpha").scalar())
    return conditionals.alpha_conditional(people, TAU, SEED).select(r6("mean"), r6("var"), r6("alpha"))


@query
def latent_draw(spark, sf):
    return conditionals.latent_draw(eta8(spark, sf), fx.labels8(spark, sf), SEED).withColumn("z", r6("z"))


@query
def variance_conditional(spark, sf):
    drawn = conditionals.variance_conditional(fx.voxels8(spark, sf), fx.scalars(spark, sf), L, SEED, cap=10.0)
    return drawn.select(r6("shape"), r6("rate"))


@query
def variance_draw(spark, sf):
    drawn = conditionals.variance_conditional(fx.voxels8(spark, sf), fx.scalars(spark, sf), L, SEED, cap=10.0)
    return drawn.select(r6("shape"), r6("rate"), r6("inv_sigma_sq"), r6("inv_a"))


def _fit_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lattice = fx.voxels8(spark, sf).select("voxel_id", "row", "col", "partition_id", "excluded")
    return fx.images8(spark, sf), fx.labels8(spark, sf), lattice


@query
def fit_selection_model(spark, sf):
    images, labels, lattice = _fit_inputs(spark, sf)
    config = FitConfig(degree=D, a=A, b=B, burnin=1, mcmc_sample=2, thinning=1, radii=(1, 2), seed=SEED)
    fit = run_fit(images, labels, lattice=lattice, config=config)
    return items(fit.voxel, "theta", "l", "theta_l")


@query
def fit_selection_model_graph(spark, sf):
    images, labels, lattice = _fit_inputs(spark, sf)
    config = FitConfig(
        degree=D, a=A, b=B, burnin=1, mcmc_sample=2, thinning=1, chains=2, rule="map", tau_cap=10.0, seed=SEED,
        block_voxels=40,
    )
    fit = run_fit(images, labels, edges=graphs.lattice_graph(lattice), lattice=lattice, config=config)
    return fit.scalar


def _roi_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Voxels of one atlas label, named by their place in the volume, their neighbours, and images of them.

    The region's voxels take the images' places in turn.
    """
    roi = settle(parcels.roi_voxels(fx.volume(spark, sf), fx.volume_parcels(spark, sf), 10).withColumnRenamed("flat_index", "voxel_id"))
    lattice = roi.select("voxel_id", F.lit(False).alias("excluded"))
    ranked = row_numbers(lattice, [], "voxel_id", range_cuts(lattice, "voxel_id"), "at")
    ranked = ranked.select("voxel_id", ((F.col("at") - 1) % 64).cast("int").alias("at"))
    images = fx.images8(spark, sf).withColumnRenamed("voxel_id", "at").join(ranked, "at").select("subject_id", "voxel_id", "value")
    return images, lattice, graphs.voxel_neighbors6(roi)


def _roi_fit(spark: SparkSession, sf: str) -> tuple[Fit, FitConfig]:
    images, lattice, edges = _roi_inputs(spark, sf)
    config = FitConfig(degree=D, a=A, b=B, burnin=0, mcmc_sample=2, thinning=1, seed=SEED)
    return run_fit(images, fx.labels8(spark, sf), lattice=lattice, edges=edges, config=config), config


@query
def fit_roi(spark, sf):
    """A fit on an atlas region, whose voxel ids have gaps: the voxels of each draw."""
    draws = _roi_fit(spark, sf)[0].voxel
    return draws.groupBy("iter").agg(F.count("*").alias("n_voxels"), F.min("voxel_id").alias("first"), F.max("voxel_id").alias("last"))


@query
def fit_roi_means(spark, sf):
    """Posterior means of a fit on an atlas region."""
    fit, config = _roi_fit(spark, sf)
    means = summarise(fit, config)["voxel"]
    return items(means, "theta", "l", "theta_l")


def _still(**moving) -> FitConfig:
    off = {f"update_{name}": False for name in ("theta", "alpha", "delta", "z", "sigma", "a")}
    return FitConfig(degree=D, a=A, b=B, burnin=1, mcmc_sample=3, thinning=1, seed=SEED, radii=(1,), **{**off, **moving})


def _initial8(spark: SparkSession, sf: str) -> DataFrame:
    return fx.voxels8(spark, sf).select("voxel_id", "delta", "theta", "p", F.lit(0.3).alias("alpha"))


@query
def fit_alpha(spark, sf):
    """The sampler with only the intercept moving: its draws have a closed form."""
    images, _, lattice = _fit_inputs(spark, sf)
    labels = fx.labels8(spark, sf).join(fx.z8(spark, sf), "subject_id")
    fit = run_fit(images, labels, lattice, _still(update_alpha=True), initial=_initial8(spark, sf))
    return fit.scalar.select("iter", r6("alpha"), r6("inv_sigma_sq"))


@query
def fit_latent(spark, sf):
    """The sampler with only the latent values moving."""
    images, labels, lattice = _fit_inputs(spark, sf)
    fit = run_fit(images, labels, lattice, _still(update_z=True, keep_latent=True), initial=_initial8(spark, sf))
    return fit.subject.select("iter", "subject_id", r6("z"))


@query
def fit_prior_theta(spark, sf):
    """The sampler without a selected voxel: coefficients are draws of their prior."""
    images, labels, lattice = _fit_inputs(spark, sf)
    start = _initial8(spark, sf).withColumn("delta", F.lit(0))
    fit = run_fit(images, labels, lattice, _still(update_theta=True), initial=start)
    return items(fit.voxel.where("not excluded").select("iter", "voxel_id", "theta"), "theta", "l", "theta_l")


@query
def fit_one_delta(spark, sf):
    """The sampler with one open voxel, whose selection follows the Gaussian log-odds."""
    images, _, lattice = _fit_inputs(spark, sf)
    labels = fx.labels8(spark, sf).join(fx.z8(spark, sf), "subject_id")
    lattice = lattice.withColumn("excluded", F.col("voxel_id") != 20)
    config = _still(update_delta=True, rule="map")
    fit = run_fit(images, labels, lattice, config, initial=_initial8(spark, sf))
    return fit.voxel.select("iter", "voxel_id", "delta")


# Posterior summaries


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return posterior.retain_draws(fx.draws(spark, sf), SETTINGS["burnin"], SETTINGS["thinning"])


@query
def retain_draws(spark, sf):
    return items(_kept(spark, sf), "theta", "l", "theta_l")


def _post(spark: SparkSession, sf: str) -> DataFrame:
    return posterior.posterior_mean_voxel(_kept(spark, sf), L, 0.6)


@query
def posterior_mean(spark, sf):
    return items(_post(spark, sf).withColumn("delta_mean", r6("delta_mean")), "theta", "l", "theta_l")


@query
def posterior_mean_subject(spark, sf):
    kept = posterior.retain_draws(fx.subject_draws(spark, sf), 20, 4)
    return posterior.posterior_mean_subject(kept).withColumn("z", r6("z"))


@query
def posterior_mean_global(spark, sf):
    kept = posterior.retain_draws(fx.global_draws(spark, sf), 20, 4)
    means = posterior.posterior_mean_global(kept)
    return means.select("chain_id", r6("alpha"), r6("sigma_sq"), r6("a"))


@query
def last_radius(spark, sf):
    return posterior.last_radius(fx.radius_draws(spark, sf))


@query
def selected_voxels(spark, sf):
    return posterior.selected_voxels(_post(spark, sf))


@query
def fit_trace(spark, sf):
    return posterior.fit_trace(fx.global_draws(spark, sf), 5).select("chain_id", "iter", r6("loglik"))


@query
def subject_trace(spark, sf):
    """Iterations 0-3 of one chain; iteration i scales the fixed theta by i / 2."""
    times = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("iter")
    draws = fx.voxels8(spark, sf).select("voxel_id", "delta", "theta", "excluded", times, F.lit(0).alias("chain_id"))
    draws = draws.withColumn("theta", F.transform("theta", lambda t: t * F.col("iter") / 2.0))
    alpha = fx.scalars(spark, sf).select("alpha", times, F.lit(0).alias("chain_id"))
    each = posterior.subject_trace(draws, alpha, fx.images8(spark, sf), fx.labels8(spark, sf), 2, D, A, B)
    return each.withColumn("loglik", r6("loglik"))


@query
def draw_table(spark, sf):
    kept = posterior.retain_draws(fx.subject_draws(spark, sf), 20, 4)
    return posterior.draw_table(kept, SETTINGS).withColumn("z", r6("z"))


def _chain_states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three chains over the image voxels; chain c scales the fixed theta by c."""
    chains = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("chain_id")
    post = fx.voxels8(spark, sf).select("voxel_id", "delta", "theta", "excluded", chains).withColumns({
        "replicate": F.lit(1), "theta": F.transform("theta", lambda t: t * F.col("chain_id")),
    })
    alpha = fx.scalars(spark, sf).select("alpha", chains).withColumn("replicate", F.lit(1))
    trace = fx.global_draws(spark, sf).select("chain_id", (F.col("loglik") / F.lit(100.0)).alias("loglik")).withColumn(
        "replicate", F.lit(1)
    )
    return trace, post, alpha


def _dics(spark: SparkSession, sf: str) -> DataFrame:
    trace, post, alpha = _chain_states(spark, sf)
    return posterior.chain_dic(trace, post, alpha, fx.images8(spark, sf), fx.labels8(spark, sf), D, A, B)


@query
def chain_dic(spark, sf):
    return _dics(spark, sf).withColumn("dic", r6("dic"))


@query
def select_chain_dic(spark, sf):
    return posterior.select_chain_dic(_dics(spark, sf)).withColumn("dic", r6("dic"))


# Prediction and evaluation


def _probability(spark: SparkSession, sf: str) -> DataFrame:
    post = fx.voxels8(spark, sf)
    return predict.predict_probability(fx.images8(spark, sf), post, fx.scalars(spark, sf), D, A, B)


@query
def predict_probability(spark, sf):
    return _probability(spark, sf).withColumn("prob", r6("prob"))


@query
def predict_label(spark, sf):
    pred = fx.order_predictions(spark, sf)
    strict = predict.predict_label(pred, 0.7).withColumnRenamed("pred", "above")
    return predict.predict_label(strict, 0.521, inclusive=True).select("subject_id", "above", "pred")


@query
def predict_label_random(spark, sf):
    return predict.predict_label_random(fx.order_predictions(spark, sf), SEED).select("subject_id", "pred")


@query
def predict_linear_probit(spark, sf):
    coef = fx.voxels8(spark, sf).select("voxel_id", F.col("theta")[0].alias("beta"))
    return predict.predict_linear_probit(fx.images8(spark, sf), coef).withColumn("prob", r6("prob"))


@query
def accuracy(spark, sf):
    pred = predict.predict_label(fx.order_predictions(spark, sf), 0.5)
    keyed = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("subject_id"), F.col("o_orderpriority").alias("replicate"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )
    joined = pred.join(keyed.select("subject_id", "replicate"), "subject_id")
    return evaluate.accuracy(joined, keyed, ["replicate"]).withColumn("accuracy", r6("accuracy"))


def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    pred = predict.predict_label(fx.order_predictions(spark, sf), 0.5)
    return evaluate.confusion_matrix(pred, fx.order_labels(spark, sf))


@query
def confusion_matrix(spark, sf):
    return _confusion(spark, sf)


@query
def confusion_summary(spark, sf):
    summary = evaluate.confusion_summary(_confusion(spark, sf))
    return summary.select(r6("accuracy"), r6("kappa"), r6("sensitivity"), r6("specificity"))


@query
def roc_curve(spark, sf):
    curve = evaluate.roc_curve(fx.scores(spark, sf), fx.order_labels(spark, sf))
    return curve.select("model", r6("score"), "pos", "neg", r6("fpr"), r6("tpr"))


@query
def roc_auc(spark, sf):
    curve = evaluate.roc_curve(fx.scores(spark, sf), fx.order_labels(spark, sf))
    return evaluate.roc_auc(curve).withColumn("auc", r6("auc"))


@query
def effect_curve(spark, sf):
    curve = predict.effect_curve(fx.images8(spark, sf), fx.voxels8(spark, sf), D, A, B)
    return curve.withColumns({"x": r6("x"), "y": r6("y")})


# Character decoding


@query
def true_characters(spark, sf):
    return characters.true_characters(fx.flashes(spark, sf))


@query
def first_k_sequences(spark, sf):
    return characters.first_k_sequences(fx.flashes(spark, sf), 3).select("char_id", "seq_no", "code", "is_true", r6("score"))


@query
def code_scores(spark, sf):
    return characters.code_scores(fx.flashes(spark, sf)).withColumn("score", r6("score"))


@query
def predicted_characters(spark, sf):
    return characters.predicted_characters(characters.code_scores(fx.flashes(spark, sf)))


@query
def character_accuracy(spark, sf):
    return characters.character_accuracy(fx.flashes(spark, sf), 4).withColumn("accuracy", r6("accuracy"))


@query
def character_accuracy_curve(spark, sf):
    curve = characters.character_accuracy_curve(
        fx.flashes(spark, sf), range(1, 10), {"score": "score", "score_b": "score_b"}
    )
    return curve.withColumn("accuracy", r6("accuracy"))


@query
def character_accuracy_lineitem(spark, sf):
    curve = characters.character_accuracy_curve(
        fx.flashes_lineitem(spark, sf), range(1, 10), {"score": "score", "score_b": "score_b"}
    )
    return curve.withColumn("accuracy", r6("accuracy"))


@query
def inclusion_map(spark, sf):
    """Images to high-variance voxels to smoothed inclusion map, end to end."""
    lattice = (
        screening.partition_by_quantile(screening.voxel_summary(fx.images8(spark, sf), "all_zero"), 0.5)
        .withColumns({"row": F.col("voxel_id") % 8, "col": F.floor(F.col("voxel_id") / 8).cast("int")})
    )
    delta = lattice.select("voxel_id", F.when(F.col("partition_id") == 1, 1).otherwise(0).alias("delta"))
    radius = lattice.select("partition_id").distinct().withColumn("radius", F.col("partition_id"))
    probs = inclusion.window_inclusion(lattice, delta, radius, [1, 2])
    return probs.join(delta, "voxel_id").select("voxel_id", "delta", r6("p"))
