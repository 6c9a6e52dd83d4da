"""The distributed sampler against a plain loop over subjects and voxels."""

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pytest

from voxelfield.functions.counter import counter_uniforms, stream
from voxelfield.functions.hermite import basis_array
from voxelfield.operators.graphs import lattice_graph
from voxelfield.plans import selection_fit
from voxelfield.plans.selection_fit import FitConfig, fit_selection_model

SIDE, N = 4, 60
NORMAL = NormalDist()


def uniform(*parts):
    digest = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / 16**13


def counted(config, step, iteration, first, second):
    """The number of a stream (replicate 0, chain 0) for a pair of counters."""
    return float(counter_uniforms(stream(config.seed, step, iteration, 0, 0), np.array([first]), np.array([second]))[0])


@pytest.fixture(scope="module")
def data(spark):
    """Voxels 5 and 6 carry a threshold signal; voxel 0 is excluded."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.5, (N, SIDE * SIDE))
    signal = 6.0 * x[:, 5] + 5.0 * x[:, 6]
    y = (signal + rng.normal(size=N) > 0).astype(int)
    images = spark.createDataFrame([(i, v, float(x[i, v])) for i in range(N) for v in range(SIDE * SIDE)],
                                   "subject_id long, voxel_id int, value double")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(N)], "subject_id long, y int")
    lattice = spark.createDataFrame(
        [(v, v % SIDE, v // SIDE, 1 + (v % SIDE) // 2, v == 0) for v in range(SIDE * SIDE)],
        "voxel_id int, row int, col int, partition_id int, excluded boolean",
    )
    return x, y, images, labels, lattice


def square_mean(delta, v, radius, masked):
    row, col = v % SIDE, v // SIDE
    cells = [u for u in range(SIDE * SIDE) if abs(u % SIDE - row) <= radius and abs(u // SIDE - col) <= radius]
    kept = [u for u in cells if not (masked and u == 0)]
    return sum(delta[u] for u in kept) / len(kept)


def plain_iteration(x, y, config, iteration, delta, theta, alpha, tau, p, radius):
    """One iteration with full residuals: z, theta of all voxels, alpha, radius, delta of all voxels."""
    basis = basis_array(x, config.degree, config.a, config.b)
    size = config.n_basis
    parts = {v: 1 + (v % SIDE) // 2 for v in range(SIDE * SIDE)}
    active = [v for v in range(SIDE * SIDE) if v != 0]

    def effect(v):
        return basis[:, v] @ theta[v]

    eta = alpha + sum(delta[v] * effect(v) for v in active)
    z = np.empty(N)
    for i in range(N):
        side = 1 if y[i] else -1
        u = counted(config, "z", iteration, i, 0)
        z[i] = side * (side * eta[i] - NORMAL.inv_cdf(u * NORMAL.cdf(side * eta[i])))
    for v in active:
        eps = np.array([NORMAL.inv_cdf(counted(config, "theta", iteration, v, l)) for l in range(size)])
        if delta[v]:
            rest = z - alpha - sum(delta[w] * effect(w) for w in active if w != v)
            root = np.linalg.cholesky(basis[:, v].T @ basis[:, v] + tau * np.eye(size))
            theta[v] = np.linalg.solve(root.T, np.linalg.solve(root, basis[:, v].T @ rest) + eps)
        else:
            theta[v] = eps / math.sqrt(tau)
    rest = z - sum(delta[w] * effect(w) for w in active)
    eps = NORMAL.inv_cdf(uniform(config.seed, "alpha", iteration, 0, 0))
    alpha = rest.sum() / (N + tau) + eps / math.sqrt(N + tau)
    chosen = dict(radius)
    for part in (1, 2):
        fits = []
        for r in config.radii:
            q = {v: square_mean(delta, v, r, False) if parts[v] == part else p[v] for v in active}
            rest = z - alpha - sum(q[v] * effect(v) for v in active)
            fits.append(-0.5 * rest @ rest)
        chosen[part] = config.radii[int(np.argmax(fits))]
    for v in active:
        f = effect(v)
        rest = z - alpha - sum(delta[w] * effect(w) for w in active if w != v)
        odds = rest @ f - 0.5 * f @ f + math.log((p[v] + 2.2e-16) / (1 - p[v] + 2.2e-16))
        delta[v] = int(counted(config, "delta", iteration, v, 0) < 1 / (1 + math.exp(min(-odds, 700))))
    return delta, theta, alpha, chosen


@pytest.mark.parametrize("block", [None, 6])
def test_iteration_equals_plain_loop(spark, data, block):
    x, y, images, labels, lattice = data
    config = FitConfig(degree=2, a=0.01, b=2.0, burnin=0, mcmc_sample=1, thinning=1, radii=(1, 2), seed=11, block_voxels=block,
                       keep_burnin=True)
    fit = fit_selection_model(images, labels, lattice, config)
    rows = {(r.iter, r.voxel_id): r for r in fit.voxel.collect()}
    scalars = {r.iter: r for r in fit.scalar.collect()}
    state = {v: rows[(0, v)] for v in range(SIDE * SIDE)}
    delta = {v: state[v].delta for v in state}
    theta = {v: np.array(state[v].theta) for v in state}
    p = {v: state[v].p for v in state}
    radius = {state[v].partition_id: state[v].radius for v in state}
    for v in range(1, SIDE * SIDE):
        assert p[v] == pytest.approx(square_mean(delta, v, radius[1 + (v % SIDE) // 2], True))
    delta, theta, alpha, chosen = plain_iteration(
        x, y, config, 1, delta, theta, scalars[0].alpha, scalars[0].inv_sigma_sq, p, radius
    )
    assert scalars[1].alpha == pytest.approx(alpha, abs=1e-7)
    for v in range(1, SIDE * SIDE):
        assert rows[(1, v)].delta == delta[v]
        assert rows[(1, v)].radius == chosen[1 + (v % SIDE) // 2]
        np.testing.assert_allclose(rows[(1, v)].theta, theta[v], atol=1e-7)
    assert rows[(1, 0)].delta == 0
    # The trace holds the likelihood of the state of the same iteration.
    basis = basis_array(x, config.degree, config.a, config.b)
    eta = alpha + sum(delta[v] * (basis[:, v] @ theta[v]) for v in range(1, SIDE * SIDE))
    expected = sum(math.log((NORMAL.cdf(e) if t else 1 - NORMAL.cdf(e)) + 2.220446049250313e-16) for e, t in zip(eta, y))
    assert scalars[1].loglik == pytest.approx(expected, abs=1e-6)


def test_draws_do_not_depend_on_the_layout(spark, data, monkeypatch):
    x, y, images, labels, lattice = data

    def draws(block, band=None, chunk=None):
        with monkeypatch.context() as patch:
            patch.setattr(selection_fit, "BAND", band or selection_fit.BAND)
            patch.setattr(selection_fit, "CHUNK_DOUBLES", chunk or selection_fit.CHUNK_DOUBLES)
            config = FitConfig(degree=2, a=0.01, b=2.0, burnin=1, mcmc_sample=3, thinning=1, radii=(1, 2), seed=4, block_voxels=block)
            fit = fit_selection_model(images, labels, lattice, config)
            return {(r.iter, r.voxel_id): r for r in fit.voxel.collect()}, {r.iter: r for r in fit.scalar.collect()}

    voxel, scalar = draws(16)
    assert sorted({i for i, _ in voxel}) == [2, 3, 4] and sorted(scalar) == [0, 1, 2, 3, 4]
    for block, band, chunk in ((6, None, None), (4, 50, 200)):
        other, trace = draws(block, band, chunk)
        for key, r in voxel.items():
            assert (r.delta, r.radius) == (other[key].delta, other[key].radius)
            np.testing.assert_allclose(r.theta, other[key].theta, atol=1e-8)
        for i, r in scalar.items():
            np.testing.assert_allclose(r[3:], trace[i][3:], atol=1e-6)


def test_gaps_subjects_without_cells_and_voxels_without_partition(spark, data):
    """Ids with gaps wider than a block give the draws of dense ids with the same names; nothing is dropped."""
    x, y, images, labels, lattice = data
    config = FitConfig(degree=1, a=0.01, b=2.0, burnin=0, mcmc_sample=2, thinning=1, seed=3, block_voxels=4, radii=(1,))
    name = "case when voxel_id < 8 then voxel_id else voxel_id + 1000 end as voxel_id"
    fit = fit_selection_model(
        images.where("subject_id <> 7").selectExpr("subject_id", name, "value"), labels,
        lattice.selectExpr(name, "row", "col", "if(voxel_id % 5 = 1, null, partition_id) as partition_id", "excluded"), config,
    )
    rows = fit.voxel.collect()
    assert sorted({r.voxel_id for r in rows}) == [v if v < 8 else v + 1000 for v in range(16)]
    assert len(rows) == 32 and all(math.isfinite(r.loglik) for r in fit.scalar.collect())
    last = {r.voxel_id: r for r in rows if r.iter == 2}
    alpha = {r.iter: r for r in fit.scalar.collect()}[2]
    basis = basis_array(x, 1, config.a, config.b)
    eta = np.full(N, alpha.alpha)
    for v in range(1, 16):
        r = last[v if v < 8 else v + 1000]
        eta += np.where(np.arange(N) == 7, 0, r.delta * (basis[:, v] @ np.array(r.theta)))
    want = sum(math.log((NORMAL.cdf(e) if t else 1 - NORMAL.cdf(e)) + 2.220446049250313e-16) for e, t in zip(eta, y))
    assert alpha.loglik == pytest.approx(want, abs=1e-6)


def test_given_map_and_latent_values_start_the_fit(spark, data):
    x, y, images, labels, lattice = data
    config = FitConfig(degree=1, a=0.01, b=2.0, burnin=0, mcmc_sample=1, thinning=1, seed=3, update_theta=False, update_delta=False,
                       update_sigma=False, update_a=False, keep_burnin=True)
    initial = lattice.selectExpr("voxel_id", "0 as delta", "array(0.1D, 0.2D) as theta", "0.5D as alpha", "0.25D as p")
    z = labels.selectExpr("subject_id", "y", "subject_id / 10.0D as z")
    found = {r.iter: r for r in fit_selection_model(images, z, lattice, config, initial=initial).scalar.collect()}
    eps = NORMAL.inv_cdf(uniform(3, "alpha", 0, 0, 0))
    assert found[0].alpha == pytest.approx(sum(i / 10 for i in range(N)) / (N + 1) + eps / math.sqrt(N + 1))


def test_graph_prior_chains_and_latent(spark, data):
    x, y, images, labels, lattice = data
    config = FitConfig(degree=1, a=0.01, b=2.0, burnin=4, mcmc_sample=4, thinning=1, chains=2, seed=5, rule="map",
                       tau_cap=10.0, keep_latent=True)
    fit = fit_selection_model(images, labels, lattice, config, edges=lattice_graph(lattice))
    draws = fit.voxel.where("iter > 4").groupBy("chain_id", "voxel_id").avg("delta").collect()
    mean = {(r.chain_id, r.voxel_id): r["avg(delta)"] for r in draws}
    for chain in (0, 1):
        assert mean[(chain, 5)] == 1.0
        assert mean[(chain, 0)] == 0.0
    latent = fit.subject.join(labels, "subject_id").where("(z > 0) <> (y = 1)").count()
    assert latent == 0 and fit.subject.select("iter").distinct().count() == 4
    assert fit.scalar.where("inv_sigma_sq > 10").count() == 0


def test_switches_keep_parameters(spark, data):
    x, y, images, labels, lattice = data
    config = FitConfig(degree=1, a=0.01, b=2.0, burnin=0, mcmc_sample=2, thinning=1, seed=5, update_theta=False,
                       update_alpha=False, update_delta=False, update_sigma=False, update_a=False)
    initial = lattice.selectExpr("voxel_id", "voxel_id % 2 as delta", "array(0.1D, 0.2D) as theta", "0.5D as alpha")
    fit = fit_selection_model(images, labels, lattice, config, initial=initial)
    assert {(r.alpha, r.inv_sigma_sq) for r in fit.scalar.collect()} == {(0.5, 1.0)} and fit.voxel.count() == 2 * SIDE * SIDE
    assert fit.voxel.where("delta <> voxel_id % 2 or theta[1] <> 0.2").count() == 0


def test_replicates_advance_together_and_do_not_mix(spark, data):
    from pyspark.sql import functions as F

    x, y, images, labels, lattice = data
    config = FitConfig(degree=1, a=0.01, b=2.0, burnin=0, mcmc_sample=2, thinning=1, radii=(1, 2), seed=8)
    alone = fit_selection_model(images.repartition(17), labels, lattice, config)

    def both(df, second):
        return df.withColumn("replicate", F.lit(0)).unionByName(second.withColumn("replicate", F.lit(1)))

    other = lattice.withColumn("excluded", F.col("voxel_id").isin(0, 5)).withColumn("partition_id", F.lit(2))
    fit = fit_selection_model(
        both(images, images.withColumn("value", -F.col("value"))),
        both(labels, labels.where("subject_id < 50")),
        both(lattice, other),
        config,
    )
    mine = {(r.iter, r.voxel_id): r for r in alone.voxel.collect()}
    for r in fit.voxel.where("replicate = 0").collect():
        want = mine[(r.iter, r.voxel_id)]
        assert (r.delta, r.radius) == (want.delta, want.radius) and r.p == pytest.approx(want.p)
        np.testing.assert_allclose(r.theta, want.theta, atol=1e-8)
    second = fit.voxel.where("replicate = 1")
    assert second.where("voxel_id = 5 and delta = 1").count() == 0
    assert second.count() == 2 * SIDE * SIDE
    assert fit.scalar.count() == 6 and fit.scalar.where("loglik is null").count() == 0


def test_fit_to_prediction(spark, data):
    """Fit, posterior means, chain choice, prediction and accuracy in a row."""
    from voxelfield.operators import evaluate, posterior, predict
    from voxelfield.plans.selection_fit import FIT, summarise

    x, y, images, labels, lattice = data
    config = FitConfig(degree=1, a=0.01, b=2.0, burnin=4, mcmc_sample=4, thinning=1, chains=2, seed=2, radii=(1,), initial_a=1.0)
    fit = fit_selection_model(images, labels, lattice, config)
    means = summarise(fit, config)
    dic = posterior.chain_dic(fit.scalar.where("iter > 4"), means["voxel"], means["scalar"], images, labels, 1, 0.01, 2.0, FIT)
    best = posterior.select_chain_dic(dic).first()
    post = means["voxel"].where(f"chain_id = {best.chain_id}")
    alpha = means["scalar"].where(f"chain_id = {best.chain_id}")
    prob = predict.predict_probability(images, post, alpha, 1, 0.01, 2.0)
    assert evaluate.accuracy(predict.predict_label(prob), labels).first()[0] > 0.8
    assert means["radius"].count() == 4


class Stopped(Exception):
    pass


@pytest.mark.parametrize("stop", ["before the mark", "in a step"])
def test_a_stopped_fit_goes_on_behind_its_last_mark(spark, data, monkeypatch, tmp_path, stop):
    x, y, images, labels, lattice = data
    config = FitConfig(degree=2, a=0.01, b=2.0, burnin=0, mcmc_sample=3, thinning=1, radii=(1, 2), seed=4, block_voxels=10, keep_latent=True)
    whole = fit_selection_model(images, labels, lattice, config)
    path = str(tmp_path / "fit")
    commit, advance = selection_fit._Runner.commit, selection_fit._Runner.advance

    def stopping_commit(self, iteration):
        if stop == "before the mark" and iteration == 2:
            raise Stopped
        commit(self, iteration)

    def stopping_advance(self, job):
        if stop == "in a step" and (job.iteration, job.kind) == (3, "delta"):
            raise Stopped
        advance(self, job)

    with monkeypatch.context() as patch:
        patch.setattr(selection_fit, "TRACE_ROWS", 2)
        patch.setattr(selection_fit._Runner, "commit", stopping_commit)
        patch.setattr(selection_fit._Runner, "advance", stopping_advance)
        with pytest.raises(Stopped):
            fit_selection_model(images, labels, lattice, config, path=path)
    monkeypatch.setattr(selection_fit, "TRACE_ROWS", 2)
    resumed = selection_fit.resume_fit(spark, path)
    again = selection_fit.resume_fit(spark, path)  # a finished fit is only read

    def rows(df, *key):
        return {tuple(r[k] for k in key): np.hstack([np.ravel(r[c]).astype(float) for c in df.columns if c not in key]) for r in df.collect()}

    for fit in (resumed, again):
        for name, keys in (("voxel", ("iter", "chain_id", "voxel_id")), ("scalar", ("iter", "chain_id")), ("subject", ("iter", "chain_id", "subject_id"))):
            want, got = rows(getattr(whole, name), *keys), rows(getattr(fit, name), *keys)
            assert set(want) == set(got) and getattr(fit, name).count() == len(want)
            for key in want:
                np.testing.assert_allclose(got[key], want[key], atol=1e-7)
    with pytest.raises(ValueError):
        selection_fit.resume_fit(spark, str(tmp_path / "other"))


def test_tiles_are_summed_once(spark, data, monkeypatch):
    """While no voxel is selected for the first time, no Gram matrix is taken from images."""
    x, y, images, labels, lattice = data
    learned = []
    strips = selection_fit._strips
    monkeypatch.setattr(selection_fit, "_strips", lambda *args: learned.append(1) or strips(*args))
    config = FitConfig(degree=1, a=0.01, b=2.0, burnin=0, mcmc_sample=5, thinning=1, seed=5, update_delta=False)
    initial = lattice.selectExpr("voxel_id", "voxel_id % 2 as delta", "array(0.1D, 0.2D) as theta", "0.5D as alpha")
    fit_selection_model(images, labels, lattice, config, initial=initial)
    assert len(learned) == 1


def test_many_partitions_and_far_apart_cells(spark, data):
    """Every voxel its own partition, and the lattice torn apart: radii by a plain loop, no box around all cells."""
    x, y, images, labels, lattice = data
    far = 3_000_000
    torn = lattice.selectExpr("voxel_id", f"row + if(row > 1, {far}, 0) as row", f"col + if(col > 1, {far}, 0) as col", "voxel_id as partition_id", "excluded")
    config = FitConfig(degree=1, a=0.01, b=2.0, burnin=0, mcmc_sample=1, thinning=1, seed=6, radii=(1, 2), keep_burnin=True,
                       update_theta=False, update_delta=True, update_sigma=False, update_a=False, update_alpha=False, rule="map")
    fit = fit_selection_model(images, labels, torn, config)
    rows = {(r.iter, r.voxel_id): r for r in fit.voxel.collect()}
    quarter = lambda v: (v % SIDE > 1, v // SIDE > 1)
    for (i, v), r in rows.items():
        near = [u for u in range(1, SIDE * SIDE) if quarter(u) == quarter(v)]
        if v:
            assert r.p == pytest.approx(sum(rows[(i, u)].delta for u in near) / len(near))


def test_a_pass_holds_a_few_chunks_of_bounded_size(monkeypatch):
    """What a worker holds follows from the constants, not from the number of subjects."""
    import tracemalloc

    import pyarrow as pa

    voxels, people = 231, 600_000
    config = FitConfig(degree=4, a=0.01, b=10.0)
    chunks = selection_fit._chunk_count(people, voxels, config, 12)
    n = -(-people // chunks)
    assert n * voxels <= selection_fit.CHUNK_DOUBLES
    assert selection_fit._chunk_count(people, 100_000, config, 12) == people / 16  # states are not sent for a single subject
    assert selection_fit._chunk_count(10, 10_000_000, config, 12) == 10
    assert selection_fit._chunk_count(640, voxels, config, 4) == 4

    rng = np.random.default_rng(0)
    row = {"replicate": 0, "key": np.arange(n).tobytes(), "y": (np.arange(n) % 2).astype(np.int8).tobytes(), "z0": np.zeros(n).tobytes(),
           "image": pa.py_buffer(rng.normal(size=(n, voxels)).tobytes()), "z": None, "eta": None}
    state = {"moved": np.arange(voxels), "moved_by": np.ones((voxels, 5)), "alpha": 0.1, "open": np.ones(voxels, bool),
             "delta": np.ones(voxels, np.int8), "theta": np.ones((voxels, 5)), "cuts": np.array([0, voxels])}
    for kind in ("theta", "delta"):
        tracemalloc.start()
        sums = list(selection_fit._products(selection_fit._Job(kind, 0, 2048, 0, False), selection_fit._Chunk(row, config, 1), {0: state}, config))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(sums) == 1 and peak < 48e6

    # Sums of many tasks are read where they lie.
    band = np.arange(selection_fit.BAND, dtype=float)
    column = pa.chunked_array([pa.array([band.tobytes()] * 50, pa.binary()), pa.array([band.tobytes()] * 50, pa.binary())])
    tracemalloc.start()
    total = selection_fit._total(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    np.testing.assert_array_equal(total, 100 * band)
    assert peak < 3 * band.nbytes and band.nbytes * 200 <= 32e6
