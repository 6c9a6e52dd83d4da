import hashlib
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelfield.functions import hermite, normal
from voxelfield.functions.keyed import Key, keyed_uniform
from voxelfield.operators import additive, conditionals

NORMAL = NormalDist()


def test_cdf_column_and_array(spark):
    xs = [x / 20 for x in range(-800, 801)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.p for r in df.select("x", normal.norm_cdf("x").alias("p")).collect()]
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs]
    np.testing.assert_allclose(got, want, atol=3e-16)
    np.testing.assert_allclose(normal.norm_cdf_array(np.array(xs)), want, atol=3e-16)
    assert df.select(F.lit(None).cast("double").alias("x")).select(normal.norm_cdf("x")).first()[0] is None


def test_quantile_column_and_array(spark):
    ps = [10.0**-k for k in range(1, 300, 7)] + [i / 1000 for i in range(1, 1000)]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r.z for r in df.select(normal.norm_ppf("p").alias("z")).collect()]
    want = [NORMAL.inv_cdf(p) for p in ps]
    np.testing.assert_allclose(got, want, rtol=1e-13, atol=1e-14)
    np.testing.assert_allclose(normal.norm_ppf_array(np.array(ps)), want, rtol=1e-13, atol=1e-14)


def test_keyed_uniform_is_a_function_of_the_key(spark):
    df = spark.range(50).select("id", keyed_uniform(3, "step", Key("id")).alias("u"))
    for row in df.repartition(7).collect():
        digest = hashlib.md5(f"3|step|{row.id}".encode()).hexdigest()
        assert row.u == (int(digest[:13], 16) + 0.5) / 16**13


def test_basis_column_equals_array_and_is_orthonormal(spark):
    xs = np.linspace(-4, 4, 4001)
    degree, a, b = 20, 0.01, 10.0
    array = hermite.basis_array(xs, degree, a, b)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs[::100])], "voxel_id int, value double")
    got = {r.voxel_id: r.b for r in additive.basis_expand(df, degree, a, b).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(got))], array[::100], atol=1e-12)
    wide = np.linspace(-12, 12, 48001)
    functions = hermite.basis_array(wide, degree, a, b)
    # Eigenfunctions are orthogonal under the weight exp(-2 a x^2), absorbed here.
    gram = functions.T @ functions * (wide[1] - wide[0])
    np.testing.assert_allclose(gram, np.eye(degree + 1), atol=1e-8)


def test_latent_draw_sides_and_far_tails(spark):
    means = [-50.0, -31.0, -29.0, -8.0, -1.0, 0.0, 1.0, 8.0, 29.0, 50.0]
    rows = [(i, m) for i, m in enumerate(means)]
    eta = spark.createDataFrame(rows, "subject_id long, eta double")
    for y in (0, 1):
        labels = spark.createDataFrame([(i, y) for i, _ in rows], "subject_id long, y int")
        for r in conditionals.latent_draw(eta, labels, 5).join(eta, "subject_id").collect():
            assert math.isfinite(r.z) and (r.z > 0 if y else r.z < 0)
            away = r.eta < 0 if y else r.eta > 0
            if away and abs(r.eta) >= 8:
                assert abs(r.z) < 3.0
            if not away and abs(r.eta) >= 8:
                assert abs(r.z - r.eta) < 8


def test_latent_draw_distribution(spark):
    eta = spark.range(20000).select(F.col("id").alias("subject_id"), F.lit(-0.5).alias("eta"))
    labels = eta.select("subject_id", F.lit(1).alias("y"))
    mean = conditionals.latent_draw(eta, labels, 9).agg(F.avg("z")).first()[0]
    hazard = NORMAL.pdf(0.5) / (1 - NORMAL.cdf(0.5))
    assert abs(mean - (-0.5 + hazard)) < 0.02


def test_theta_conditional_against_numpy(spark):
    rng = np.random.default_rng(1)
    degree, a, b, tau, n = 3, 0.01, 5.0, 2.0, 40
    x = rng.normal(0, 0.5, (n, 3))
    z = rng.normal(size=n)
    images = spark.createDataFrame([(i, v, float(x[i, v])) for i in range(n) for v in range(3)],
                                   "subject_id long, voxel_id int, value double")
    theta = [[0.1 * (v + k) for k in range(4)] for v in range(3)]
    state = spark.createDataFrame([(v, int(v != 1), theta[v], v == 2) for v in range(3)],
                                  "voxel_id int, delta int, theta array<double>, excluded boolean")
    basis = hermite.basis_array(x, degree, a, b)
    eta = 0.3 + basis[:, 0] @ theta[0] + basis[:, 2] @ theta[2]
    subjects = spark.createDataFrame([(i, float(z[i]), float(eta[i])) for i in range(n)], "subject_id long, z double, eta double")
    gram = conditionals.voxel_gram(images, degree, a, b)
    cross = conditionals.residual_crossprod(images, state, subjects, degree, a, b)
    rows = {r.voxel_id: r for r in conditionals.theta_conditional(gram, cross, state, tau, 4, 3).collect()}
    assert set(rows) == {0, 1}
    precision = basis[:, 0].T @ basis[:, 0] + tau * np.eye(4)
    rest = z - eta + basis[:, 0] @ theta[0]
    np.testing.assert_allclose(rows[0]["mean"], np.linalg.solve(precision, basis[:, 0].T @ rest), atol=1e-10)
    np.testing.assert_allclose(rows[0]["var"], np.diag(np.linalg.inv(precision)), atol=1e-10)
    np.testing.assert_allclose(rows[1]["mean"], 0)
    np.testing.assert_allclose(rows[1]["var"], 1 / tau)


def test_variance_draws_follow_shape_and_rate(spark):
    state = spark.createDataFrame([(v, [0.5, -0.5]) for v in range(400)], "voxel_id int, theta array<double>")
    scalars = spark.createDataFrame([(0.2, 1.0)], "alpha double, inv_a double")
    drawn = [conditionals.variance_conditional(state, scalars, 2, seed).first() for seed in range(5)]
    for row in drawn:
        assert row["shape"] == 401 and abs(row["rate"] - 101.02) < 1e-9
        assert abs(row["inv_sigma_sq"] - 401 / 101.02) < 1.0
    assert len({row["inv_sigma_sq"] for row in drawn}) == 5
    assert conditionals.variance_conditional(state, scalars, 2, 0, cap=1.0).first()["inv_sigma_sq"] == 1.0


def test_excluded_voxels_have_no_effect_anywhere(spark):
    """A selected, excluded voxel changes nothing and gets no row; other results are those without it."""
    from voxelfield.operators import additive, initial, predict

    rng = np.random.default_rng(2)
    degree, a, b, n = 2, 0.01, 3.0, 30
    x = rng.normal(0, 0.5, (n, 4))
    images = spark.createDataFrame([(i, v, float(x[i, v])) for i in range(n) for v in range(4)], "subject_id long, voxel_id int, value double")
    rows = [(v, 1, [0.3 * (v + 1), -0.2, 0.5], v == 2, 0.4, 1 + v % 2) for v in range(4)]
    state = spark.createDataFrame(rows, "voxel_id int, delta int, theta array<double>, excluded boolean, p double, partition_id int")
    kept = state.where("voxel_id <> 2")
    alpha = spark.createDataFrame([(0.1,)], "alpha double")
    people = spark.createDataFrame([(i, i % 2, float(rng.normal())) for i in range(n)], "subject_id long, y int, z double")
    basis = additive.basis_expand(images, degree, a, b)

    def results(s):
        effects, eta = additive.voxel_effects(basis, s, degree + 1), additive.linear_predictor(images, s, alpha, degree, a, b)
        candidates = s.select("voxel_id", "partition_id", F.lit(1).alias("radius"), (F.col("p") / 2).alias("p"))
        return {
            "effects": effects, "eta": eta, "prob": predict.predict_probability(images, s, alpha, degree, a, b),
            "probit": conditionals.inclusion_logodds_probit(effects, eta, people, s, 1),
            "gaussian": conditionals.inclusion_logodds_gaussian(effects, people.join(eta, "subject_id"), s),
            "radius": conditionals.radius_scores(effects, s, candidates, [1], people, alpha),
            "cross": conditionals.residual_crossprod(images, s, people.join(eta, "subject_id"), degree, a, b),
            "latent": initial.random_latent(images, s, 0.1, degree, a, b), "curve": predict.effect_curve(images, s, degree, a, b),
        }

    want = results(kept)
    for name, df in results(state).items():
        mine, other = (sorted(map(tuple, d.collect()), key=lambda r: str(r[:2])) for d in (df, want[name]))
        assert len(mine) == len(other), name
        for r, s in zip(mine, other):
            np.testing.assert_allclose(np.hstack(r).astype(float), np.hstack(s).astype(float), atol=1e-9, err_msg=name)
    everything = state.withColumn("excluded", F.lit(True))
    assert {r.eta for r in additive.linear_predictor(images, everything, alpha, degree, a, b).collect()} == {0.1}


def test_gamma_draw_is_the_same_in_sql_and_in_the_fit(spark):
    from voxelfield.functions.gamma import gamma_draw, gamma_sql

    df = spark.createDataFrame([(s,) for s in (1.0, 3.5, 20.0, 20.5, 2.9e6)], "shape double")
    for row in df.select("shape", F.expr(gamma_sql("shape", 9, "tau")).alias("draw")).collect():
        assert gamma_draw("9|tau", row.shape) == pytest.approx(row.draw)
    for shape in (1.0, 4.5, 400.0):
        draws = np.array([gamma_draw(f"{i}|tau", shape) for i in range(6000)])
        assert abs(draws.mean() - shape) < 4 * math.sqrt(shape / 6000)
        assert abs(draws.var() / shape - 1) < 0.15
        assert abs(((draws - shape) ** 3).mean() / shape**1.5 - 2 / math.sqrt(shape)) < 0.45


def test_counter_generator():
    """Published values of the generator, and uniforms that do not depend on how they are asked for."""
    from voxelfield.functions import counter

    full = np.full(1, 0xFFFFFFFF, np.uint32)
    assert [int(w[0]) for w in counter.threefry((0, 0), np.zeros(1, np.uint32), np.zeros(1, np.uint32))] == [0x6B200159, 0x99BA4EFE]
    assert [int(w[0]) for w in counter.threefry((0xFFFFFFFF, 0xFFFFFFFF), full, full)] == [0x1CB996FC, 0xBB002BE7]
    key = counter.stream(1, "step", 2)
    u = counter.counter_uniforms(key, np.arange(20_000)[:, None], np.arange(5))
    assert u[777, 3] == counter.counter_uniforms(key, np.array([777]), np.array([3]))[0]
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002
    assert np.abs(np.corrcoef(u.T) - np.eye(5)).max() < 0.03
    ids = np.array([5, 5 + (1 << 32), -1, 5])
    v = counter.id_uniforms(key, ids)
    assert v[0] == v[3] and len(set(v.tolist())) == 3


def test_radius_scores_count_all_subjects(spark):
    """Subjects without a cell in a partition, or without any, count in every score."""
    f = {(0, 0): 0.5, (0, 1): -1.0, (1, 0): 2.0, (2, 1): 0.25}  # (subject, voxel); voxel 0 in partition 1, voxel 1 in 2
    z, alpha, p, cand = {0: 1.0, 1: -0.5, 2: 2.0, 3: 0.75}, 0.3, {0: 0.4, 1: 0.6}, {(0, 1): 0.1, (0, 2): 0.9, (1, 1): 1.0, (1, 2): 0.2}
    effects = spark.createDataFrame([(i, v, x) for (i, v), x in f.items()], "subject_id long, voxel_id int, f double")
    probs = spark.createDataFrame([(v, x, v + 1, False) for v, x in p.items()], "voxel_id int, p double, partition_id int, excluded boolean")
    candidates = spark.createDataFrame([(v + 1, r, v, x) for (v, r), x in cand.items()], "partition_id int, radius int, voxel_id int, p double")
    people = spark.createDataFrame(list(z.items()), "subject_id long, z double")
    scalars = spark.createDataFrame([(alpha,)], "alpha double")
    got = {(r.partition_id, r.radius): r.loglik for r in conditionals.radius_scores(effects, probs, candidates, [1, 2], people, scalars).collect()}
    for part in (1, 2):
        for radius in (1, 2):
            use = {v: cand[(v, radius)] if v + 1 == part else p[v] for v in p}
            rest = [z[i] - alpha - sum(use[v] * x for (j, v), x in f.items() if j == i) for i in z]
            assert got[(part, radius)] == pytest.approx(-0.5 * sum(r * r for r in rest))
