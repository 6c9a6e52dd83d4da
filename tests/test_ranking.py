import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelfield.operators.evaluate import roc_auc, roc_curve
from voxelfield.operators.ranking import range_cuts, row_numbers, running_totals, value_quantile
from voxelfield.operators.split import stratified_split


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_a_hot_group(spark, descending):
    rows = [("hot" if i % 3 else "cold", i * 37 % 1009, i % 5) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o int, m int")
    cuts = range_cuts(df, "o", 16)
    assert 5 < len(cuts) < 16
    got = {(r.k, r.o): r.total for r in running_totals(df, ["k"], "o", {"total": F.col("m")}, cuts, descending).collect()}
    for k, o, _ in rows:
        want = sum(m for kk, oo, m in rows if kk == k and (oo >= o if descending else oo <= o))
        assert got[(k, o)] == want


def test_cuts_do_not_change_the_result(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "o int")
    for cuts in ([], [3.0], [-5.0, 1.0, 50.0, 99.0, 1e9]):
        assert all(r.o + 1 == r.row_no for r in row_numbers(df, [], "o", cuts).collect())


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_quantile_matches_linear_interpolation(spark, q, n):
    values = np.round(np.random.default_rng(n).exponential(size=n), 1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert value_quantile(df, "v", q).first()[0] == pytest.approx(np.quantile(values, q))


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_split_is_exact_and_layout_independent(spark, partitions):
    df = spark.range(5000).select(F.col("id").alias("subject_id"), (F.col("id") % 10 < 7).cast("int").alias("y"))
    got = stratified_split(df.repartition(partitions), frac=0.9, seed=4)
    counts = {(r.y, r.in_train): r["count"] for r in got.groupBy("y", "in_train").count().collect()}
    assert counts == {(1, True): 3150, (1, False): 350, (0, True): 1350, (0, False): 150}
    assert got.where("in_train").agg(F.sum("subject_id")).first()[0] == stratified_split(df, frac=0.9, seed=4).where(
        "in_train").agg(F.sum("subject_id")).first()[0]


def test_roc_with_ties_and_one_class(spark):
    scores = [("m", i, [0.9, 0.8, 0.8, 0.3, 0.1][i]) for i in range(5)] + [("n", i, 0.5) for i in range(5)]
    pred = spark.createDataFrame(scores, "model string, subject_id long, score double")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate([1, 1, 0, 1, 0])], "subject_id long, y int")
    curve = roc_curve(pred, labels)
    points = {(r.model, r.score): (r.fpr, r.tpr) for r in curve.collect()}
    assert points[("m", 0.8)] == (0.5, pytest.approx(2 / 3))
    auc = {r.model: r.auc for r in roc_auc(curve).collect()}
    assert auc["m"] == pytest.approx((1 * 2 + 0.5 + 1 + 1 + 0) / 6, abs=1 / 6) and auc["n"] == pytest.approx(0.5)
    wins = sum((a > b) + 0.5 * (a == b) for a in (0.9, 0.8, 0.3) for b in (0.8, 0.1)) / 6
    assert auc["m"] == pytest.approx(wins)
    only = roc_auc(roc_curve(pred, labels.withColumn("y", F.lit(0)))).collect()
    assert all(r.auc is None for r in only)
