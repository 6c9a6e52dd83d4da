"""Accuracy, confusion matrix, ROC curve and area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.operators.ranking import range_cuts, running_totals


def accuracy(pred: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of subjects whose label is predicted right; no prediction counts as wrong.

    Keys may be in both tables (a replicate) or in ``pred`` only (a method);
    the latter are scored against all labels.
    """
    shared = [k for k in keys if k in labels.columns]
    right = F.coalesce((F.col("pred") == F.col("y")).cast("double"), F.lit(0.0))
    if len(shared) == len(keys):
        return labels.join(pred, [*shared, "subject_id"], "left").groupBy(*keys).agg(F.avg(right).alias("accuracy"))
    hits = labels.join(pred, [*shared, "subject_id"]).groupBy(*keys).agg(F.sum(right).alias("__hits"))
    sizes = labels.groupBy(*shared).agg(F.count("*").alias("__size"))
    scored = hits.join(sizes, shared) if shared else hits.withColumn("__size", sizes.scalar())
    return scored.select(*keys, (F.col("__hits") / F.col("__size")).alias("accuracy"))


def confusion_matrix(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """(truth, pred_0, pred_1) counts."""
    joined = labels.join(pred, "subject_id")
    return joined.groupBy(F.col("y").alias("truth")).agg(
        F.count_if(F.col("pred") == 0).alias("pred_0"), F.count_if(F.col("pred") == 1).alias("pred_1")
    )


def confusion_summary(matrix: DataFrame, positive: int = 0) -> DataFrame:
    """Accuracy, kappa, sensitivity and specificity; the first level is positive by default."""

    def cell(truth: int, pred: int):
        return F.coalesce(F.sum(F.when(F.col("truth") == truth, F.col(f"pred_{pred}"))), F.lit(0))

    negative = 1 - positive
    counts = matrix.agg(
        cell(positive, positive).alias("tp"), cell(positive, negative).alias("fn"),
        cell(negative, positive).alias("fp"), cell(negative, negative).alias("tn"),
    )
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    n = tp + fn + fp + tn
    observed = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn), n * n)
    return counts.select(
        observed.alias("accuracy"),
        F.try_divide(observed - chance, 1 - chance).alias("kappa"),
        F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"),
    )


def roc_curve(pred: DataFrame, labels: DataFrame, cuts: Sequence[float] | None = None) -> DataFrame:
    """False and true positive rates at every distinct score, per model.

    Scores are counted before anything is ordered, and running counts are
    built from value ranges, so no model's scores pass through one task.
    Each row keeps its own counts ``pos`` and ``neg``.
    """
    cuts = range_cuts(pred, "score") if cuts is None else cuts
    counts = pred.join(labels, "subject_id").groupBy("model", "score").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    running = running_totals(
        counts, ["model"], "score", {"__tp": F.col("pos"), "__fp": F.col("neg")}, cuts, descending=True
    )
    totals = counts.groupBy("model").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    return running.join(totals, "model").select(
        "model", "score", "pos", "neg",
        F.try_divide(F.col("__fp"), F.col("__n")).alias("fpr"),
        F.try_divide(F.col("__tp"), F.col("__p")).alias("tpr"),
    )


def roc_auc(roc: DataFrame) -> DataFrame:
    """Area by the trapezoid rule, one row per model.

    A step is neg / n wide and ends at tpr, having started pos / p below it,
    so the area is a plain sum without looking at the row before.
    """
    sums = roc.groupBy("model").agg(
        F.sum(F.col("neg") * F.col("tpr")).alias("__upper"),
        F.sum(F.col("neg") * F.col("pos")).alias("__corner"),
        F.sum("neg").alias("__n"), F.sum("pos").alias("__p"),
    )
    area = F.try_divide(F.col("__upper") - F.try_divide(F.col("__corner"), 2 * F.col("__p")), F.col("__n"))
    return sums.select("model", area.alias("auc"))
