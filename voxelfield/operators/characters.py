"""Character decoding: flashes of twelve codes, scored and summed by sequence.

Codes 1-6 address one axis of the character grid and 7-12 the other. A
sequence is twelve flashes in ``seq_no`` order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelfield.operators.joins import known_bytes
from voxelfield.operators.ranking import range_cuts, row_numbers

# Flashes per sequence and last code of the first axis.
FLASHES = 12
AXIS_CODES = 6

# Largest row number the planner can cut before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000

# Rows of one character that one task may be handed by the map side; beyond it
# the first rows are found per salt before they are found per character.
HOT_ROWS = 5_000_000
SALTS = 64
SPLIT_BYTES = 128 * 1024 * 1024

# Sums of the same scores in another order differ in the last bits: sums this
# close to the largest, as a share of it, tie with it.
TIE_SHARE = 1e-9


def _code_string(codes: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(codes), lambda c: c.cast("string")), "-")


def true_characters(flashes: DataFrame) -> DataFrame:
    """(char_id, truth): distinct target codes in numeric order, joined by `-`."""
    return flashes.where("is_true = 1").groupBy("char_id").agg(_code_string(F.collect_set("code")).alias("truth"))


def _numbered(flashes: DataFrame, k: int) -> DataFrame:
    """First ``k`` sequences of every character with the row number ``rn``.

    Up to the planner's limit the window is cut on the map side: each task
    forwards at most 12k rows per character, however long a character is. On
    inputs of so many tasks that even these add up, a salted round comes
    first. Longer prefixes are numbered by value range instead.
    """
    last = FLASHES * k
    if last <= GROUP_LIMIT:
        tasks = known_bytes(flashes) // SPLIT_BYTES + 1
        if tasks * last > HOT_ROWS:
            salt = F.pmod(F.xxhash64("seq_no"), F.lit(SALTS))
            share = W.partitionBy("char_id", salt).orderBy("seq_no")
            flashes = flashes.withColumn("rn", F.row_number().over(share)).where(F.col("rn") <= last).drop("rn")
        order = W.partitionBy("char_id").orderBy("seq_no")
        return flashes.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= last)
    numbered = row_numbers(flashes, ["char_id"], "seq_no", range_cuts(flashes, "seq_no"), "rn")
    return numbered.where(F.col("rn") <= last)


def first_k_sequences(flashes: DataFrame, k: int) -> DataFrame:
    return _numbered(flashes, k).drop("rn")


def code_scores(flashes: DataFrame, score: str = "score") -> DataFrame:
    return flashes.groupBy("char_id", "code").agg(F.sum(score).alias("score"))


def predicted_characters(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(char_id, predict): per axis all codes tied at the largest score, joined by `-`.

    Runs on one row per character and code, so a window holds few rows.
    """
    axis = W.partitionBy(*keys, "char_id", F.col("code") <= AXIS_CODES)
    best = scores.withColumn("__best", F.max("score").over(axis))
    ties = best.where(F.col("__best") - F.col("score") <= TIE_SHARE * F.abs("__best"))
    return ties.groupBy(*keys, "char_id").agg(_code_string(F.collect_set("code")).alias("predict"))


def character_accuracy(flashes: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Share of characters decoded right from their first ``k`` sequences."""
    predicted = predicted_characters(code_scores(first_k_sequences(flashes, k), score))
    joined = true_characters(flashes).join(predicted, "char_id", "left")
    return joined.agg(F.avg(F.coalesce((F.col("truth") == F.col("predict")).cast("double"), F.lit(0.0))).alias("accuracy"))


def character_accuracy_curve(flashes: DataFrame, ks: Sequence[int], score_cols: dict[str, str]) -> DataFrame:
    """(k, method, accuracy) for all prefixes and score columns in one pass.

    ``score_cols`` maps method names to columns. Flashes are summed for all
    prefixes in one map-side combined aggregate; nothing is repeated before.
    """
    sequence, numbered = F.ceil(F.col("rn") / FLASHES), _numbered(flashes, max(ks))
    cells = {(k, m): F.sum(F.when(sequence <= k, F.col(c))) for k in ks for m, c in score_cols.items()}
    sums = numbered.groupBy("char_id", "code").agg(*[total.alias(f"__{k}_{m}") for (k, m), total in cells.items()])
    columns = [F.struct(F.lit(k).alias("k"), F.lit(m).alias("method"), F.col(f"__{k}_{m}").alias("score")) for k, m in cells]
    scores = sums.select("char_id", "code", F.explode(F.array(*columns)).alias("c")).select("char_id", "code", "c.*")
    scores = scores.where("score is not null")
    predicted = predicted_characters(scores, ["k", "method"])

    names, prefixes = F.array(*[F.lit(m) for m in score_cols]), F.array(*[F.lit(k) for k in ks])
    wanted = true_characters(flashes).withColumn("k", F.explode(prefixes)).withColumn("method", F.explode(names))
    joined = wanted.join(predicted, ["k", "method", "char_id"], "left")
    right = F.coalesce((F.col("truth") == F.col("predict")).cast("double"), F.lit(0.0))
    return joined.groupBy("k", "method").agg(F.avg(right).alias("accuracy"))
