"""Ranks, running totals and exact quantiles without one big window.

A plain window sorts a whole group in one task, so one group holding a third
of all rows decides the run time. Here the ordering column is first cut into
value ranges; totals per (group, range) give each range its offset, and the
window only runs inside a range. The cut points steer balance only: any cut
points give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelfield.operators.joins import known_bytes

# At 64 MB of ordering column per range, the most ranges hold 4 TB of it (5e11 rows); cut points stay a small list.
FEWEST_RANGES, MOST_RANGES = 64, 65536
RANGE_BYTES = 64 * 1024 * 1024


def range_cuts(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    """At most ``ranges - 1`` increasing cut points, near-equal shares of rows.

    By default the number of ranges grows with the size of ``df``. One map-side
    sketch pass; only the cut points reach the driver.
    """
    numbers = df.select(F.col(column).cast("double").alias(column)).where(F.col(column).isNotNull())
    if ranges is None:
        ranges = max(FEWEST_RANGES, min(MOST_RANGES, known_bytes(numbers) // RANGE_BYTES))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = numbers.approxQuantile(column, shares, 0.25 / ranges) if shares else []
    return sorted({c for c in cuts if c == c and abs(c) != float("inf")})


def with_range(df: DataFrame, column: str, cuts: Sequence[float], out: str = "__range") -> DataFrame:
    """Label every row with the value range of ``column`` (binary search)."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    staged = df.withColumn("__ordering", F.col(column).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol="__ordering", outputCol=out, handleInvalid="keep").transform(staged)
    return bucketed.drop("__ordering").withColumn(out, F.col(out).cast("int"))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: dict[str, Column],
    cuts: Sequence[float],
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums of ``measures`` within ``keys``.

    ``order`` must be unique within ``keys`` and not NULL.
    """
    direction = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    ranged = with_range(df, order, cuts)
    for name, measure in measures.items():
        ranged = ranged.withColumn(f"__m_{name}", measure)
    cell = [*keys, "__range"]
    local = W.partitionBy(*cell).orderBy(direction(F.col(order))).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = ranged.withColumns({f"__in_{m}": F.sum(f"__m_{m}").over(local) for m in measures})

    # One row per (group, range): at most len(cuts) + 2 rows per group.
    before = W.partitionBy(*keys).orderBy(direction(F.col("__range"))).rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy(*cell).agg(*[F.sum(f"__m_{m}").alias(f"__sum_{m}") for m in measures])
    offsets = offsets.select(
        *[F.col(k).alias(f"__k_{k}") for k in cell],
        *[F.coalesce(F.sum(f"__sum_{m}").over(before), F.lit(0)).alias(f"__off_{m}") for m in measures],
    )
    matches = [inside[k].eqNullSafe(offsets[f"__k_{k}"]) for k in cell]
    condition = matches[0]
    for match in matches[1:]:
        condition = condition & match
    joined = inside.join(offsets, condition)
    return joined.select(
        *[inside[c] for c in df.columns],
        *[(F.col(f"__in_{m}") + F.col(f"__off_{m}")).alias(m) for m in measures],
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: str, cuts: Sequence[float], out: str = "row_no"
) -> DataFrame:
    """1-based position by ``order`` (unique within ``keys``)."""
    return running_totals(df, keys, order, {out: F.lit(1).cast("long")}, cuts)


def value_quantile(df: DataFrame, column: str, q: float, cuts: Sequence[float] | None = None) -> DataFrame:
    """Exact quantile with linear interpolation, as a one-row DataFrame.

    Equal values are counted first, so a value shared by many rows is one row.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    cuts = range_cuts(df, column) if cuts is None else cuts
    upto = running_totals(counts, [], column, {"__upto": F.col("__n")}, cuts)
    size = counts.agg(F.sum("__n").alias("__total"))
    position = F.lit(q) * (size.scalar() - 1)
    lower = F.floor(F.col("__position"))
    hit = upto.withColumn("__position", position.cast("double"))
    low = F.min(F.when(F.col("__upto") > lower, F.col(column)))
    high = F.min(F.when(F.col("__upto") > F.least(lower + 1, size.scalar() - 1), F.col(column)))
    share = F.max(F.col("__position") - lower)
    return hit.agg((low + share * (high - low)).alias("quantile"))
