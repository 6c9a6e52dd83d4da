"""Train / test split that is stratified, exact and layout independent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASH_DIGITS = 3


def stratified_split(
    df: DataFrame, id_col: str = "subject_id", strata: str = "y", frac: float = 0.9, seed: int = 20241111
) -> DataFrame:
    """Add ``in_train``: the first ceil(frac * size) of each stratum in md5 order.

    A stratum may hold most of the rows, so it is never sorted as a whole. The
    md5 prefix splits it into near-equal buckets; bucket sizes decide all
    buckets but one, and only that one is ranked.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    hashed = df.withColumn("__digest", digest).withColumn("__bucket", F.substring("__digest", 1, HASH_DIGITS))

    # At most 16^HASH_DIGITS rows per stratum from here on.
    sizes = hashed.groupBy(strata, "__bucket").agg(F.count("*").alias("__size"))
    per_stratum = W.partitionBy(strata)
    ahead = per_stratum.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    plan = sizes.select(
        F.col(strata).alias("__stratum"),
        F.col("__bucket").alias("__plan_bucket"),
        "__size",
        F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__before"),
        F.ceil(F.round(F.sum("__size").over(per_stratum) * F.lit(frac), 9)).alias("__wanted"),
    )
    marked = hashed.join(
        plan,
        hashed[strata].eqNullSafe(plan["__stratum"]) & (hashed["__bucket"] == plan["__plan_bucket"]),
    )
    all_in = F.col("__before") + F.col("__size") <= F.col("__wanted")
    all_out = F.col("__before") >= F.col("__wanted")
    settled = marked.where(all_in | all_out).withColumn("in_train", all_in)
    order = W.partitionBy("__stratum", "__bucket").orderBy("__digest", id_col)
    edge = marked.where(~(all_in | all_out)).withColumn(
        "in_train", F.col("__before") + F.row_number().over(order) <= F.col("__wanted")
    )
    return settled.unionByName(edge).select(*df.columns, "in_train")
