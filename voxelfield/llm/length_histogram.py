"""Token counts from an exact histogram of encoded lengths.

Documents are encoded whole and aggregated by their number of tokens. Suffix
sums over the histogram then answer, for every context limit, how many
documents and tokens there are, how many tokens are left when texts are
truncated at the limit, and quantiles; the corpus is never read again.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelfield.llm.storage import stored
from voxelfield.llm.text import filled, kept, map_slices

# Lengths per range of the suffix sums.
RANGE = 1024


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(documents: DataFrame, path: str, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns and length: tokens of each whole text by byte-level BPE; NULL reads as empty."""
    columns = list(keep)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*columns).schema) + "length int"

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        known = kept(("bytes", path, pattern), lambda: encoding(path, pattern))
        lengths = [len(known.encode_ordinary(t)) for t in filled(part.column("__text")).to_pylist()]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(lengths, pa.int32())], names=[*columns, "length"])

    return map_slices(documents.select(*columns, F.col("text").alias("__text")), handle, schema, "__text")


def histogram(lengths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, length, n): documents per encoded length, combined before they travel; stored, so that texts are encoded once."""
    return stored(lengths.groupBy(*by, "length").agg(F.count("*").alias("n")), "lengths")


def suffix_sums(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A histogram with, per length taken as context limit, what is at or above it.

    Adds documents, tokens (totals of the group), docs_from and tokens_from
    (lengths at least this one), truncated_tokens (all texts cut at this many
    tokens) and share_upto (share of documents no longer than this: the
    length is the quantile of every level up to it and above the one before).
    Sums run within ranges of ``RANGE`` lengths and across the ranges' totals,
    so no task sees a whole group.
    """
    keys = list(by)
    ranged = counts.withColumn("range", F.floor(F.col("length") / RANGE))
    tokens = F.col("n") * F.col("length")
    inside = W.partitionBy(*keys, "range").orderBy(F.col("length").desc())
    above = W.partitionBy(*keys).orderBy(F.col("range").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "range").agg(F.sum("n").alias("range_n"), F.sum(tokens).alias("range_tokens"))
    totals = totals.select(
        *keys, "range",
        F.coalesce(F.sum("range_n").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("range_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("range_n").over(whole).alias("documents"),
        F.sum("range_tokens").over(whole).alias("tokens"),
    )
    # One row per range and group: keys that are NULL are a group of their own.
    match = F.col("l.range") == F.col("r.range")
    for key in keys:
        match = match & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    within = ranged.withColumn("docs_in", F.sum("n").over(inside)).withColumn("tokens_in", F.sum(tokens).over(inside))
    rows = within.alias("l").join(totals.alias("r"), match)
    docs_from = F.col("docs_in") + F.col("docs_above")
    tokens_from = F.col("tokens_in") + F.col("tokens_above")
    return rows.select(
        *[F.col(f"l.{k}").alias(k) for k in keys], "length", "n", "documents", "tokens",
        docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("tokens") - tokens_from + F.col("length") * docs_from).alias("truncated_tokens"),
        ((F.col("documents") - docs_from + F.col("n")) / F.col("documents")).alias("share_upto"),
    )


def truncated_total(sums: DataFrame, limit: int) -> Column:
    """Tokens left of all texts cut at any ``limit``, from ``suffix_sums``; 0 without documents."""
    longer = F.col("length") > limit
    return sums.agg(F.coalesce(F.sum(F.when(longer, F.col("n") * limit).otherwise(F.col("n") * F.col("length"))), F.lit(0)).alias("tokens")).scalar()


def quantile(sums: DataFrame, level: float) -> Column:
    """Least length whose share of documents reaches ``level``; NULL without documents."""
    return sums.where(F.col("share_upto") >= level).agg(F.min("length")).scalar()
