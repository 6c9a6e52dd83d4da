"""Corpus preparation: language, exact copies, near copies, mixture, tokens.

``STAGES`` are applied in order to ``documents``; each stage's result is
written as Parquet and read again as the next one's input.

* language: documents whose distance to every known language is too large go.
* exact_dedup: of equal texts (A-Z lowered) the row with the largest doc_id stays.
* near_dedup: of each group of near copies the row with the least doc_id stays, of a group without any doc_id one row.
* mix: every source gets its target share of words; see ``mixed_documents``.
* encode: token ids and the digest of the decoded text per document.

Decisions are keyed by doc_id and a hash of doc_id and text, so rows that
repeat a doc_id are told apart, and rows without a doc_id are decided too. Of
several rows that an operator would keep from one group (equal doc_id), the one
with the least hash of all its columns stays. The columns of a row travel as
one, so no further column's name can clash with a stage's own.

Where no row has a language to learn from, the language stage drops texts
without a letter only; such texts go in any case.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelfield.llm import cuckoo, langid, minhash_bayes, mixing, sp_encoding
from voxelfield.llm.storage import place, stored
from voxelfield.operators.joins import voxel_join

KEY = ["__id", "__mark"]
KEY_BYTES = 48


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as ``doc``, with what decides about them."""
    id_, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.xxhash64("doc_id", "text")
    return docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", id_.alias(KEY[0]), mark.alias(KEY[1]))


def _one_of_each(keyed: DataFrame, decided: DataFrame) -> DataFrame:
    """The documents of ``keyed`` that ``decided`` (KEY, kept, __group) keeps, one per group."""
    rows = keyed.select("doc", *KEY)
    gone = stored(decided.where(~F.col("kept")).select(*KEY).distinct(), "gone")
    left = voxel_join(rows, gone, KEY, "left_anti", row_bytes=KEY_BYTES)
    staying = decided.where(F.col("kept") & F.col("__group").isNotNull())
    several = staying.groupBy("__group").agg(F.count("*").alias("n")).where("n > 1").select("__group")
    repeats = stored(staying.join(several, "__group").select(*KEY, "__group").distinct(), "repeats")
    if repeats.isEmpty():
        return left.select("doc.*")
    alone = voxel_join(left, repeats.select(*KEY).distinct(), KEY, "left_anti", row_bytes=KEY_BYTES)
    chosen = left.join(repeats, KEY).groupBy("__group").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return alone.select("doc").unionByName(chosen.select("doc")).select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out()))
    # Columns travel as one, so that none of their names can clash.
    held = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return langid.predict(held, model, ["doc"]).where(~F.col("rejected")).select("doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = cuckoo.exact_duplicates(keyed, KEY)
    return _one_of_each(keyed, found.select(*KEY, "kept", F.col("text_sha256").alias("__group")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = minhash_bayes.near_duplicates(keyed, carry=KEY, class_key="__group")
    return _one_of_each(keyed, stored(found.select(*KEY, "kept", "__group"), "near"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sp_encoding.encode_documents(docs, path, ["doc_id", "lang", "source"])
    decoded = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", decoded)


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

# Language identification, the mixture's permutations and the encoding are not SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = place(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
