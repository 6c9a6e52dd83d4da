"""Language identification by nearest centroid.

A text becomes a vector of hashed character 1- to 3-grams (letters lowered,
everything else a space), weighted by (1 + ln count) * idf and scaled to length
one. The training vectors of each language are clustered by cosine into
``CENTROIDS`` centroids. A text gets the language of the centroid nearest by
cosine; one whose distance is beyond its limit is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxelfield.llm.storage import stored
from voxelfield.llm.text import map_slices

BINS = 1 << 13
CENTROIDS = 4
ROUNDS = 8
# Bound of the sample of labelled rows, per language, that the centroids are fitted on.
SAMPLE_ROWS = 1500
# A model holds CENTROIDS vectors per label and is sent to every task, so labels are bounded.
MOST_LANGUAGES = 2000
# Cosine distance beyond which a text is no known language, for texts of this many letters or more ...
REJECT_DISTANCE = 0.90
# ... and shorter texts are only rejected when they share nothing with any centroid.
REJECT_LETTERS = 40
_STEPS = np.array([1, 0x9E3779B1, 0x85EBCA6B], dtype=np.uint32)
UNKNOWN = "und"


def _letters(text: str) -> np.ndarray:
    """Lowered code points with every non-letter as 32, framed by spaces."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    distinct, at = np.unique(points, return_inverse=True)
    clean = np.array([p if chr(p).isalpha() else 32 for p in distinct.tolist()], dtype=np.uint32)
    return clean[at]


def counts(text: str | None) -> tuple[np.ndarray, int]:
    """N-gram counts in ``BINS`` bins, and the number of letters."""
    points = _letters(text or "")
    space = points == 32
    letters = int(len(points) - space.sum())
    out = np.zeros(BINS, dtype=np.float32)
    if not letters:
        return out, 0
    # Runs of spaces are one.
    points = points[~(space & np.concatenate([[False], space[:-1]]))]
    for n in (1, 2, 3):
        last = len(points) - n + 1
        gram = np.full(last, n, dtype=np.uint32)
        for i in range(n):
            gram = (gram + points[i : i + last] * _STEPS[i]) * np.uint32(0xC2B2AE35)
            gram ^= gram >> np.uint32(15)
        if n == 1:
            gram = gram[points != 32]
        out += np.bincount(gram & np.uint32(BINS - 1), minlength=BINS)
    return out, letters


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero for texts without a letter) and letters."""
    rows, letters = np.zeros((len(texts), BINS), dtype=np.float32), np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        row, letters[i] = counts(text)
        there = row > 0
        row[there] = (1 + np.log(row[there])) * idf[there]
        norm = np.linalg.norm(row)
        rows[i] = row / norm if norm else row
    return rows, letters


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts per bin and texts in all, over every row of ``texts``; partial counts per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BINS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                row, letters = counts(text)
                total += row > 0
                n += letters > 0
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(bins, -1), pa.int32()), pa.array(np.append(total[bins], n), pa.int64())], names=["bin", "n"]
        )

    rows = texts.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    found = {r["bin"]: r["n"] for r in rows}
    return np.array([found.get(b, 0) for b in range(BINS)], dtype=np.float64), int(found.get(-1, 0))


def spherical_means(rows: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by cosine; starts from the first row and then the row farthest from those chosen."""
    chosen = rows[:1]
    while len(chosen) < min(k, len(rows)):
        nearest = (rows @ chosen.T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        chosen = np.vstack([chosen, rows[int(nearest.argmin())]])
    for _ in range(rounds):
        own = (rows @ chosen.T).argmax(axis=1)
        means = [rows[own == c].sum(axis=0) if (own == c).any() else chosen[c] for c in range(len(chosen))]
        chosen = np.array([m / max(np.linalg.norm(m), 1e-12) for m in means], dtype=np.float32)
    return chosen


@dataclass(frozen=True)
class LanguageModel:
    """Of bounded size: ``BINS`` weights and ``CENTROIDS`` vectors of ``BINS`` per language."""

    idf: np.ndarray
    labels: list[str]
    centroids: np.ndarray


def fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from ``documents`` (doc_id, text, lang); rows without a label do not count.

    Document frequencies cover all rows. The centroids of a language are
    fitted on its rows with the least hash of doc_id and text, about
    ``sample_rows`` of them; copies of a row fall in or out together.
    """
    known = documents.where("lang is not null and text is not null")
    frequency, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + np.float32(1)

    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    ranks = known.select("lang", order.alias("order"))
    sizes = ranks.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels; lang is no language column")
    # A hash is uniform, so a share of its range holds about that share of the rows.
    ends = {r["lang"]: float(2**63) * (2 * min(1.0, sample_rows / r["n"]) - 1) for r in sizes}
    end = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])[F.col("lang")] if ends else F.lit(0.0)
    picked = known.withColumn("order", order).where(F.col("order").cast("double") <= end)

    def vectorise(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, letters = vectors(part.column("text").to_pylist(), idf)
        keep = letters > 0
        return pa.RecordBatch.from_arrays(
            [
                part.column("lang").filter(pa.array(keep)),
                part.column("order").filter(pa.array(keep)),
                pa.array([r.tobytes() for r in rows[keep].astype(np.float16)], pa.binary()),
            ],
            names=["lang", "order", "vector"],
        )

    sample = stored(map_slices(picked.select("lang", "order", "text"), vectorise, "lang string, order long, vector binary"), "vectors")

    def cluster(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("order", "ascending"), ("vector", "ascending")])
        packed = b"".join(rows.column("vector").to_pylist())
        means = spherical_means(np.frombuffer(packed, dtype=np.float16).reshape(-1, BINS).astype(np.float32))
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * len(means)), "centroid": pa.array([m.tobytes() for m in means], pa.binary())})

    found = sorted(sample.groupBy("lang").applyInArrow(cluster, "lang string, centroid binary").collect())
    centroids = np.array([np.frombuffer(r["centroid"], dtype=np.float32) for r in found]).reshape(-1, BINS)
    return LanguageModel(idf, [r["lang"] for r in found], centroids)


def predict(documents: DataFrame, model: LanguageModel, columns: list[str]) -> DataFrame:
    """``columns`` of ``documents`` with lang_pred, score, distance and rejected.

    ``und`` and score 0 stand for NULL texts, texts without a letter, and a
    model that has learned no language. Rejected are texts without a letter
    and those too far from every centroid; a model without languages rejects
    no other text. Only the text decides. Ties go to the language that comes
    first.
    """
    sent = documents.sparkSession.sparkContext.broadcast((model.idf, model.labels, model.centroids))
    schema = documents.select(*columns).schema

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        known = LanguageModel(*sent.value)
        rows, letters = vectors(part.column("__text").to_pylist(), known.idf)
        if known.labels:
            cosine = rows @ known.centroids.T
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(rows)), best], 0, 1).astype(np.float64)
        else:
            best, score = np.zeros(len(rows), dtype=int), np.zeros(len(rows))
        there = (letters > 0) & bool(known.labels)
        score = np.where(there, score, 0.0)
        limit = np.where(letters >= REJECT_LETTERS, REJECT_DISTANCE, 1.0)
        far = (1 - score >= limit) & bool(known.labels)
        label = [known.labels[b] if t else UNKNOWN for b, t in zip(best, there)]
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in columns), pa.array(label, pa.string()), pa.array(score), pa.array((letters == 0) | far)],
            names=[*columns, "lang_pred", "score", "rejected"],
        )

    full = StructType(schema.fields).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return map_slices(documents.select(*columns, F.col("text").alias("__text")), handle, full, "__text")


def held_out() -> Column:
    """Rows whose crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text, lang): the fold, the prediction and its score.

    Learns from the rows that are not held out. A NULL doc_id is not held out.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, ["doc_id", "held_out"])
