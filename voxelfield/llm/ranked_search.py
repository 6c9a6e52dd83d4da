"""Ranked search with few accumulators, a term at a time.

Documents are indexed by the terms that any query uses. Tasks take blocks of
the index, turn them into posting lists and go through a query's terms from
the rarest to the most frequent. A document gets an accumulator when a term
meets it first; once what the remaining terms can add to a new document is
below the k-th best partial score, no accumulators are created any more, and
the remaining terms update the ones there are. Their scores are exact, so the
best k of all blocks are the best k of all documents.

A task remembers each query's best k so far: their k-th score is the bound from
the start for the blocks after the first. Queries are handed to tasks in groups
of bounded size; a larger set of queries takes several passes.

Terms are maximal runs of ASCII letters and digits and of all characters
beyond ASCII, A-Z lowered. NULL and empty texts have no terms: such documents
are in no result and in no count, such queries return nothing. Rows are
documents (or queries) of their own, also where ids repeat; documents without
an id come last among equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelfield.llm.storage import stored
from voxelfield.llm.text import filled, hand_back, map_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 50
# (query, term) pairs whose queries travel to tasks at once: some 40 MB.
GROUP_PAIRS = 250_000
# Documents and postings of a block.
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 2_000_000
# Parts in which a query's candidates are ranked before they meet.
PARTS = 32
NO_ID = np.iinfo(np.int64).max

INDEX = "doc_id long, n long, terms binary, counts binary"

# Term characters keep themselves, A-Z lowered; all other bytes become a space.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, item_id, term): each query's terms, once each; ``query`` numbers the rows."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long"), lowered.alias("text"))
    found = F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1))
    return rows.select("query", "item_id", F.explode(F.array_distinct(found)).alias("term"))


def grouped(terms: DataFrame, pairs: int = GROUP_PAIRS) -> tuple[DataFrame, int]:
    """``terms`` with a ``group``: queries in groups of about ``pairs`` terms at most, one query at least."""
    total = terms.count()
    if total <= pairs:
        return terms.withColumn("group", F.lit(0).cast("long")), min(1, total)
    groups = 2 * -(-total // pairs)
    return terms.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups))), groups


def index(documents: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(doc_id, n, terms, counts): length of every document and how often each known term occurs in it.

    Terms are int32 numbers in the vocabulary, ascending; documents without
    any term are left out.
    """

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        known = vocabulary.value
        sizes, terms, counts = [], [], []
        for text in filled(part.column("text")).to_pylist():
            words = terms_of(text)
            hits = np.array([i for i in map(known.get, words) if i is not None], dtype=np.int32)
            found, times = np.unique(hits, return_counts=True)
            sizes.append(len(words))
            terms.append(found.tobytes())
            counts.append(times.astype(np.int64).tobytes())
        rows = pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
            names=["doc_id", "n", "terms", "counts"],
        )
        return rows.filter(pa.array(np.array(sizes, dtype=np.int64) > 0))

    return map_slices(documents.select(F.col("doc_id").cast("long"), "text"), handle, INDEX)


def document_counts(indexed: DataFrame, vocabulary: int) -> DataFrame:
    """(term, df): how many documents hold each numbered term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for terms in batch.column("terms").to_pylist():
                held[np.frombuffer(terms, dtype=np.int32)] += 1
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], names=["term", "df"])

    return indexed.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Query:
    """A query's known terms from the rarest to the most frequent, with their weights."""

    number: int
    item_id: int | None
    terms: np.ndarray
    weights: np.ndarray


class Block:
    """Documents of the index as posting lists, each with a part of the score that no query changes."""

    def __init__(self, doc_ids: np.ndarray, sizes: np.ndarray, terms: list[bytes], counts: list[bytes], documents: int, length: int):
        self.doc_ids = doc_ids
        per_doc = np.array([len(t) // 4 for t in terms], dtype=np.int64)
        flat = np.frombuffer(b"".join(terms), dtype=np.int32)
        order = np.argsort(flat, kind="stable")
        tf = np.frombuffer(b"".join(counts), dtype=np.int64)[order]
        self.docs = np.repeat(np.arange(len(sizes)), per_doc)[order]
        m = 100 - 50 + (50 * sizes * documents) // length
        self.parts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.docs])
        self.names, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, len(flat))
        self.most = np.maximum.reduceat(self.parts, starts) if len(starts) else self.parts

    def best(self, query: Query, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, scores) of the block's documents that may be among the query's ``k`` best; ``least`` bounds from below.

        ``least`` is a score that ``k`` documents of other blocks reach.
        """
        place = np.searchsorted(self.names, query.terms)
        there = place < len(self.names)
        there[there] = self.names[place[there]] == query.terms[there]
        place, weights = place[there], query.weights[there]
        gains = weights * self.most[place]
        remaining = np.append(np.cumsum(gains[::-1])[::-1], 0)
        scores = np.zeros(len(self.doc_ids), dtype=np.int64)
        survivors = None
        for i, (at, weight) in enumerate(zip(place, weights)):
            # A document that is still without accumulator can reach remaining[i] at most, one with it has what came before.
            if survivors is None and (remaining[i] < least or (2 * remaining[i] < remaining[0] and remaining[i] < _kth(scores, k))):
                survivors = scores > 0
            docs = self.docs[self.starts[at] : self.starts[at + 1]]
            add = weight * self.parts[self.starts[at] : self.starts[at + 1]]
            if survivors is not None:
                old = survivors[docs]
                docs, add = docs[old], add[old]
            scores[docs] += add
        found = np.flatnonzero(scores > 0 if least <= 0 else scores >= least)
        return top(self.doc_ids[found], scores[found], k)


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th best score, 0 where fewer documents have one."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def top(doc_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, equal ones by ascending id."""
    order = np.lexsort((doc_ids, -scores))[:k]
    return doc_ids[order], scores[order]


def candidates(indexed: DataFrame, queries: Broadcast, documents: int, length: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): the best ``k`` of each task, for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[Query] = queries.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]

        def take(rows: pa.Table) -> None:
            ids = np.asarray(rows.column("doc_id").fill_null(NO_ID), dtype=np.int64)
            sizes = np.asarray(rows.column("n"), dtype=np.int64)
            block = Block(ids, sizes, rows.column("terms").to_pylist(), rows.column("counts").to_pylist(), documents, length)
            for i, query in enumerate(asked):
                known, scores = best[i]
                more, more_scores = block.best(query, int(scores[-1]) if len(scores) == k else 0, k)
                if len(more):
                    best[i] = top(np.concatenate([known, more]), np.concatenate([scores, more_scores]), k)

        for block in blocks(batches):
            take(block)
        for query, (ids, scores) in zip(asked, best):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), query.number)), pa.array([query.item_id] * len(ids), pa.int64()),
                    pa.array(ids, mask=ids == NO_ID), pa.array(scores),
                ],
                names=["query", "item_id", "doc_id", "score"],
            )
        hand_back()

    return indexed.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of the index in blocks of at most ``BLOCK_DOCS`` documents and about ``BLOCK_POSTINGS`` postings."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column("terms")), dtype=np.int64) // 4
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            room = int(np.searchsorted(ends, before + BLOCK_POSTINGS - postings, side="right"))
            stop = min(batch.num_rows, at + BLOCK_DOCS - docs, max(room, at + (not held)))
            if stop > at:
                held.append(batch.slice(at, stop - at))
                docs, postings, at = docs + stop - at, postings + int(ends[stop - 1] - before), stop
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` of each query, in parts first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    first = found.withColumn("__part", part).withColumn("__no", F.row_number().over(W.partitionBy("query", "__part").orderBy(*order)))
    last = first.where(F.col("__no") <= k).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order)))
    return last.where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(documents: DataFrame, queries: DataFrame, k: int = BEST, pairs: int = GROUP_PAIRS) -> DataFrame:
    """The ``k`` best documents of every query (item_id, text): (item_id, rank, doc_id, score)."""
    spark = documents.sparkSession
    terms, groups = grouped(stored(query_terms(queries), "query-terms"), pairs)
    found = None
    for group in range(groups):
        own = terms.where(F.col("group") == group)
        # A group's terms are bounded by the number of its pairs.
        names = sorted(r.term.encode() for r in own.select("term").distinct().collect())
        if not names:
            continue
        numbers = {name: i for i, name in enumerate(names)}
        indexed = stored(index(documents, spark.sparkContext.broadcast(numbers)), "index")
        documents_with, length = indexed.agg(F.count("*"), F.sum("n")).head()
        if not documents_with:
            break
        w = F.floor(1000 * F.log((2 * F.lit(documents_with) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        weights = {r.term: (r.df, r.w) for r in document_counts(indexed, len(names)).select("term", "df", w.alias("w")).collect()}
        per_query: dict[tuple, list[tuple[int, int, int]]] = {}
        for row in own.collect():
            number = numbers[row.term.encode()]
            df, weight = weights.get(number, (0, 0))
            if weight:  # others add nothing to any score
                per_query.setdefault((row.query, row.item_id), []).append((df, number, weight))
        asked = []
        for (query, item_id), entries in per_query.items():
            _, own_terms, own_weights = zip(*sorted(entries))
            asked.append(Query(query, item_id, np.array(own_terms, dtype=np.int32), np.array(own_weights, dtype=np.int64)))
        part = candidates(indexed, spark.sparkContext.broadcast(asked), documents_with, length, k)
        part = stored(part, "candidates")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return ranked(found, k)
