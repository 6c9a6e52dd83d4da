"""Exact duplicates through a cuckoo-filter index of live digests.

The index is a table with one row per live text: its shard, the shard's number
of buckets, the bucket and 16-bit fingerprint under which a cuckoo filter
holds it, and the content key (full SHA-256), owner and number of copies
stored in that bucket. A shard is one partition of the digests. For
insertions, deletions and lookups a task loads its shard's filter; a
fingerprint's hit is verified by the bucket's stored content, so a false
positive never decides. When an insertion finds no room, the shard doubles its buckets and places the stored
keys anew. Digests can be inserted and deleted at any time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelfield.llm.storage import stored
from voxelfield.llm.text import filled, map_slices

SLOTS = 4
KICKS = 200
FEWEST_BUCKETS = 64
# Live keys a shard is laid out for; the number of shards grows with the rows.
SHARD_KEYS = 100_000
# Parts a digest's rows are combined in before they travel to its shard.
DELIVERIES = 16
# A digest of at least one row in this many is common; there are at most as many common ones.
COMMON = 4096

INDEX = "shard int, buckets int, bucket int, fingerprint int, digest binary, owner long, copies long"
ANSWER = "digest binary, owner long, copies long, asked long"


def digests(documents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, carry, digest): SHA-256 of the text in UTF-8 with A-Z lowered, NULL as empty."""
    columns = ["doc_id", *carry]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.ascii_lower(filled(part.column("__text"))).cast(pa.binary()).to_pylist()
        found = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), found], names=[*columns, "digest"])

    return map_slices(rows, handle, f"{schema}, digest binary", "__text")


@dataclass
class Shard:
    """Cuckoo filter of one shard, with the content that its buckets refer to."""

    buckets: int = FEWEST_BUCKETS
    prints: np.ndarray = field(init=False)
    content: dict[int, list] = field(default_factory=dict)  # place -> [digest, owner, copies]
    false_hits: int = 0
    resizes: int = 0

    def __post_init__(self) -> None:
        self.prints = np.zeros(self.buckets * SLOTS, dtype=np.uint16)

    @staticmethod
    def fingerprint(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "big") or 1

    def home(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "big") & (self.buckets - 1)

    def partner(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _hits(self, digest: bytes):
        """Places whose fingerprint equals the digest's."""
        mark, first = self.fingerprint(digest), self.home(digest)
        for bucket in {first, self.partner(first, mark)}:
            for place in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[place] == mark:
                    yield place

    def find(self, digest: bytes) -> list | None:
        """Stored content of a live digest; hits are verified against it."""
        for place in self._hits(digest):
            entry = self.content[place]
            if entry[0] == digest:
                return entry
            self.false_hits += 1
        return None

    def put(self, bucket: int, mark: int, entry: list) -> bool:
        for place in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.prints[place]:
                self.prints[place], self.content[place] = mark, entry
                return True
        return False

    def _place(self, entry: list) -> list | None:
        """Place an entry, moving others on; the entry left without a place if there is none."""
        mark, bucket = self.fingerprint(entry[0]), self.home(entry[0])
        if self.put(bucket, mark, entry) or self.put(self.partner(bucket, mark), mark, entry):
            return None
        for kick in range(KICKS):
            place = bucket * SLOTS + (mark + kick) % SLOTS
            entry, self.content[place] = self.content[place], entry
            self.prints[place] = mark
            mark = self.fingerprint(entry[0])
            first = self.home(entry[0])
            bucket = self.partner(first, mark) if bucket == first else first
            if self.put(bucket, mark, entry):
                return None
        return entry

    def insert(self, digest: bytes, owner: int | None, copies: int = 1) -> None:
        """Add a digest; a live one gains copies and keeps its largest owner."""
        entry = self.find(digest)
        if entry is not None:
            entry[1] = max((o for o in (entry[1], owner) if o is not None), default=None)
            entry[2] += copies
            return
        left = self._place([digest, owner, copies])
        while left is not None:
            left = self._resize(left)

    def _resize(self, extra: list) -> list | None:
        """Double the buckets and place the stored keys and ``extra`` anew."""
        entries = [*self.content.values(), extra]
        while True:
            self.buckets, self.resizes = self.buckets * 2, self.resizes + 1
            self.prints, self.content = np.zeros(self.buckets * SLOTS, dtype=np.uint16), {}
            if all(self._place(list(e)) is None for e in entries):
                return None

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; others with the same fingerprint stay."""
        for place in self._hits(digest):
            if self.content[place][0] == digest:
                self.prints[place] = 0
                del self.content[place]
                return True
        return False

    def load(self, rows: list[dict]) -> None:
        for row in rows:
            entry = [row["digest"], row["owner"], row["copies"]]
            if not self.put(row["bucket"], row["fingerprint"], entry):
                raise ValueError("index rows do not fit their buckets")

    def rows(self, shard: int) -> pa.Table:
        places = sorted(self.content)
        entries = [self.content[p] for p in places]
        return pa.table(
            {
                "shard": pa.array([shard] * len(places), pa.int32()),
                "buckets": pa.array([self.buckets] * len(places), pa.int32()),
                "bucket": pa.array([p // SLOTS for p in places], pa.int32()),
                "fingerprint": pa.array([int(self.prints[p]) for p in places], pa.int32()),
                "digest": pa.array([e[0] for e in entries], pa.binary()),
                "owner": pa.array([e[1] for e in entries], pa.int64()),
                "copies": pa.array([e[2] for e in entries], pa.int64()),
            }
        )


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def shard_count(rows: int) -> int:
    return max(16, -(-rows // SHARD_KEYS))


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def _changed(index: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """New index rows after ``changes`` (digest, owner, copies, action)."""

    def apply(key: tuple, live: pa.Table, new: pa.Table) -> pa.Table:
        stored_rows = live.to_pylist()
        shard = Shard(stored_rows[0]["buckets"]) if stored_rows else Shard()
        shard.load(stored_rows)
        for digest, owner, copies, action in zip(*(new.column(c).to_pylist() for c in ("digest", "owner", "copies", "action"))):
            if action == "insert":
                shard.insert(digest, owner, copies)
            else:
                shard.delete(digest)
        return shard.rows(key[0].as_py())

    keyed = changes.select(shard_of(shards), "digest", "owner", "copies", "action")
    return index.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(apply, INDEX)


def insert(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """Insert ``rows`` (doc_id, digest).

    Rows of a digest are first combined within ``DELIVERIES`` parts, so a
    digest that most rows share reaches its shard in a few rows.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(DELIVERIES))
    arrivals = rows.groupBy("digest", part).agg(F.max("doc_id").alias("owner"), F.count("*").alias("copies"))
    return _changed(index, arrivals.select("digest", "owner", "copies", F.lit("insert").alias("action")), shards)


def delete(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """Delete the digests of ``rows`` (digest) from the index."""
    gone = rows.select("digest").distinct()
    nothing = [F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("copies"), F.lit("delete").alias("action")]
    return _changed(index, gone.select("digest", *nothing), shards)


def probed(index: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """Answers (``ANSWER``) of the shards' filters to ``asked`` (digest, asked); digests that are not live have none."""

    def probe(key: tuple, live: pa.Table, new: pa.Table) -> pa.Table:
        stored_rows = live.to_pylist()
        shard = Shard(stored_rows[0]["buckets"]) if stored_rows else Shard()
        shard.load(stored_rows)
        asking = zip(new.column("digest").to_pylist(), new.column("asked").to_pylist())
        hits = [(digest, entry[1], entry[2], n) for digest, n in asking if (entry := shard.find(digest)) is not None]
        types = {"digest": pa.binary(), "owner": pa.int64(), "copies": pa.int64(), "asked": pa.int64()}
        return pa.table({c: pa.array([h[i] for h in hits], t) for i, (c, t) in enumerate(types.items())})

    keyed = asked.select(shard_of(shards), "digest", "asked")
    return index.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(probe, ANSWER)


def lookup(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (doc_id, digest) with owner and copies of their live digest, NULL if there is none.

    Each digest is probed once, in its shard's filter. Answers to the at most
    ``COMMON`` digests that many rows ask for are sent to all tasks, so no
    task gets all the rows of one text; the others are joined by digest.
    """
    asked = rows.groupBy("digest").agg(F.count("*").alias("asked"))
    answers = stored(probed(index, asked, shards), "answers")
    common = F.col("asked") * COMMON >= rows.count()
    sent = answers.where(common).select("digest", F.struct("owner", "copies").alias("answer"))
    met = rows.join(F.broadcast(sent), "digest", "left")
    near = met.where("answer is not null").select(*rows.columns, "answer.owner", "answer.copies")
    far = met.where("answer is null").drop("answer").join(answers.where(~common).drop("asked"), "digest", "left")
    return near.unionByName(far.select(*rows.columns, "owner", "copies"))


def exact_duplicates(documents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text and ``carry``; further columns are ignored).

    Returns doc_id, keep_id (largest doc_id among equal texts), group_size,
    kept and text_sha256. Texts are equal when identical after lowering A-Z;
    NULL reads as empty. Rows without a doc_id never own a text that has
    another row; a text none of whose rows has one keeps all of them. Rows
    that repeat the owner's doc_id are all kept. Empty input, empty result.
    """
    rows = stored(digests(documents, carry), "digests")
    shards = shard_count(rows.count())
    index = stored(insert(empty_index(documents.sparkSession), rows, shards), "cuckoo")
    return lookup(index, rows, shards).select(
        "doc_id", *carry, F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
