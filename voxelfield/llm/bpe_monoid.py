"""Byte-level BPE as a reduction over a tree of parts.

A sequence of tokens is the encoding of its bytes if and only if every two
neighbours are: merging the bytes of both gives just these two. So encodings
of two neighbouring parts can be joined locally. A window around the boundary
is encoded anew; where its outermost tokens fit the tokens left standing
beside it, nothing outside the window can change, and where they do not the
window grows. A part is encoded by halving it until single merges are cheap
and joining the halves up the tree; decoding concatenates up a tree likewise.

A text is first cut by a pattern whose matches are encoded one by one, a match
that is a token as a whole as that token; texts are joined from matches by
plain concatenation. Many short parts are merged in step, as rows of one array.
"""

from __future__ import annotations

import base64
import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.llm.text import filled, kept, map_slices

# Parts of at most this many bytes are merged directly; joins start with this many tokens on either side.
LEAF = 16
WINDOW = 2
# Bytes of a window that are merged by scanning for the best pair; beyond them by a heap.
SCANNED = 48
# Parts merged in step at once, and slots of the table of pairs that merge.
ROWS = 4096
SLOT_BITS = 21
SPREAD = np.uint64(0x9E3779B97F4A7C15)
# Encoded stretches of texts and pairs a task remembers; older ones make room.
REMEMBERED = 150_000
REMEMBERED_CHARS = 48
REMEMBERED_PAIRS = 300_000
# Ids decoded at once at the bottom of the tree.
DECODED = 1024
# White space as the pattern has it. No match goes on from another character into white space, so a text
# can be cut before every run of white space without changing any match.
_SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
STRETCH = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@dataclass
class ByteTable:
    """A vocabulary of ranked byte strings; a lower rank merges first."""

    ranks: dict[bytes, int]
    pattern: str
    fits: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = np.array([b""] * self.size, dtype=object)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = [self.ranks.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("the vocabulary lacks single bytes")
        self.matches = regex.compile(self.pattern).findall
        self.stretches = Stretches(self)
        self._fill_pairs()

    def _fill_pairs(self) -> None:
        """Open-addressed table of the pairs of tokens whose bytes make a token."""
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys, values = (np.fromiter(v, np.uint64, len(pairs)) for v in (pairs.keys(), pairs.values()))
        self.slots = np.full(1 << SLOT_BITS, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.made = np.full(1 << SLOT_BITS, self.size, dtype=np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] == np.iinfo(np.uint64).max
            self.slots[at[free]] = keys[free]  # of several keys one stays
            placed = self.slots[at] == keys
            self.made[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair's union; ``size`` where it is no token or a token is missing (-1)."""
        out = np.full(len(left), self.size, dtype=np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.uint64) * np.uint64(self.size) + right[todo].astype(np.uint64)
        at = self._slot(keys)
        while len(todo):
            found = self.slots[at]
            hit = found == keys
            out[todo[hit]] = self.made[at[hit]]
            on = ~hit & (found != np.iinfo(np.uint64).max)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) % len(self.slots)
        return out

    def merged_in_step(self, parts: list[bytes]) -> list[bytes]:
        """``merged`` for many parts of at most ``LEAF`` bytes, ids as bytes; a round merges one pair in every row."""
        out = []
        single = np.array(self.single, dtype=np.int64)
        columns = np.arange(LEAF)
        for start in range(0, len(parts), ROWS):
            some = parts[start : start + ROWS]
            lengths = np.array([len(p) for p in some])
            tokens = np.full((len(some), LEAF), -1, dtype=np.int64)
            tokens[columns < lengths[:, None]] = single[np.frombuffer(b"".join(some), dtype=np.uint8)]
            ranks = np.full((len(some), LEAF), self.size, dtype=np.int64)
            ranks[:, :-1] = self.pair_ranks(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(some), -1)
            active = np.arange(len(some))
            while True:
                at = ranks[active].argmin(axis=1)  # the leftmost of the least
                least = ranks[active, at]
                going = least < self.size
                active, at, least = active[going], at[going], least[going]
                if not len(active):
                    break
                source = np.minimum(columns + (columns > at[:, None]), LEAF - 1)
                moved = np.take_along_axis(tokens[active], source, axis=1)
                moved[:, -1] = -1
                rows = np.arange(len(active))
                moved[rows, at] = least
                tokens[active] = moved
                kept_ranks = np.take_along_axis(ranks[active], source, axis=1)
                kept_ranks[:, -1] = self.size
                kept_ranks[rows, at] = self.pair_ranks(least, moved[rows, at + 1])  # the last column starts no pair
                inner = at > 0
                kept_ranks[rows[inner], at[inner] - 1] = self.pair_ranks(moved[rows[inner], at[inner] - 1], moved[rows[inner], at[inner]])
                ranks[active] = kept_ranks
            there = tokens >= 0
            ids, ends = tokens[there].astype(np.uint32).tobytes(), (4 * there.sum(axis=1).cumsum()).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def merged(self, data: bytes) -> list[int]:
        """Ids of ``data`` by merging, always the leftmost pair of the least rank."""
        if len(data) > SCANNED:
            return self._merged_by_heap(data)
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        pairs = [ranks.get(a + b, self.size) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == self.size:
                break
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], self.size)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], self.size)
        return [ranks[p] for p in parts]

    def _merged_by_heap(self, data: bytes) -> list[int]:
        """As ``merged``; parts are named by their first byte's place, a part that is gone ends at 0."""
        n, ranks = len(data), self.ranks
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            after = ends[at]
            if after < n:
                rank = ranks.get(data[at : ends[after]])
                if rank is not None:
                    heapq.heappush(waiting, (rank, at, ends[after]))

        for at in range(n - 1):
            offer(at)
        while waiting:
            _, at, end = heapq.heappop(waiting)
            after = ends[at]
            if not after or after >= n or ends[after] != end:
                continue  # one of the two has changed since
            ends[at], ends[after] = end, 0
            if end < n:
                before[end] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : ends[at]]])
            at = ends[at]
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their bytes are merged together."""
        pair = left * self.size + right
        known = self.fits.get(pair)
        if known is None:
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.fits) >= REMEMBERED_PAIRS:
                self.fits.clear()
            self.fits[pair] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two encodings' bytes: the identity is [], the operation is associative."""
        if not left or not right:
            return left + right
        back, ahead = min(WINDOW, len(left)), min(WINDOW, len(right))
        while True:
            window = left[-back:] + right[:ahead]
            fresh = self.merged(b"".join(self.bytes_of[window].tolist()))
            low = back == len(left) or self.compatible(left[-back - 1], fresh[0])
            high = ahead == len(right) or self.compatible(fresh[-1], right[ahead])
            if low and high:
                return left[:-back] + fresh + right[ahead:]
            if not low:
                back = min(2 * back, len(left))
            if not high:
                ahead = min(2 * ahead, len(right))

    def reduced(self, data: bytes) -> list[int]:
        """Ids of ``data`` by joining its halves; the left one is as large as a full tree can be."""
        if len(data) <= LEAF:
            return self.merged(data)
        half = LEAF << ((len(data) - 1) // LEAF).bit_length() - 1
        return self.join(self.reduced(data[:half]), self.reduced(data[half:]))

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        """Ids of matches as bytes of unsigned 32-bit numbers."""
        datas = [m.encode() for m in matches]
        out: list = [self.ranks.get(d) for d in datas]
        short = [i for i, rank in enumerate(out) if rank is None and len(datas[i]) <= LEAF]
        for i, ids in zip(short, self.merged_in_step([datas[i] for i in short])):
            out[i] = ids
        for i, found in enumerate(out):
            if not isinstance(found, bytes):
                out[i] = np.array(self.reduced(datas[i]) if found is None else [found], dtype=np.uint32).tobytes()
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text."""
        cut = [STRETCH.findall(text) for text in texts]
        known = self.stretches.of({s for stretches in cut for s in stretches})
        return [np.frombuffer(b"".join(map(known.__getitem__, stretches)), dtype=np.uint32) for stretches in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= DECODED:
            return b"".join(self.bytes_of[ids].tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Stretches:
    """Ids of stretches met lately; older ones make room."""

    def __init__(self, table: ByteTable) -> None:
        self.table, self.recent, self.older = table, {}, {}

    def of(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of all wanted stretches, as bytes of unsigned 32-bit numbers."""
        found = {s: ids for s in wanted if (ids := self.recent.get(s) or self.older.get(s)) is not None}
        missing = [s for s in wanted if s not in found]
        matches = [self.table.matches(s) for s in missing]
        distinct = list({m for own in matches for m in own})
        ids = dict(zip(distinct, self.table.encode_matches(distinct)))
        fresh = {s: b"".join(map(ids.__getitem__, own)) for s, own in zip(missing, matches)}
        found.update(fresh)
        if len(self.recent) + len(found) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        self.recent.update((s, i) for s, i in found.items() if len(s) <= REMEMBERED_CHARS)
        return found

    def forget(self) -> None:
        self.recent, self.older = {}, {}


def encode_documents(documents: DataFrame, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``documents`` with ids (binary, little-endian unsigned 32-bit) and the decoded bytes.

    NULL reads as the empty text; an empty text has no ids. A text is one row
    and is encoded whole.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*columns).schema)

    def table() -> ByteTable:
        return kept(("ranks", path, pattern), lambda: ByteTable(read_ranks(path), pattern))

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        known = table()
        ids = known.encode_all(filled(part.column("__text")).to_pylist())
        decoded = [known.decode(i) for i in ids]
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in columns), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array(decoded, pa.binary())],
            names=[*columns, "ids", "decoded"],
        )

    rows = documents.select(*columns, F.col("text").alias("__text"))
    return map_slices(rows, handle, f"{schema}, ids binary, decoded binary", "__text", lambda: table().stretches.forget())


def digest_columns(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of ids and decoded."""
    return encoded.select(
        *[c for c in encoded.columns if c not in ("ids", "decoded")],
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
