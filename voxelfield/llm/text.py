"""Words, shingles and their hashes for batches of texts, on Arrow buffers.

Words are maximal runs of characters other than the six ASCII white-space
characters (space, tab to carriage return); case folding touches A-Z only.
NULL reads as the empty text everywhere.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

# Texts handled at once inside a batch; bounds the working memory of a task.
SLICE_BYTES = 4 * 1024 * 1024
SLICE_ROWS = 1024

# Odd multipliers that tie a word's hash to its place in a shingle.
_PLACES = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(64)], dtype=np.uint64)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` of at most about ``SLICE_BYTES`` of ``column`` and ``SLICE_ROWS`` rows; one text at least."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def hand_back() -> None:
    """Return freed memory to the system; worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_slices(
    df: DataFrame,
    handle: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    column: str = "text",
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """``mapInArrow`` over bounded slices; ``done`` runs when a task ends. Workers live on, so memory is handed back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield handle(part)
        if done is not None:
            done()
        hand_back()

    return df.mapInArrow(run, schema)


def kept(key: tuple, make: Callable[[], object]) -> object:
    """A value made once per worker process; functions travel by value, so modules keep nothing between tasks."""
    held = sys.__dict__.setdefault("_voxelfield_kept", {})
    if key not in held:
        held[key] = make()
    return held[key]


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and where each text's words start (n + 1 offsets)."""
    texts = filled(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(flat), 0)
    flat, parents = flat.filter(there), np.asarray(parents.filter(there), dtype=np.int64)
    counts = np.bincount(parents, minlength=len(texts)) if len(texts) else np.zeros(0, dtype=np.int64)
    return flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each word and the distinct words."""
    table = flat.dictionary_encode()
    return np.asarray(table.indices, dtype=np.int64), table.dictionary


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each value."""
    values = distinct.cast(pa.binary()).to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), dtype=np.uint64, count=len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain_hash(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """Order-dependent hash of equally long columns of hashes."""
    total = np.full(len(parts[0]), salt * int(_PLACES[-1]) % 2**64, dtype=np.uint64)
    for place, part in enumerate(parts):
        total = total + part * _PLACES[place]
    return mixed(total)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text.

    A text with fewer than ``size`` words has its whole word sequence as one
    shingle; a text without words has none.
    """
    flat, offsets = words(texts)
    codes, distinct = coded(flat)
    hashed = hashes(distinct)[codes] if len(flat) else np.zeros(0, dtype=np.uint64)
    last = max(0, len(hashed) - size + 1)
    full = chain_hash([hashed[i : i + last] for i in range(size)], size) if last else hashed[:0]
    sets = []
    for start, stop in zip(offsets[:-1], offsets[1:]):
        n = stop - start
        if n >= size:
            sets.append(np.unique(full[start : stop - size + 1]))
        elif n:
            sets.append(chain_hash([hashed[start + i : start + i + 1] for i in range(n)], int(n)))
        else:
            sets.append(hashed[:0])
    return sets
