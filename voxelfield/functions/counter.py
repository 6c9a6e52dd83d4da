"""Uniform numbers for arrays of counters: the Threefry-2x32 generator with 20 rounds.

A key names a stream, a pair of 32-bit counters a number of it, so any task
can draw any part of a stream in any order. One hash makes a key; the numbers
themselves are a few vector operations each.
"""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed values of the published generator.
ROTATIONS = (13, 15, 26, 6, 17, 29, 16, 24)
PARITY = 0x1BD11BDA
ROUNDS = 20
WORD = 0xFFFFFFFF
# Bits of a uniform: all of the first word, the upper 20 of the second.
LOW_BITS = 20
SPAN = float(2 ** (32 + LOW_BITS))
# Counters worked on at once, so that rounds stay in cache.
SLICE = 1 << 15


def stream(*parts: object) -> tuple[int, int]:
    """Key of the stream that ``parts`` name."""
    digest = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def threefry(key: tuple[int, int], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both output words for arrays of counters (uint32, equal shapes)."""
    words = [np.uint32(k) for k in (*key, PARITY ^ key[0] ^ key[1])]
    a, b = first + words[0], second + words[1]
    for i in range(ROUNDS):
        turn = ROTATIONS[i % len(ROTATIONS)]
        a = a + b
        b = ((b << np.uint32(turn)) | (b >> np.uint32(32 - turn))) ^ a
        if i % 4 == 3:
            step = i // 4 + 1
            a = a + words[step % 3]
            b = b + words[(step + 1) % 3] + np.uint32(step)
    return a, b


def counter_uniforms(key: tuple[int, int], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Uniforms on (0, 1), one per pair of counters; the arrays broadcast, only their low 32 bits count."""
    first, second = np.broadcast_arrays(np.asarray(first), np.asarray(second))
    shape = first.shape
    first, second = (np.ravel(c).astype(np.int64).astype(np.uint32) for c in (first, second))
    out = np.empty(first.size)
    for at in range(0, first.size, SLICE):
        a, b = threefry(key, first[at : at + SLICE], second[at : at + SLICE])
        joined = (a.astype(np.uint64) << np.uint64(LOW_BITS)) | (b >> np.uint32(32 - LOW_BITS)).astype(np.uint64)
        out[at : at + SLICE] = (joined.astype(float) + 0.5) / SPAN
    return out.reshape(shape)


def id_uniforms(key: tuple[int, int], ids: np.ndarray) -> np.ndarray:
    """Uniforms for 64-bit ids: the counters are an id's low and high word."""
    ids = np.asarray(ids, dtype=np.int64)
    return counter_uniforms(key, ids & WORD, ids >> 32)
