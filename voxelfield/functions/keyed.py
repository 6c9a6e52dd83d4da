"""Random numbers as pure functions of a key.

A draw depends on (seed, step, keys) only, never on row order, partition
layout or retries, so a lost executor recomputes exactly the same values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelfield.functions.normal import norm_ppf_sql

HEX_DIGITS = 13
SPAN = float(16**HEX_DIGITS)


@dataclass(frozen=True)
class Key:
    """A column that is part of a draw's key."""

    name: str


def keys(*names: str) -> list[Key]:
    return [Key(n) for n in names]


def uniform_sql(*parts: Key | int | str) -> str:
    """Uniform on (0, 1) from the md5 of the joined key parts, as SQL text."""
    texts = [f"cast(`{p.name}` as string)" if isinstance(p, Key) else f"'{p}'" for p in parts]
    digits = f"substring(md5(cast(concat_ws('|', {', '.join(texts)}) as binary)), 1, {HEX_DIGITS})"
    return f"((cast(conv({digits}, 16, 10) as double) + 0.5D) / {SPAN!r}D)"


def keyed_uniform(*parts: Key | int | str) -> Column:
    return F.expr(uniform_sql(*parts))


def keyed_uniforms(size: int, *parts: Key | int | str) -> Column:
    """Array of ``size`` uniforms; the position ends the key."""
    return F.expr(f"transform(sequence(0, {size - 1}), position -> {uniform_sql(*parts, Key('position'))})")


def keyed_normals(size: int, *parts: Key | int | str) -> Column:
    """Array of ``size`` standard normals, from the uniforms of the same key."""
    uniforms = f"transform(sequence(0, {size - 1}), position -> {uniform_sql(*parts, Key('position'))})"
    return F.expr(f"transform({uniforms}, u -> {norm_ppf_sql('u')})")


def uniforms(prefix: str, items: Iterable) -> np.ndarray:
    """The uniforms of ``keyed_uniform`` for keys ``prefix|item``, outside Spark's expressions."""
    start, out = hashlib.md5(prefix.encode()), []
    for item in items:
        key = start.copy()
        key.update(f"|{item}".encode())
        out.append((int(key.hexdigest()[:HEX_DIGITS], 16) + 0.5) / SPAN)
    return np.array(out)
