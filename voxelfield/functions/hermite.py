"""Eigenfunctions of the one-dimensional squared-exponential process.

For the kernel exp(-a(x^2 + x'^2) - b(x - x')^2) they are Hermite functions:
with c = sqrt(a^2 + 2ab) and t = sqrt(2c) x,

    h_0 = (2c/pi)^(1/4) exp(-c x^2)
    h_k = sqrt(2/k) t h_{k-1} - sqrt((k-1)/k) h_{k-2}
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decay(a: float, b: float) -> float:
    return math.sqrt(a * a + 2.0 * a * b)


def with_basis_columns(df: DataFrame, value: str, degree: int, a: float, b: float) -> tuple[DataFrame, list[str]]:
    """Add one scalar column per basis function.

    A term needs the two before it. As lateral aliases of one select, every
    term is a plain attribute for the next one, so the whole recurrence is
    generated as straight-line code; nothing is boxed into arrays.
    """
    c = decay(a, b)
    names = [f"__h{k}" for k in range(degree + 1)]
    terms = [
        f"{math.sqrt(2.0 * c)!r}D * `{value}` as __t",
        f"{(2.0 * c / math.pi) ** 0.25!r}D * exp(-{c!r}D * `{value}` * `{value}`) as {names[0]}",
    ]
    for k in range(1, degree + 1):
        term = f"{math.sqrt(2.0 / k)!r}D * __t * {names[k - 1]}"
        if k > 1:
            term += f" - {math.sqrt((k - 1.0) / k)!r}D * {names[k - 2]}"
        terms.append(f"{term} as {names[k]}")
    return df.selectExpr("*", *terms).drop("__t"), names


def dot(names: list[str], array: str) -> Column:
    """Scalar columns times the entries of an array column, summed."""
    return F.expr(" + ".join(f"`{n}` * `{array}`[{k}]" for k, n in enumerate(names)))


def array_dot(left: str, right: str, size: int) -> Column:
    """Product of two array columns of known length, unrolled."""
    return F.expr(" + ".join(f"`{left}`[{k}] * `{right}`[{k}]" for k in range(size)))


def basis_array(x: np.ndarray, degree: int, a: float, b: float) -> np.ndarray:
    """The same functions for a numpy array; the last axis is the degree."""
    c = decay(a, b)
    t = math.sqrt(2.0 * c) * x
    out = np.empty(x.shape + (degree + 1,))
    out[..., 0] = (2.0 * c / math.pi) ** 0.25 * np.exp(-c * x * x)
    for k in range(1, degree + 1):
        out[..., k] = math.sqrt(2.0 / k) * t * out[..., k - 1]
        if k > 1:
            out[..., k] -= math.sqrt((k - 1.0) / k) * out[..., k - 2]
    return out
