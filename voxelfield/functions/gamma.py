"""Gamma draws by rejection from keyed uniforms.

The method of Marsaglia and Tsang: with d = shape - 1/3 and c = 1 / sqrt(9 d),
a standard normal x and a uniform u give the proposal d (1 + c x)^3, taken if
u is small enough. Attempts are numbered and keyed by their number, so the
first one taken is a function of the key. About one in twenty is refused at
shape 1, fewer above, however large the shape. Of ``ATTEMPTS`` attempts all are
refused with a probability below 1e-80; the draw then fails.
"""

from __future__ import annotations

import math

from voxelfield.functions.keyed import Key, uniform_sql, uniforms
from voxelfield.functions.normal import norm_ppf_array, norm_ppf_sql

ATTEMPTS = 64


def gamma_draw(prefix: str, shape: float) -> float:
    """Gamma(shape, 1) of the uniforms keyed ``prefix|x|k`` and ``prefix|u|k``, for shapes of at least 1."""
    if shape < 1:
        raise ValueError("shape below 1")
    d = shape - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)
    for k in range(ATTEMPTS):
        x = float(norm_ppf_array(uniforms(f"{prefix}|x", [k]))[0])
        v = (1.0 + c * x) ** 3
        if v > 0 and math.log(uniforms(f"{prefix}|u", [k])[0]) < 0.5 * x * x + d - d * v + d * math.log(v):
            return d * v
    raise ArithmeticError("no attempt was taken")


def gamma_sql(shape: str, *parts: Key | int | str) -> str:
    """The same draw as SQL text; ``shape`` is a column or a literal."""
    d = f"({shape} - 1.0D / 3.0D)"
    tries = (
        f"transform(sequence(0, {ATTEMPTS - 1}), k -> named_struct("
        f"'p', {uniform_sql(*parts, 'x', Key('k'))}, 'u', ln({uniform_sql(*parts, 'u', Key('k'))})))"
    )
    normals = f"transform({tries}, t -> named_struct('u', t.u, 'x', {norm_ppf_sql('t.p')}))"
    cubes = f"transform({normals}, t -> named_struct('u', t.u, 'x', t.x, 'v', pow(1.0D + t.x / sqrt(9.0D * {d}), 3)))"
    taken = f"filter({cubes}, t -> t.v > 0 and t.u < 0.5D * t.x * t.x + {d} - {d} * t.v + {d} * ln(t.v))"
    return f"({d} * {taken}[0].v)"
