"""Standard normal distribution function and its inverse.

Each function exists once as a Column expression (JVM side) and once for
numpy arrays (inside grouped tasks); both read the same published constants.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal tail (Hart 1968, West 2005),
# highest power first.
TAIL_NUMERATOR = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
TAIL_ZERO = 37.0
TAIL_SCALE = 2.506628274631

# Wichura (1988), algorithm AS241, highest power first.
CENTRAL_NUMERATOR = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
    4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
    1.3314166789178437745e2, 3.3871328727963666080e0,
)
CENTRAL_DENOMINATOR = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
    2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
    4.2313330701600911252e1, 1.0,
)
MIDDLE_NUMERATOR = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
    1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
    4.63033784615654529590e0, 1.42343711074968357734e0,
)
MIDDLE_DENOMINATOR = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
    2.05319162663775882187e0, 1.0,
)
FAR_NUMERATOR = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
    2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
    5.46378491116411436990e0, 6.65790464350110377720e0,
)
FAR_DENOMINATOR = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
    7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
    5.99832206555887937690e-1, 1.0,
)

# Double machine epsilon, added inside logarithms of probabilities.
EPSILON = 2.220446049250313e-16


def horner(x: np.ndarray, coefficients) -> np.ndarray:
    """Polynomial value, highest power first."""
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], x * 0.0 + coefficients[0])


def horner_sql(x: str, coefficients) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {c!r}D)", coefficients[1:], f"{coefficients[0]!r}D")


def norm_cdf_sql(x: str) -> str:
    a = f"abs({x})"
    density = f"exp(-{a} * {a} / 2.0D)"
    near = f"{density} * {horner_sql(a, TAIL_NUMERATOR)} / {horner_sql(a, TAIL_DENOMINATOR)}"
    far = f"{density} / ({a} + 1.0D / ({a} + 2.0D / ({a} + 3.0D / ({a} + 4.0D / ({a} + 0.65D))))) / {TAIL_SCALE!r}D"
    tail = f"(case when {a} < {TAIL_SWITCH!r}D then {near} when {a} <= {TAIL_ZERO!r}D then {far} else 0.0D end)"
    # |1 - tail| above zero and |0 - tail| below, so the tail appears once.
    return f"(case when {x} is not null then abs((case when {x} > 0 then 1.0D else 0.0D end) - {tail}) end)"


def norm_ppf_sql(p: str) -> str:
    q = f"({p} - 0.5D)"
    r = f"(0.180625D - {q} * {q})"
    s = f"sqrt(-ln(least({p}, 1.0D - {p})))"
    central = f"{q} * {horner_sql(r, CENTRAL_NUMERATOR)} / {horner_sql(r, CENTRAL_DENOMINATOR)}"
    m, f = f"({s} - 1.6D)", f"({s} - 5.0D)"
    middle = f"{horner_sql(m, MIDDLE_NUMERATOR)} / {horner_sql(m, MIDDLE_DENOMINATOR)}"
    far = f"{horner_sql(f, FAR_NUMERATOR)} / {horner_sql(f, FAR_DENOMINATOR)}"
    outer = f"(case when {s} <= 5.0D then {middle} else {far} end)"
    return f"(case when abs({q}) <= 0.425D then {central} when {q} < 0 then -{outer} else {outer} end)"


def norm_cdf(name: str) -> Column:
    """Normal distribution function of the column ``name``.

    Built as one SQL expression: composing it call by call costs more time on
    the driver than small queries take to run.
    """
    return F.expr(norm_cdf_sql(f"`{name}`"))


def norm_ppf(name: str) -> Column:
    """Normal quantile of the column ``name``, strictly between 0 and 1."""
    return F.expr(norm_ppf_sql(f"`{name}`"))


def norm_cdf_array(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    density = np.exp(-a * a / 2.0)
    near = density * horner(a, TAIL_NUMERATOR) / horner(a, TAIL_DENOMINATOR)
    far = density / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / TAIL_SCALE
    tail = np.where(a < TAIL_SWITCH, near, np.where(a <= TAIL_ZERO, far, 0.0))
    return np.where(x > 0, 1.0 - tail, tail)


def norm_ppf_array(p: np.ndarray) -> np.ndarray:
    q = p - 0.5
    r = 0.180625 - q * q
    s = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    central = q * horner(r, CENTRAL_NUMERATOR) / horner(r, CENTRAL_DENOMINATOR)
    middle = horner(s - 1.6, MIDDLE_NUMERATOR) / horner(s - 1.6, MIDDLE_DENOMINATOR)
    far = horner(s - 5.0, FAR_NUMERATOR) / horner(s - 5.0, FAR_DENOMINATOR)
    outer = np.where(s <= 5.0, middle, far)
    return np.where(np.abs(q) <= 0.425, central, np.sign(q) * outer)


# Below this mean the tail is so thin that the normal tail and its exponential
# limit agree to the accuracy of the draw, while the tail mass underflows.
EXPONENTIAL_TAIL = -30.0


def positive_normal_array(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    safe = np.maximum(mean, EXPONENTIAL_TAIL)
    bulk = safe - norm_ppf_array(u * norm_cdf_array(safe))
    return np.where(mean < EXPONENTIAL_TAIL, np.log(u) / np.minimum(mean, -1.0), bulk)
