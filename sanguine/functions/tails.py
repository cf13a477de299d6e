"""Quantiles and tail probabilities: the normal quantile as a column, the rest for the few rows of a test's result."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Wichura's rational approximations of the normal quantile (1988, algorithm AS 241), lowest power first; fixed values.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(parts, x: Column) -> Column:
    def poly(c):
        out = F.lit(c[-1])
        for v in c[-2::-1]:
            out = out * x + v
        return out

    return poly(parts[0]) / poly(parts[1])


def normal_quantile(p: Column) -> Column:
    """Of 0 < p < 1, to double precision; NULL elsewhere."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.signum(q) * F.when(r <= 5, _ratio(_NEAR, r - 1.6)).otherwise(_ratio(_FAR, r - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRE, 0.180625 - q * q)).otherwise(tail))


_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_below(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + step * d) or tiny), (1 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def f_tail(f: float, dof1: float, dof2: float) -> float:
    """Probability of an F value of f or more."""
    return 1.0 if f <= 0 else beta_share(dof2 / (dof2 + dof1 * f), dof2 / 2, dof1 / 2)


def studentised_tail(q: float, k: int, dof: float) -> float:
    """Probability that k normal values lie q or more estimated deviations apart; dof: degrees of freedom of the estimate, may be infinite.

    Trapezoids over the place of the smallest value and over the estimate: of smooth functions that vanish at both ends these are as good as exact.
    """
    if q <= 0:
        return 1.0
    z = np.linspace(-8.5, 8.5, 341)
    if math.isinf(dof):
        s, weight = np.ones(1), np.ones(1)
    else:
        spread = min(12 / math.sqrt(2 * dof), 12.0)
        s = np.linspace(max(1e-6, 1 - spread), 1 + spread, 301 if dof > 20 else 3001)
        weight = np.exp(math.log(2) + dof / 2 * math.log(dof / 2) - math.lgamma(dof / 2) + (dof - 1) * np.log(s) - dof * s * s / 2) * (s[1] - s[0])
        weight[[0, -1]] /= 2
    inside = (normal_below(z) - normal_below(z - q * s[:, None])) ** (k - 1) * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return float(min(1.0, max(0.0, 1 - (k * inside.sum(1) * (z[1] - z[0])) @ weight)))


def signed_rank_tail(w: float, n: int, ties: float = 0.0) -> float:
    """Two-sided probability of a signed-rank sum of w or less of n differences that aren't zero: exact up to 50 without ties, normal beyond.

    ties: the sum of t ** 3 - t over groups of t equal sizes.
    """
    if n == 0:
        return 1.0
    if n <= 50 and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 1.0 if var <= 0 else float(min(1.0, 2 * normal_below((w - n * (n + 1) / 4) / math.sqrt(var))))


def per_row(function):
    """A column function of a scalar function, for results of a few rows; NULL where an argument is."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else function(*map(float, row)) for row in zip(*columns, strict=True)], dtype=float)

    def of(*columns):
        value = F.pandas_udf({1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[len(columns)], "double")(*columns)
        return F.nanvl(value, F.lit(None).cast("double"))  # pandas has no NULL among its numbers

    return of
