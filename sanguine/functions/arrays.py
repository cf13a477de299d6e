"""Column functions over array<double>: everything stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """NULL for an empty array."""
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def std(a: Column) -> Column:
    """Population standard deviation in two passes."""
    return let(mean(a), lambda m: F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m)))))


def zero_mean(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def zscore(a: Column) -> Column:
    """Over time; NULLs where the deviation is 0."""
    return let(F.struct(mean(a).alias("m"), std(a).alias("s")), lambda p: F.transform(a, lambda x: F.try_divide(x - p["m"], p["s"])))


def channel_zscore(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Per sample over the three channels, as arrays."""
    rows = F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b"))

    def of(name: str) -> Column:
        def one(x: Column) -> Column:
            m = (x["r"] + x["g"] + x["b"]) / 3
            v = (x["r"] * x["r"] + x["g"] * x["g"] + x["b"] * x["b"]) / 3 - m * m
            return F.try_divide(x[name] - m, F.sqrt(F.greatest(v, F.lit(0.0))))

        return F.transform(rows, one)

    return of("r"), of("g"), of("b")


def shrink(a: Column, alpha: float = 4.0) -> Column:
    return F.transform(a, lambda x: x * (1 - F.exp(-alpha * x)))


def combine(*terms: tuple[Column | float, Column]) -> Column:
    """Sum of coefficient x array, elementwise."""

    def plus(c, a: Column, so_far: Column | None) -> Column:
        return F.transform(a, lambda x: x * c) if so_far is None else F.zip_with(so_far, a, lambda x, y: x + y * c)

    out = None
    for c, a in terms:
        out = plus(c, a, out)
    return out


def energy(a: Column) -> Column:
    """Mean less the minimum, where that is negative."""
    return mean(a) - F.least(F.array_min(a), F.lit(0.0))


def peak_snr(a: Column, centre: int, width: int) -> Column:
    """Sum of the bins within two widths of the centre over that of the rest; 0 where there is hardly any rest."""
    near = lambda k: k.between(centre - 2 * width, centre + 2 * width)
    inside = total(F.transform(a, lambda x, k: F.when(near(k), x).otherwise(F.lit(0.0))))
    outside = total(F.transform(a, lambda x, k: F.when(near(k), F.lit(0.0)).otherwise(x)))
    return F.when(outside < 1e-7, F.lit(0.0)).otherwise(F.try_divide(inside, outside))


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda x: x.isNull() | F.isnan(x))


def median(a: Column) -> Column:
    """Of an array; NULL when empty."""
    return let(F.array_sort(a), lambda s: F.when(F.size(s) == 0, None).otherwise((F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2))


def mad(a: Column) -> Column:
    """Unscaled median absolute deviation."""
    return let(median(a), lambda m: median(F.transform(a, lambda x: F.abs(x - m))))


def constants(values: list[float]) -> Column:
    """A constant array<double>, written as text that is folded into one literal, so that the plan stays short."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def dft_power(a: Column, n: int, bins: list[int]) -> Column:
    """Power |X(k)|^2 of an array of n values at the given bins, from cosine and sine tables."""
    wave = lambda f, k: constants([f(2 * math.pi * k * t / n) for t in range(n)])
    table = F.array(*[F.struct(wave(math.cos, k).alias("c"), wave(math.sin, k).alias("s")) for k in bins])
    return let(a, lambda x: F.transform(table, lambda w: F.pow(dot(x, w["c"]), 2) + F.pow(dot(x, w["s"]), 2)))


def arg_max(a: Column) -> Column:
    """Place (from 0) of the first largest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
