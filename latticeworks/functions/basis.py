"""Tapers and basis functions as Column builders; a basis is any list of functions of Columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits by a product and a quotient, as F.round goes through decimal text; for values that no tie lies on."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def taper(r: Column, at: float, width: float, kind: str | None = ">") -> Column:
    """x^4 / (1 + x^4) with x = (r - at) / width: `>` is 0 beyond `at`, `<` is 0 below it, None is 1 everywhere."""
    if kind is None:
        return F.lit(1.0)
    x4 = F.pow((r - at) / width, 4)
    off = {">": r > at, "<": r < at}[kind]
    return F.when(off, 0.0).otherwise(x4 / (1 + x4))


def taper_slope(r: Column, at: float, width: float, kind: str | None = ">") -> Column:
    if kind is None:
        return F.lit(0.0)
    x = (r - at) / width
    off = {">": r > at, "<": r < at}[kind]
    return F.when(off, 0.0).otherwise(4 * F.pow(x, 3) / (F.pow(1 + F.pow(x, 4), 2) * width))


def taper_by_products(x: Column, width: float, off: Column) -> tuple[Column, Column]:
    """Value and slope of a taper from x = (r - at) / width without powers, which Spark computes in software; off: where both are 0."""
    x4 = x * x * x * x
    return F.when(off, 0.0).otherwise(x4 / (1 + x4)), F.when(off, 0.0).otherwise(4 * x * x * x / ((1 + x4) * (1 + x4) * width))


def taper_between(r: Column, low: float, high: float, width: float) -> Column:
    return taper(r, low, width, "<") * taper(r, high, width, ">")


def named_taper(name: str, r: Column, at: float, width: float) -> Column:
    """x4ge and x4le rise from `at` upwards or downwards; Behlerge and Behlerle are half cosines over `width`; Ones is 1."""
    x4, x = F.pow((r - at) / width, 4), (r - at) / width
    half = 0.5 * (F.cos(PI * F.abs(x)) + 1)
    made = {
        "x4ge": F.when(r < at, 0.0).otherwise(x4 / (1 + x4)),
        "x4le": F.when(r > at, 0.0).otherwise(x4 / (1 + x4)),
        "Behlerge": F.when(r > at + width, 0.0).when(r < at, 1.0).otherwise(half),
        "Behlerle": F.when(r < at - width, 0.0).when(r > at, 1.0).otherwise(half),
        "Ones": F.lit(1.0),
    }
    if name not in made:
        raise ValueError(f"unknown taper {name!r}")
    return made[name]


def damping(x: Column, factor: float = 10.0) -> Column:
    y = F.pow(x * factor, 4)
    return y / (1 + y)


def damping_slope(x: Column, factor: float = 10.0) -> Column:
    return 4 * factor * F.pow(x * factor, 3) / F.pow(1 + F.pow(x * factor, 4), 2)


def cos_k(x: Column, k, scale: float) -> Column:
    return F.cos(x * k * (PI / scale))


def sin_k(x: Column, k, scale: float) -> Column:
    return F.sin(x * k * (PI / scale))


def tapered_cos(r: Column, k: int, scale: float, at: float, width: float) -> Column:
    return cos_k(r, k, scale) * taper(r, at, width)


def tapered_cos_slope(r: Column, k: int, scale: float, at: float, width: float) -> Column:
    return cos_k(r, k, scale) * taper_slope(r, at, width) - (k * PI / scale) * sin_k(r, k, scale) * taper(r, at, width)


def fourier_array(x: Column, k: int, scale: float, sines: bool = False) -> Column:
    """cos(pi n x / scale) for n < k, then with sines those for 0 < n < k."""
    cosines = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda n: cos_k(x, n, scale))
    if not sines or k < 2:
        return cosines
    return F.concat(cosines, F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda n: sin_k(x, n, scale)))


def gaussian_features(x: Column, k: int, first: float, step: float, width: float, bias: bool = False) -> Column:
    made = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda n: F.exp(-0.5 * F.pow((x - (n * step + first)) / width, 2)) / (width * math.sqrt(2 * PI)))
    return F.concat(F.array(F.lit(1.0)), made) if bias else made


def fourier_features(x: Column, k: int) -> Column:
    n = F.sequence(F.lit(1), F.lit(k - 1))
    return F.concat(F.array(F.lit(1.0)), F.transform(n, lambda i: F.sin(i * x)), F.transform(n, lambda i: F.cos(i * x)))


def chebyshev_features(x: Column, k: int) -> Column:
    """T_0 to T_(k-1) by their recurrence, which also holds outside [-1, 1]."""
    grow = lambda t, _: F.concat(t, F.array(2 * x * F.element_at(t, -1) - F.element_at(t, -2)))
    first = F.array(F.lit(1.0), x.cast("double"))
    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(max(k - 2, 1))), first, grow), 1, k)


def polynomial_features(x: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda n: F.pow(x, n.cast("double")))


def basis_sizes(spec) -> dict[str, dict[str, int]]:
    """An int, {like, unlike} or {like, unlike} x {r, theta} as the last of these."""
    if isinstance(spec, int):
        spec = {"like": spec, "unlike": spec}
    if not isinstance(spec, dict) or set(spec) != {"like", "unlike"}:
        raise ValueError(f"not a basis size: {spec!r}")
    out = {}
    for kind, size in spec.items():
        size = {"r": size, "theta": size} if isinstance(size, int) else size
        if not isinstance(size, dict) or set(size) != {"r", "theta"} or not all(isinstance(x, int) for x in size.values()):
            raise ValueError(f"not a basis size: {spec!r}")
        out[kind] = dict(size)
    return out


Basis = list[Callable[[Column], Column]]


def cosine_basis(k: int, scale: float, at: float, width: float) -> Basis:
    return [lambda r, n=n: tapered_cos(r, n, scale, at, width) for n in range(k)]
