"""Geometry of periodic cells. A cell is nine columns ax..cz, its rows the three vectors; positions are fractional u, v, w."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticeworks.functions.basis import rounded

CELL = [f"{v}{d}" for v in "abc" for d in "xyz"]


def _c(name: str, prefix: str = "") -> Column:
    return F.col(f"{prefix}{name}")


def cartesian(u: Column, v: Column, w: Column, prefix: str = "") -> tuple[Column, Column, Column]:
    return tuple(u * _c(f"a{d}", prefix) + v * _c(f"b{d}", prefix) + w * _c(f"c{d}", prefix) for d in "xyz")


def _cross(p: str, q: str, prefix: str = "") -> tuple[Column, Column, Column]:
    a, b = ([_c(f"{n}{d}", prefix) for d in "xyz"] for n in (p, q))
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def determinant(prefix: str = "") -> Column:
    return sum((_c(f"a{d}", prefix) * x for d, x in zip("xyz", _cross("b", "c", prefix), strict=True)), F.lit(0.0))


def volume(prefix: str = "") -> Column:
    return F.abs(determinant(prefix))


def fractional(x: Column, y: Column, z: Column, prefix: str = "") -> tuple[Column, Column, Column]:
    """The inverse of cartesian() by cofactors; null for a flat cell."""
    det = determinant(prefix)
    return tuple(F.try_divide(x * p + y * q + z * r, det) for p, q, r in (_cross("b", "c", prefix), _cross("c", "a", prefix), _cross("a", "b", prefix)))


def heights(prefix: str = "") -> tuple[Column, Column, Column]:
    """Distances between the opposite faces of a cell; null for a flat one."""
    return tuple(F.try_divide(F.nullif(volume(prefix), F.lit(0.0)), F.sqrt(sum((x * x for x in _cross(p, q, prefix)), F.lit(0.0)))) for p, q in ("bc", "ca", "ab"))


def wrapped(u: Column) -> Column:
    """A fractional coordinate in [0, 1)."""
    return F.when(F.pmod(u, F.lit(1.0)) >= 1.0, 0.0).otherwise(F.pmod(u, F.lit(1.0)))


def angle(dot: Column) -> Column:
    """Between unit vectors; the product is rounded and clamped first."""
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), rounded(dot, 10))))


def azimuth(x: Column, y: Column) -> Column:
    return F.atan2(y, x) + F.lit(3.141592653589793)


def polar(z: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), z)))


def sorted_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
