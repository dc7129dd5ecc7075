"""Tabulated functions on uniform grids: radial functions, lookups, splines, operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.functions.basis import Basis


def tabulate(keys: DataFrame, n: int, step: float, value: Column) -> DataFrame:
    """(columns of keys, bin, x, y) for bins 0..n-1 with x = bin * step; value may use x and the columns of keys."""
    grid = keys.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x", F.col("bin") * step)
    return grid.withColumn("y", value)


def combine(basis: Basis, weights: list[float]) -> Column:
    """Sum of w_k f_k(x): a regressed function at column x."""
    return sum((f(F.col("x")) * w for f, w in zip(basis, weights, strict=True)), F.lit(0.0))


def linear_pieces(table: DataFrame, by: list[str]) -> DataFrame:
    """table with the slope of each bin; the last bin repeats the one before it, for extrapolation."""
    w = Window.partitionBy(*by).orderBy("bin")
    slope = (F.lead("y").over(w) - F.col("y")) / (F.lead("x").over(w) - F.col("x"))
    sloped = table.withColumn("s", slope)
    return sloped.withColumn("slope", F.coalesce("s", F.lag("s").over(w))).drop("s")


def differences(table: DataFrame, by: list[str], order: str = "bin") -> DataFrame:
    """table with dy, the symmetric difference of y over x; at the ends of a function the one-sided one."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead, behind = (lambda c: F.coalesce(F.lead(c).over(w), F.col(c))), (lambda c: F.coalesce(F.lag(c).over(w), F.col(c)))
    return table.withColumn("dy", (ahead("y") - behind("y")) / (ahead("x") - behind("x")))


def on_grid(bounds: DataFrame, n: int, basis: Basis, weights: str = "weights") -> DataFrame:
    """(columns of bounds, bin, x, y): a regressed function of each row of bounds (lo, hi, weights array) at n points from lo on, whose
    step is a whole number of millionths."""
    step = F.round((F.col("hi") - F.col("lo")) / n, 6)
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x", F.col("lo") + F.col("bin") * step)
    return grid.withColumn("y", sum((F.element_at(weights, k + 1) * f(F.col("x")) for k, f in enumerate(basis)), F.lit(0.0)))


def lookup(df: DataFrame, table: DataFrame, key: Column, x: Column, step: float, n: int, suffix: str = "") -> DataFrame:
    """df with y and dy of the function `key` at x from linear pieces (key, bin, x, y, slope). The table's size is its resolution."""
    small = table.select(F.col("key").alias("_key"), F.col("bin").alias("_bin"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("slope").alias("_s"))
    at = F.least(F.greatest(F.floor(x / step).cast("int"), F.lit(0)), F.lit(n - 2))
    both = df.withColumn("_k", key).withColumn("_at", at).withColumn("_r", x).join(F.broadcast(small), (F.col("_k") == F.col("_key")) & (F.col("_at") == F.col("_bin")))
    both = both.withColumn(f"y{suffix}", F.col("_y") + F.col("_s") * (F.col("_r") - F.col("_x"))).withColumn(f"dy{suffix}", F.col("_s"))
    return both.drop("_k", "_at", "_r", "_key", "_bin", "_x", "_y", "_s")


def cubic_spline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (y, c1, c2, c3) of each interval of the not-a-knot cubic spline."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    # inner rows, with the end conditions h1 c0 = (h0 + h1) c1 - h0 c2 put in, are tridiagonal
    low, mid, up, b = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 3 * np.diff(d)
    mid[0] += h[0] * (h[0] + h[1]) / h[1]
    up[0] -= h[0] * h[0] / h[1]
    mid[-1] += h[-1] * (h[-2] + h[-1]) / h[-2]
    low[-1] -= h[-1] * h[-1] / h[-2]
    for i in range(1, len(mid)):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        b[i] -= f * b[i - 1]
    c = np.zeros(len(x))
    for i in range(len(mid) - 1, -1, -1):
        c[i + 1] = (b[i] - (up[i] * c[i + 2] if i + 1 < len(mid) else 0.0)) / mid[i]
    c[0] = ((h[0] + h[1]) * c[1] - h[0] * c[2]) / h[1]
    c[-1] = ((h[-2] + h[-1]) * c[-2] - h[-1] * c[-3]) / h[-2]
    return np.stack([y[:-1], d - h * (2 * c[:-1] + c[1:]) / 3, c[:-1], np.diff(c) / (3 * h)], 1)


def cubic_coefficients(table: DataFrame) -> DataFrame:
    """(key, bin, x, y, c1, c2, c3) of each function of a table (key, bin, x, y); a function is one group of its resolution."""

    def solve(pdf):
        pdf = pdf.sort_values("bin").reset_index(drop=True)
        c = cubic_spline(pdf.x.to_numpy(), pdf.y.to_numpy())
        out = pdf.iloc[:-1].copy()
        out[["y", "c1", "c2", "c3"]] = c
        return out[["key", "bin", "x", "y", "c1", "c2", "c3"]]

    return table.select("key", "bin", "x", "y").groupBy("key").applyInPandas(solve, "key string, bin int, x double, y double, c1 double, c2 double, c3 double")


def cubic_lookup(df: DataFrame, coefficients: DataFrame, key: Column, x: Column, step: float, n: int) -> DataFrame:
    """df with y and dy from a cubic spline, extrapolated beyond its ends."""
    c = coefficients.select(F.col("key").alias("_key"), F.col("bin").alias("_bin"), F.col("x").alias("_x"), F.col("y").alias("_y"), "c1", "c2", "c3")
    at = F.least(F.greatest(F.floor(x / step).cast("int"), F.lit(0)), F.lit(n - 2))
    both = df.withColumn("_k", key).withColumn("_at", at).withColumn("_r", x).join(F.broadcast(c), (F.col("_k") == F.col("_key")) & (F.col("_at") == F.col("_bin")))
    t = F.col("_r") - F.col("_x")
    both = both.withColumn("y", F.col("_y") + t * (F.col("c1") + t * (F.col("c2") + t * F.col("c3")))).withColumn("dy", F.col("c1") + t * (2 * F.col("c2") + 3 * t * F.col("c3")))
    return both.drop("_k", "_at", "_r", "_key", "_bin", "_x", "_y", "c1", "c2", "c3")


def radial_operations(table: DataFrame, steps: list[str | tuple]) -> DataFrame:
    """table (key, bin, x, y) after steps in order: normalize (by the range over all functions, no shift), absolute, shift (by the
    least value over all), exp (times e^-x), ("psi", p0, p1) (times the taper at p0 of width p1), ("psi2", p0, p1, q0, q1)."""

    def psi(p0: float, p1: float) -> Column:
        x4 = F.pow((F.col("x") - p0) / p1, 4)
        return x4 / (1 + x4)

    for step in steps:
        name, *args = (step,) if isinstance(step, str) else step
        if name in ("normalize", "shift"):
            ends = table.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
            y = F.col("y") / (F.col("hi") - F.col("lo")) if name == "normalize" else F.col("y") - F.col("lo")
            table = table.join(F.broadcast(ends)).withColumn("y", y).drop("lo", "hi")
        elif name == "absolute":
            table = table.withColumn("y", F.abs("y"))
        elif name == "exp":
            table = table.withColumn("y", F.col("y") * F.exp(-F.col("x")))
        elif name == "psi":
            table = table.withColumn("y", F.col("y") * psi(*args))
        elif name == "psi2":
            table = table.withColumn("y", F.col("y") * psi(*args[:2]) * psi(*args[2:]))
        else:
            raise ValueError(f"unknown operation {name!r}")
    return table
