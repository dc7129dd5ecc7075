"""Neighbours in crystals with known shells, invariants, and both search paths against each other."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.functions.geometry import CELL
from latticeworks.operators import features as ft
from latticeworks.operators import neighbours as nb


def cells(spark, rows):
    return spark.createDataFrame([(i, *np.asarray(c, float).ravel().tolist()) for i, c in rows], ["structure_id", *CELL])


def atoms(spark, rows):
    return spark.createDataFrame(rows, "structure_id long, atom_index long, species string, u double, v double, w double")


def fcc(spark, n=1):
    base = [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]
    at = [((x + i) / n, (y + j) / n, (z + k) / n) for i, j, k in itertools.product(range(n), repeat=3) for x, y, z in base]
    return atoms(spark, [(1, k, "A", *map(float, p)) for k, p in enumerate(at)]), cells(spark, [(1, np.eye(3) * 4 * n)])


@pytest.mark.parametrize("n", [1, 3])
def test_fcc_shells(spark, n):
    a, c = fcc(spark, n)
    near = nb.neighbours(nb.atom_centres(a), a, c, 4.1)
    shells = {(round(r.r, 5), r.n) for r in near.groupBy("centre_id", F.round("r", 5).alias("r")).agg(F.count("*").alias("n")).collect()}
    assert shells == {(round(4 / math.sqrt(2), 5), 12), (4.0, 6)}


def test_bins_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    cell = np.array([[9.0, 0, 0], [2.5, 8.0, 0], [-1.0, 3.0, 10.0]])
    pos = rng.random((60, 3))
    a, c = atoms(spark, [(7, i, "AB"[i % 2], *map(float, p)) for i, p in enumerate(pos)]), cells(spark, [(7, cell)])
    got = sorted((r.centre_id, r.neigh_index, r.i, r.j, r.k) for r in nb.neighbours(nb.atom_centres(a), a, c, 2.9).collect())
    want = []
    for s in itertools.product(range(-2, 3), repeat=3):
        d = (pos[None] + np.array(s) - pos[:, None]) @ cell
        r = np.sqrt((d * d).sum(-1))
        want += [(i, j, *s) for i, j in zip(*np.nonzero((r <= 2.9) & (r > 1e-6)), strict=True)]
    assert got == sorted(want)


def test_bond_order_of_fcc(spark):
    a, c = fcc(spark, 3)
    near = nb.neighbours(nb.atom_centres(a), a, c, 3.2)
    q = ft.bond_order(near, ["structure_id", "centre_id"], (4, 6)).first()
    assert q.q4 == pytest.approx(0.190941, abs=1e-5) and q.q6 == pytest.approx(0.574524, abs=1e-5)


def test_k_nearest_searches_wider(spark):
    a, c = atoms(spark, [(1, 0, "A", 0.0, 0.0, 0.0), (1, 1, "B", 0.5, 0.5, 0.5)]), cells(spark, [(1, np.eye(3) * 5)])
    near = nb.k_nearest(nb.atom_centres(a), a, c, 9, 1.0, ["structure_id", "centre_id"])
    counts = {r.centre_id: r.n for r in near.groupBy("centre_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 9, 1: 9}


def test_empty(spark):
    a, c = fcc(spark)
    assert nb.neighbours(nb.atom_centres(a.limit(0)), a, c, 3.0).count() == 0
