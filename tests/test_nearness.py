"""Points near atoms: against brute force, and how often an atom is copied or dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.operators import sampling
from latticeworks.plans import registry

CELLS = "structure_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
PLACE = "structure_id long, {} long, u double, v double, w double"


def tables(spark):
    """Cells of no, one and many bins, thin and flat ones; points outside of their cell, twice, without a place, an atom or a cell."""
    rng = np.random.default_rng(4)
    sides = {1: (2.0, 2.0, 2.0), 2: (40.0, 30.0, 25.0), 3: (12.0, 11.0, 0.9), 4: (0.0, 0.0, 0.0), 5: (7.0, 7.0, 7.0), 7: (5.0, 5.0, 5.0)}
    cell = {s: np.array([[a, 0, 0], [0.1 * b, b, 0], [0, 0.2 * c, c]]) for s, (a, b, c) in sides.items()}
    points = [(s, 1000 * s + k, *map(float, rng.random(3) * 1.6 - 0.3)) for s in (1, 2, 3, 4, 5, 6) for k in range(150)]
    points += [(3, 3900 + k, 0.5, 0.5, float(k) - 6.0) for k in range(12)] + points[:20] + [(1, 1990, None, 0.5, 0.5), (None, 1991, 0.1, 0.1, 0.1)]
    atoms = [(s, k, *map(float, rng.random(3))) for s in (1, 2, 3, 4, 6, 7) for k in range(30 if s == 2 else 3)] + [(3, 50, 0.5, 0.5, 1.2), (2, 51, None, 0.1, 0.1)]
    make = lambda rows, key: spark.createDataFrame(rows, PLACE.format(key)).repartition(3)
    return points, atoms, cell, make(points, "point_id"), make(atoms, "atom_index"), spark.createDataFrame([(s, *map(float, c.ravel())) for s, c in cell.items()], CELLS)


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_points_near_atoms_of_all_kinds_of_cells(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "FEW", few)
    points, atoms, cell, *given = tables(spark)
    for r in (0.3, 1.5, 3.0):
        want = {(p[0], p[1]) for p in points for a in atoms if p[0] == a[0] and p[0] in cell and None not in (*p, *a) and np.linalg.norm((np.array(a[2:]) - p[2:]) @ cell[p[0]]) <= r}
        got = [(x.structure_id, x.point_id) for x in sampling.near_atoms(*given, r).collect()]
        assert len(got) == len(set(got)) and set(got) == want and {s for s, _ in want} >= {1, 3, 4}
    pairs = {(x.structure_id, x.point_id, x.atom_index) for x in sampling.within_reach(*given[:2], given[2].withColumn("reach", F.lit(3.0))).collect()}
    assert {(s, p) for s, p, _ in pairs} == want


def test_atoms_are_copied_to_few_bins(spark):
    """To none where a cell has one bin, to eight at most elsewhere."""
    rng = np.random.default_rng(8)
    atoms = spark.createDataFrame([(s, k, *map(float, rng.random(3))) for s in (1, 2) for k in range(100)], PLACE.format("atom_index"))
    cells = spark.createDataFrame([(1, 3.2, 0.0, 0.0, 0.32, 3.2, 0.0, 0.0, 0.64, 3.2), (2, 50.0, 0.0, 0.0, 0.0, 50.0, 0.0, 0.0, 0.0, 50.0)], CELLS)
    points = atoms.withColumnRenamed("atom_index", "point_id")
    df = sampling.within_reach(points, atoms, cells.withColumn("reach", F.lit(1.5)))
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    copies = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.children().apply(1))
    assert 100 + 400 < copies.count() <= 100 + 800


def test_atoms_are_not_dealt_out_for_a_few_structures(spark, sf_dir):
    """Atoms of structures without points are dropped where they are read, before any exchange; no pair of point and atom is made."""
    plan = registry.QUERIES["points_near_atoms"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Window" not in plan
    assert sum("Join LeftSemi" in line for line in plan.split("\n")) >= 2
