"""Errors of energies and forces from two searches: against the design rows, and what their plan reads, deals out and compiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.operators import eam
from latticeworks.operators import neighbours as nb
from latticeworks.plans import registry

SEARCH = "explode(sequence("


def test_errors_against_design_rows(spark):
    """With atoms at one place, without a place or a target, structures without a cell, with a flat one, with no or two energies."""
    rng = np.random.default_rng(11)
    form, w = eam.Form(2, 9.0, 3.1, 0.3, 0.4), list(map(float, rng.normal(size=10)))
    blocks = spark.createDataFrame([("emb", "A", 0), ("emb", "B", 2), ("pair", "A-A", 4), ("pair", "A-B", 6), ("pair", "B-B", 8)], "kind string, key string, start int")
    rows = [[s, k, "AB"[k % 2], *map(float, rng.random(3)), *map(float, rng.normal(size=3))] for s in range(6) for k in range(3 + s % 2)]
    rows[1][3:6] = rows[0][3:6]  # both in structure 0
    rows[4][3] = rows[5][6] = None  # of structure 1
    rows[7][6:9] = [None] * 3  # of structure 2
    atoms = spark.createDataFrame(rows, "structure_id long, atom_index long, species string, u double, v double, w double, fx double, fy double, fz double")
    cells = spark.createDataFrame([(s, a, 0.0, 0.0, 0.3, a, 0.0, 0.0, 0.4, a) for s, a in ((0, 3.3), (1, 3.5), (2, 9.9), (4, 0.0), (5, 2.9))], "structure_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    energies = {0: [-3.0], 1: [2.0], 2: [1.0, 4.0], 3: [5.0], 4: [0.5]}
    reference = {"A": -2.0, "B": -1.0}
    look = lambda near: near.withColumns({"y": F.when(F.col("neigh_species") == "A", 0.7).otherwise(1.1) * F.exp(-0.8 * F.col("r")), "dy": F.when(F.col("neigh_species") == "A", -0.56).otherwise(-0.88) * F.exp(-0.8 * F.col("r"))})
    found = lambda centres: look(nb.neighbours(centres, atoms, cells, 3.1, None))
    sums = eam.atom_sums(found(eam.embedded_centres(found(eam.placed_centres(atoms)), blocks, form, w)), blocks, form, w)
    errors = eam.structure_errors(sums, atoms, spark.createDataFrame(list(reference.items()), "species string, e_ref double"))
    given = spark.createDataFrame([(s, e) for s, es in energies.items() for e in es], "structure_id long, energy double")
    got = eam.distances(errors, given, F.col("energy") / F.col("n") - F.col("e_ref") / F.col("n")).first()

    near = look(nb.neighbours(nb.atom_centres(atoms), atoms, cells, 3.1))
    y = {r.structure_id: r.y for r in eam.weighted(eam.energy_design(near, atoms, blocks, form), ["structure_id"], spark.createDataFrame(list(enumerate(w)), "col int, w double"), "y").collect()}
    force = {(r.structure_id, r.atom_index, r.axis): r.f for r in eam.forces(near, blocks, form, w).collect()}
    assert len(force) > 20
    squares, mean = 0.0, 0.0
    for s in range(6):
        own = [r for r in rows if r[0] == s]
        d = [np.sqrt(sum((force.get((s, r[1], a), 0.0) - t) ** 2 for a, t in enumerate(r[6:]) if t is not None)) for r in own if any(t is not None for t in r[6:])]
        mean += np.mean(d) / 3
        squares += sum((e / len(own) - np.mean([reference[r[2]] for r in own]) - y[s]) ** 2 for e in energies.get(s, []))
    assert got.error == pytest.approx(np.sqrt(squares)) and got.force_error == pytest.approx(mean) and got.total == pytest.approx(np.sqrt(squares) + mean)


def test_errors_deal_out_each_table_once(spark, sf_dir):
    """One exchange of the atoms serves both searches and the targets; nothing is dealt out by atom or axis."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.QUERIES["eam_errors"](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("FileScan parquet [l_" in line for line in plan) == 1
    dealt = [line for line in plan if "Exchange hashpartitioning(structure_id" in line and "ReusedExchange" not in line]
    assert len(dealt) == 3 and all("REPARTITION_BY_NUM" in line for line in dealt)


def test_searches_of_errors_are_two_and_compiled(spark, sf_dir):
    for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "false" if "adaptive" in k else "-1")
    try:
        execution = registry.QUERIES["eam_errors"](spark, sf_dir)._jdf.queryExecution()
        assert execution.optimizedPlan().toString().count(SEARCH + "cast(CEIL(((-hk") == 2
        parts, sizes = execution.debug().codegenToSeq().iterator(), []
        while parts.hasNext():
            part = parts.next()
            if SEARCH in part._1():
                sizes.append(part._3().maxMethodCodeSize())
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
    assert sizes and max(sizes) < 8000
