"""The search for neighbours: what becomes of its pairs in a plan, and the two kinds of cells together."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from latticeworks.operators import neighbours as n
from latticeworks.plans import registry
from latticeworks.plans import views as v

SEARCH = "explode(sequence("


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-*0123456789()"))


@pytest.mark.parametrize("name", ["basis_fourier_r", "bop_q_linr", "atom_q_table", "bop_pair_features", "bop_average_features", "design_matrix_ani", "eam_design", "eam_forces", "eam_forces_tables", "legacy_forces", "triplet_features"])
def test_pairs_are_not_shuffled_sorted_or_stored(spark, sf_dir, name):
    """Between the search and the first sums there is no exchange, sort or checkpoint of pairs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = [k for k, line in enumerate(plan) if SEARCH in line]
    assert found and not any("ExistingRDD" in line and "centre_id" in line for line in plan)
    for k in found:
        depth, above = indent(plan[k]), []
        for line in reversed(plan[:k]):
            if line.strip() and indent(line) < depth:
                depth = indent(line)
                if "Aggregate(" in line:
                    break
                above.append(line)
        assert not any(word in line for line in above for word in ("Exchange hashpartitioning", "Sort [", "Window ["))


@pytest.mark.parametrize("name", ["taper_functions", "neighbour_list", "triplet_features"])
def test_loops_are_small_enough_to_be_compiled(spark, sf_dir, name):
    """No generated method that searches has more than the 8000 bytes that HotSpot compiles."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        parts = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().debug().codegenToSeq().iterator()
        sizes = []
        while parts.hasNext():
            part = parts.next()
            if SEARCH in part._1():
                sizes.append(part._3().maxMethodCodeSize())
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sizes and min(sizes) < 8000


@pytest.mark.parametrize("name", ["eam_forces", "legacy_forces", "legacy_atom_energy", "bop_average_features"])
def test_every_search_is_compiled(spark, sf_dir, name):
    """As above, of each search of a query, with all that follows it in its loop."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().debug().codegenToSeq().iterator()
        sizes = []
        while parts.hasNext():
            part = parts.next()
            if SEARCH in part._1():
                sizes.append(part._3().maxMethodCodeSize())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes and max(sizes) < 8000


def test_triplets_are_sorted_by_compiled_code(spark, sf_dir):
    """Neither a comparison by a lambda nor a rounding by decimal text for every triplet."""
    plan = registry.QUERIES["triplet_features"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(collect_list" in plan and "array_sort(" not in plan and "round(" not in plan.replace("rint(", "").lower()


def test_bond_order_needs_no_angles(spark, sf_dir):
    """Harmonics are polynomials of the unit vector; the atoms' columns are looked up once by species, and neighbours searched twice."""
    plan = registry.QUERIES["bop_average_features"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ATAN2" not in plan.upper() and plan.count(SEARCH + "cast(CEIL(((-hk") == 2


def filters(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter " in line]


def test_atoms_are_not_filtered_by_formulas_of_cells(spark, sf_dir):
    """No filter that is moved down to the tables computes a cell's size, also where there are cells of both kinds."""
    atoms = spark.range(40).select((F.col("id") % 4).alias("structure_id"), F.col("id").alias("atom_index"), F.lit("A").alias("species"), *((F.col("id") * p % 11 / 11.0).alias(c) for p, c in ((3, "u"), (5, "v"), (7, "w"))))
    cells = spark.range(4).select(F.col("id").alias("structure_id"), *v.sheared(2.0 + F.col("id") * 3.0))
    mixed = n.neighbours(n.atom_centres(atoms), atoms, cells, 2.5)
    assert "Union" in mixed._jdf.queryExecution().optimizedPlan().toString()
    for df in (registry.QUERIES["neighbour_list"](spark, sf_dir), mixed):
        found = [line for line in filters(df) if "<= 2." not in line]
        assert found and not any(word in line for line in found for word in ("transform(", "abs(", "SQRT("))


def test_atoms_of_a_task_are_bounded(spark, sf_dir, monkeypatch):
    """More atoms make more tasks, also of the sums over their pairs, whatever number of partitions a session has."""
    monkeypatch.setattr(v, "ATOMS_A_TASK", 100)
    atoms = v.atoms(spark, sf_dir)
    least = atoms.count() / 100
    assert least > 5
    assert atoms.rdd.getNumPartitions() >= least
    assert registry.QUERIES["bop_q"](spark, sf_dir).rdd.getNumPartitions() >= least
    assert atoms.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_set("structure_id").alias("s")).select(F.explode("s").alias("s")).groupBy("s").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("name", ["features_everything", "eam_energy_tables", "basis_fourier_r", "bop_q_linr"])
def test_distances_are_computed_in_the_loop(spark, sf_dir, name):
    """A pair's distance is plain arithmetic: a higher-order function would be interpreted for every pair."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert SEARCH in plan and "aggregate(array(" not in plan


def test_cells_are_dealt_out_as_one_number(spark, sf_dir):
    """The exchange of cells holds their key and size, not what is made of them, and meets the atoms without a second one."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["features_everything"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [k for k, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert len(dealt) == 3 and all("REPARTITION_BY_NUM" in plan[k] for k in dealt)
    cells = next(k for k in dealt if "o_orderkey" in plan[k + 1])
    assert plan[cells + 1].split("Project [")[1].count(" AS ") == 2


def test_densities_are_rescaled_with_one_search(spark, sf_dir):
    """Both the largest density and the rows are read from stored densities."""
    plan = registry.QUERIES["density_rescale"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert SEARCH not in plan


def test_large_and_small_cells_in_one_search(spark):
    """Small, large and flat cells, atoms without a position: pairs against brute force, with what is told of the neighbour."""
    rng = np.random.default_rng(3)
    sizes, at = {1: 2.0, 2: 9.0, 3: 0.0}, []
    cells = spark.createDataFrame([(s, a, 0.0, 0.0, 0.1 * a, a, 0.0, 0.0, 0.2 * a, a) for s, a in sizes.items()], "structure_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    for s, a in sizes.items():
        at += [(s, k, "AB"[k % 2], *map(float, rng.random(3)), float(k)) for k in range(5 if a < 5 else 40)]
    atoms = spark.createDataFrame([*at, (1, 99, "A", None, 0.5, 0.5, 0.0)], "structure_id long, atom_index long, species string, u double, v double, w double, mark double")
    found = n.neighbours(n.atom_centres(atoms), atoms, cells, 2.5, told=("mark",))
    got = found.select("structure_id", "centre_id", "neigh_index", "neigh_species", "mark", "i", "j", "k", F.round("r", 8).alias("r")).toArrow()
    want = []
    for s, a in sizes.items():
        own = [x for x in at if x[0] == s]
        for c in own:
            for m in own:
                for i, j, k in np.ndindex(7, 7, 7):
                    d = np.array(m[3:6]) - c[3:6] + (i - 3, j - 3, k - 3)
                    r = np.linalg.norm([a * d[0] + 0.1 * a * d[1], a * d[1] + 0.2 * a * d[2], a * d[2]])
                    if a and 1e-6 < r <= 2.5:
                        want.append((s, c[1], m[1], m[2], m[6], i - 3, j - 3, k - 3, round(float(r), 8)))
    import pyarrow as pa

    assert rows(got) == rows(pa.table(dict(zip(got.column_names, map(list, zip(*want)), strict=True))))
