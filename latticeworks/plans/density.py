"""Queries: sample points of density grids, and densities predicted from radial functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeworks.operators import sampling as s
from latticeworks.operators import tables as tb

from . import views as v
from .features import point_neighbours
from .registry import query
from .views import r6, with_views

#: Radial tables: bins and step.
BINS, STEP = 300, 0.01
RADIAL_SQL = f"radial AS (SELECT species, CAST(b AS INTEGER) AS bin, b * {STEP} AS x, 10 * eps * exp(-(b * {STEP}) / sigma) AS y FROM species_ref, (SELECT unnest(range({BINS})) AS b)), pieces AS (SELECT x.species, x.bin, x.x, x.y, (y.y - x.y) / (y.x - x.x) AS slope FROM radial x JOIN radial y ON x.species = y.species AND y.bin = x.bin + 1)"
LOOK = "p.y + p.slope * (r - p.x)"


def radial(spark):
    """Decaying functions of each species as linear pieces."""
    made = tb.tabulate(v.species(spark).withColumnRenamed("species", "key"), BINS, STEP, 10 * F.col("eps") * F.exp(-F.col("x") / F.col("sigma")))
    return tb.linear_pieces(made, ["key"]).select("key", "bin", "x", "y", "slope")


def _points(spark, sf_dir):
    return v.grid_points(spark, sf_dir)


@query(with_views("points", """, n AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY point_id) - 1 AS pos FROM points), g AS (SELECT structure_id, count(*) AS n FROM points GROUP BY 1),
d AS (SELECT structure_id, CAST(draw AS INTEGER) AS draw, CAST(floor((((draw * 31 + structure_id) * 7919 + 104729) % 1000003 + 0.5::DOUBLE) / 1000003 * n) AS BIGINT) AS pos FROM (SELECT structure_id, n, unnest(range(least(5, n))) AS draw FROM g))
SELECT d.structure_id, d.draw, n.point_id FROM d JOIN n USING (structure_id, pos)"""))
def sample_points_random(spark, sf_dir):
    return s.with_replacement(_points(spark, sf_dir), "structure_id", "point_id", 5).select("structure_id", "draw", "point_id")


@query(with_views("points", """, above AS (SELECT *, density - min(density) OVER (PARTITION BY structure_id) AS gain FROM points),
r AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY CASE WHEN gain > 0 THEN round(-ln(((point_id * 7919 + 104729) % 1000003 + 0.5::DOUBLE) / 1000003) / gain, 9) ELSE 'inf'::DOUBLE END, point_id) AS n FROM above)
SELECT structure_id, point_id FROM r WHERE n <= 4"""))
def sample_points_importance(spark, sf_dir):
    return s.by_importance(_points(spark, sf_dir), "structure_id", "point_id", "density", 4).select("structure_id", "point_id")


DIST_SQL = with_views("points atoms structures", """, e AS (SELECT p.structure_id, p.point_id, n.atom_index, a, n.u - p.u AS du, n.v - p.v AS dv, n.w - p.w AS dw FROM points p JOIN atoms n USING (structure_id) JOIN structures USING (structure_id)),
d AS (SELECT structure_id, point_id, atom_index, sqrt((a * du + 0.1 * a * dv) ** 2 + (a * dv + 0.2 * a * dw) ** 2 + (a * dw) ** 2) AS r FROM e)
""")


def _all_three(spark, sf_dir):
    return _points(spark, sf_dir), v.atoms(spark, sf_dir), v.cells(spark, sf_dir)


@query(DIST_SQL + "SELECT DISTINCT structure_id, point_id FROM d WHERE r <= 1.5013")
def points_near_atoms(spark, sf_dir):
    return s.near_atoms(_points(spark, sf_dir), v.places(spark, sf_dir), v.cells(spark, sf_dir), 1.5013)


@query(DIST_SQL + "SELECT DISTINCT structure_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, atom_index ORDER BY round(r, 8), point_id) AS n FROM d) WHERE n <= 3")
def points_knn_atoms(spark, sf_dir):
    return s.nearest_of_atoms(*_all_three(spark, sf_dir), 3)


@query(DIST_SQL + "SELECT DISTINCT structure_id, point_id FROM (SELECT *, rank() OVER (PARTITION BY structure_id, atom_index ORDER BY round(r, 8)) AS n FROM d) WHERE n = 1")
def points_nearest_atom(spark, sf_dir):
    return s.nearest_of_atoms(*_all_three(spark, sf_dir), 1, ties=True)


@query(with_views("points", "SELECT structure_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY (point_id * 7919) % 1000003, point_id) AS n FROM points) WHERE n <= 3"))
def subsample_observations(spark, sf_dir):
    return s.subsample(_points(spark, sf_dir), "structure_id", "point_id", 3).select("structure_id", "point_id")


@query("SELECT l_orderkey AS structure_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_quantity AS q, round(l_discount - 0.05 - ((SELECT min(l_discount) FROM lineitem) - 0.05 - 1e-6), 6) + 0.0 AS density FROM lineitem")
def shift_densities(spark, sf_dir):
    line = v.table(spark, sf_dir, "lineitem").withColumn("density", F.col("l_discount") - 0.05)
    out = s.shift_positive(line, "density")
    return out.select(F.col("l_orderkey").alias("structure_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("q"), *r6("density"))


@query(with_views("species pnear", f", {RADIAL_SQL} SELECT point_id, round(any_value(density), 6) + 0.0 AS density, round(sum({LOOK}), 5) + 0.0 AS predicted FROM pnear JOIN pieces p ON p.species = neigh_species AND p.bin = least(greatest(CAST(floor(r / {STEP}) AS INTEGER), 0), {BINS - 2}) GROUP BY point_id"))
def predict_density(spark, sf_dir):
    """Density at every grid point as the sum of its neighbours' radial functions."""
    near = tb.lookup(point_neighbours(spark, sf_dir), radial(spark), F.col("neigh_species"), F.col("r"), STEP, BINS)
    return near.groupBy(F.col("obs_id").alias("point_id")).agg(F.first("density").alias("density"), F.sum("y").alias("p")).select("point_id", *r6("density"), (F.round("p", 5) + 0.0).alias("predicted"))
