"""Queries: tabulated functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.functions import basis as b
from latticeworks.operators import tables as tb

from . import views as v
from .density import BINS, LOOK, RADIAL_SQL, STEP, radial
from .geometry import KEY, near_atoms
from .registry import query
from .views import R_CUT, r6, with_views

# Coefficients of the tabulated functions come from the tables: averages over a species' atoms.
COEF_SQL = "coef AS (SELECT species AS key, avg(fx) * 10 AS c0, avg(fy) * 10 AS c1, avg(u) AS c2 FROM atoms GROUP BY species)"


def coefficients(spark, sf_dir):
    return v.atoms(spark, sf_dir).groupBy(F.col("species").alias("key")).agg((F.avg("fx") * 10).alias("c0"), (F.avg("fy") * 10).alias("c1"), F.avg("u").alias("c2"))


GRID_SQL = f"grid AS (SELECT key, CAST(b AS INTEGER) AS bin, b * {STEP} AS x, c0 + c1 * cos(pi() * (b * {STEP}) / {R_CUT}) + c2 * cos(2 * pi() * (b * {STEP}) / {R_CUT}) AS y FROM coef, (SELECT unnest(range({BINS})) AS b))"


def regressed(spark, sf_dir):
    terms = [F.lit(1.0), b.cos_k(F.col("x"), 1, R_CUT), b.cos_k(F.col("x"), 2, R_CUT)]
    return tb.tabulate(coefficients(spark, sf_dir), BINS, STEP, sum((F.col(f"c{k}") * t for k, t in enumerate(terms)), F.lit(0.0)))


@query(with_views("atoms", f", {COEF_SQL}, {GRID_SQL} SELECT key, bin, round(y, 6) + 0.0 AS y FROM grid"))
def radial_functions(spark, sf_dir):
    """Weighted basis sums on a uniform grid for every species."""
    return regressed(spark, sf_dir).select("key", "bin", *r6("y"))


@query(with_views("atoms", f""", {COEF_SQL}, {GRID_SQL}, n AS (SELECT key, bin, x, abs(y / (SELECT max(y) - min(y) FROM grid)) AS y FROM grid), s AS (SELECT key, bin, x, (y - (SELECT min(y) FROM n)) * exp(-x) AS y FROM n)
SELECT key, bin, round(y * pow((x - 3) / 0.5, 4) / (1 + pow((x - 3) / 0.5, 4)), 6) + 0.0 AS y FROM s"""))
def radial_ops(spark, sf_dir):
    return tb.radial_operations(regressed(spark, sf_dir), ["normalize", "absolute", "shift", "exp", ("psi", 3.0, 0.5)]).select("key", "bin", *r6("y"))


@query(with_views("species near", f", {RADIAL_SQL} SELECT structure_id, centre_id, neigh_index, i, j, k, round({LOOK}, 6) + 0.0 AS y, round(p.slope, 5) + 0.0 AS dy FROM near JOIN pieces p ON p.species = neigh_species AND p.bin = least(greatest(CAST(floor(r / {STEP}) AS INTEGER), 0), {BINS - 2})"))
def spline_lookup(spark, sf_dir):
    """Value and slope of each neighbour's tabulated function, by linear pieces."""
    near = tb.lookup(near_atoms(spark, sf_dir), radial(spark), F.col("neigh_species"), F.col("r"), STEP, BINS)
    return near.select(*KEY, "neigh_index", "i", "j", "k", *r6("y"), (F.round("dy", 5) + 0.0).alias("dy"))


@query(with_views("species near", "SELECT structure_id, centre_id, round(sum(10 * eps * exp(-r / sigma)), 3) + 0.0 AS y, round(sum(-10 * eps / sigma * exp(-r / sigma)), 2) + 0.0 AS dy FROM near JOIN species_ref ON species = neigh_species GROUP BY ALL"))
def spline_lookup_cubic(spark, sf_dir):
    """The same by not-a-knot cubic splines, close enough to the functions themselves to be held against them."""
    c = tb.cubic_coefficients(radial(spark))
    near = tb.cubic_lookup(near_atoms(spark, sf_dir), c, F.col("neigh_species"), F.col("r"), STEP, BINS)
    return near.groupBy(*KEY).agg(F.sum("y").alias("y"), F.sum("dy").alias("dy")).select(*KEY, (F.round("y", 3) + 0.0).alias("y"), (F.round("dy", 2) + 0.0).alias("dy"))


@query("""WITH v AS (SELECT user_id, event_id, value * sqrt(2) AS value FROM events), e AS (SELECT user_id, event_id AS x, value AS y, lead(event_id) OVER w AS x1, lead(value) OVER w AS y1, lag(event_id) OVER w AS x0, lag(value) OVER w AS y0 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, x, round((coalesce(y1, y) - coalesce(y0, y)) / nullif(coalesce(x1, x) - coalesce(x0, x), 0), 6) + 0.0 AS dy FROM e""")
def derivative_differences(spark, sf_dir):
    """Each user's values (by an irrational, so that no quotient is a rounding tie) as a function of the event's number: symmetric differences, null for a single point."""
    e = v.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), (F.col("value") * F.sqrt(F.lit(2.0))).alias("y"))
    w = F.count("*").over(Window.partitionBy("user_id"))
    made = tb.differences(e.withColumn("n", w).where("n > 1").drop("n"), ["user_id"], "x").unionByName(e.withColumn("n", w).where("n = 1").select("user_id", "x", "y", F.lit(None).cast("double").alias("dy")))
    return made.select("user_id", "x", *r6("dy"))
