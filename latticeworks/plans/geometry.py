"""Queries: coordinates, periodic images, neighbours, triplets, selection and order of structures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.functions import geometry as g
from latticeworks.operators import neighbours as n
from latticeworks.operators import structures as st

from . import views as v
from .registry import query
from .views import R_ANI, R_CUT, r6, with_views

NEAR = with_views("near", "")
KEY = ["structure_id", "centre_id"]


def near_atoms(spark, sf_dir, r_cut: float = R_CUT):
    atoms = v.atoms(spark, sf_dir).drop("fx", "fy", "fz")
    return n.neighbours(n.atom_centres(atoms), atoms, v.dealt_cells(spark, sf_dir), r_cut)


@query(with_views("structures atoms", "SELECT structure_id, atom_index, round(a * u + 0.1 * a * v, 6) + 0.0 AS x, round(a * v + 0.2 * a * w, 6) + 0.0 AS y, round(a * w, 6) + 0.0 AS z FROM atoms JOIN structures USING (structure_id)"))
def frac_to_cart(spark, sf_dir):
    x, y, z = g.cartesian(F.col("u"), F.col("v"), F.col("w"))
    both = v.atoms(spark, sf_dir).join(v.cells(spark, sf_dir), "structure_id")
    return both.select("structure_id", "atom_index", x.alias("x"), y.alias("y"), z.alias("z")).select("structure_id", "atom_index", *r6("x", "y", "z"))


@query(with_views("structures atoms", """, c AS (SELECT structure_id, atom_index, fx + sqrt(2) AS x, fy + sqrt(3) AS y, fz + sqrt(5) AS z, a FROM atoms JOIN structures USING (structure_id))
SELECT structure_id, atom_index, round((x - 0.1 * (y - 0.2 * z)) / a, 6) + 0.0 AS u, round((y - 0.2 * z) / a, 6) + 0.0 AS v, round(z / a, 6) + 0.0 AS w FROM c"""))
def cart_to_frac(spark, sf_dir):
    """Of force vectors moved off the origin, by the inverse of the sheared cell."""
    u, w, z = g.fractional(*(F.col(f) + F.sqrt(F.lit(x)) for f, x in (("fx", 2.0), ("fy", 3.0), ("fz", 5.0))))
    both = v.atoms(spark, sf_dir).drop("u", "v", "w").join(v.cells(spark, sf_dir), "structure_id")
    return both.select("structure_id", "atom_index", u.alias("u"), w.alias("v"), z.alias("w")).select("structure_id", "atom_index", *r6("u", "v", "w"))


@query(with_views("atoms", "SELECT structure_id, atom_index, round(u * 3 - 1.7 - floor(u * 3 - 1.7), 6) + 0.0 AS u, round(fz * 9 - floor(fz * 9), 6) + 0.0 AS w FROM atoms"))
def wrap_positions(spark, sf_dir):
    return v.atoms(spark, sf_dir).select("structure_id", "atom_index", g.wrapped(F.col("u") * 3 - 1.7).alias("u"), g.wrapped(F.col("fz") * 9).alias("w")).select("structure_id", "atom_index", *r6("u", "w"))


@query(with_views("structures", "SELECT structure_id, round(a * a * a, 6) + 0.0 AS volume, round(a / sqrt(1 + 0.1 * 0.1 + 0.02 * 0.02), 6) + 0.0 AS h_a FROM structures"))
def cell_volume(spark, sf_dir):
    return v.cells(spark, sf_dir).select("structure_id", g.volume().alias("volume"), g.heights()[0].alias("h_a")).select("structure_id", *r6("volume", "h_a"))


@query(with_views("structures atoms", """SELECT structure_id, count(*) AS n_images, round(sum(a * (u + i) + 0.1 * a * (v + j)), 4) + 0.0 AS sum_x, round(sum(abs(a * (w + k))), 4) + 0.0 AS sum_z
FROM atoms JOIN structures USING (structure_id), (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j), (SELECT unnest(range(-1, 2)) AS k) GROUP BY structure_id"""))
def image_expand(spark, sf_dir):
    made = n.images(v.atoms(spark, sf_dir).select("structure_id", "atom_index", "u", "v", "w"), v.cells(spark, sf_dir), R_CUT)
    return made.groupBy("structure_id").agg(F.count("*").alias("n_images"), (F.round(F.sum("x"), 4) + 0.0).alias("sum_x"), (F.round(F.sum(F.abs("z")), 4) + 0.0).alias("sum_z"))


@query(NEAR + """SELECT structure_id, centre_id, neigh_index, neigh_species, least(centre_species, neigh_species) AS sp0, greatest(centre_species, neigh_species) AS sp1, i, j, k,
round(r, 6) + 0.0 AS r, round(ux, 6) + 0.0 AS ux, round(uy, 6) + 0.0 AS uy, round(uz, 6) + 0.0 AS uz FROM near""")
def neighbour_list(spark, sf_dir):
    sp0, sp1 = g.sorted_pair(F.col("centre_species"), F.col("neigh_species"))
    return near_atoms(spark, sf_dir).select(*KEY, "neigh_index", "neigh_species", sp0.alias("sp0"), sp1.alias("sp1"), "i", "j", "k", *r6("r", "ux", "uy", "uz"))


@query(NEAR + "SELECT structure_id, centre_id, neigh_index, i, j, k, round(atan2(uy, ux) + pi(), 5) + 0.0 AS phi, round(acos(least(1, greatest(-1, uz))), 5) + 0.0 AS theta FROM near WHERE abs(uz) < 0.99999")
def neighbour_angles(spark, sf_dir):
    near = near_atoms(spark, sf_dir).where(F.abs("uz") < 0.99999)
    return near.select(*KEY, "neigh_index", "i", "j", "k", (F.round(g.azimuth(F.col("ux"), F.col("uy")), 5) + 0.0).alias("phi"), (F.round(g.polar(F.col("uz")), 5) + 0.0).alias("theta"))


@query(with_views("ranked", "SELECT structure_id, centre_id, rank, neigh_index, round(r, 6) + 0.0 AS r FROM ranked WHERE rank <= 5"))
def neighbour_rank(spark, sf_dir):
    return n.ranked(near_atoms(spark, sf_dir), KEY).where("rank <= 5").select(*KEY, F.col("rank").cast("long").alias("rank"), "neigh_index", *r6("r"))


@query("""WITH RECURSIVE """ + with_views("structures atoms", """, shifts2 AS (SELECT i.i, j.j, k.k FROM (SELECT unnest(range(-2, 3)) AS i) i, (SELECT unnest(range(-2, 3)) AS j) j, (SELECT unnest(range(-2, 3)) AS k) k),
cand AS (SELECT c.structure_id, c.atom_index AS centre_id, m.atom_index AS neigh_index, m.species AS neigh_species, h.i, h.j, h.k, s.a, m.u + h.i - c.u AS du, m.v + h.j - c.v AS dv, m.w + h.k - c.w AS dw
  FROM atoms c JOIN atoms m USING (structure_id) JOIN structures s USING (structure_id), shifts2 h WHERE structure_id % 20 = 0),
d AS (SELECT *, sqrt((a * du + 0.1 * a * dv) ** 2 + (a * dv + 0.2 * a * dw) ** 2 + (a * dw) ** 2) AS r FROM cand),
k AS (SELECT *, row_number() OVER (PARTITION BY structure_id, centre_id ORDER BY round(r, 8), neigh_species, neigh_index, i, j, k) AS rank FROM d WHERE r > 1e-6)
SELECT structure_id, centre_id, rank, neigh_index, round(r, 6) + 0.0 AS r FROM k WHERE rank <= 6""").removeprefix("WITH "))
def neighbour_knn(spark, sf_dir):
    """Searches: every structure whose id is divisible by 20 asks for the six nearest images of each of its atoms."""
    atoms = v.atoms(spark, sf_dir).drop("fx", "fy", "fz")
    found = n.k_nearest(n.atom_centres(atoms).where("structure_id % 20 = 0"), atoms, v.cells(spark, sf_dir), 6, R_CUT, KEY)
    return found.select(*KEY, F.col("rank").cast("long").alias("rank"), "neigh_index", *r6("r"))


@query(with_views("triplets", "SELECT structure_id, centre_id, sp0, sp1, count(*) AS n, round(sum(r0 + 2 * r1), 5) + 0.0 AS sum_r, round(sum(theta), 4) + 0.0 AS sum_theta FROM triplets GROUP BY ALL"))
def triplet_angles(spark, sf_dir):
    found = n.triplets(near_atoms(spark, sf_dir), KEY, R_ANI)
    return found.groupBy(*KEY, "sp0", "sp1").agg(F.count("*").alias("n"), (F.round(F.sum(F.col("r0") + 2 * F.col("r1")), 5) + 0.0).alias("sum_r"), (F.round(F.sum("theta"), 4) + 0.0).alias("sum_theta"))


@query(with_views("near", """SELECT structure_id, centre_id, coalesce(neigh_species, 'all') AS species, count(*) AS n, round(min(r), 6) + 0.0 AS r_min, round(sum(r), 5) + 0.0 AS r_sum, round(sum(ux), 5) + 0.0 AS ux_sum
FROM near GROUP BY GROUPING SETS ((structure_id, centre_id, neigh_species), (structure_id, centre_id))"""))
def neighbour_stats(spark, sf_dir):
    return st.neighbour_statistics(near_atoms(spark, sf_dir), KEY).select(*KEY, "species", "n", *r6("r_min"), (F.round("r_sum", 5) + 0.0).alias("r_sum"), (F.round("ux_sum", 5) + 0.0).alias("ux_sum"))


@query(with_views("atoms", "SELECT DISTINCT least(x.species, y.species) AS sp0, greatest(x.species, y.species) AS sp1 FROM (SELECT DISTINCT structure_id, species FROM atoms) x JOIN (SELECT DISTINCT structure_id, species FROM atoms) y USING (structure_id)"))
def pair_domain(spark, sf_dir):
    return st.pair_domain(v.atoms(spark, sf_dir))


@query(with_views("structures", """, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (structure_id * 7919 + 13) % 1000003, structure_id) AS n, count(*) OVER (PARTITION BY grp) AS m FROM structures)
SELECT structure_id, name FROM r WHERE (grp = 'O' AND n <= 50) OR (grp = 'F' AND n <= floor(0.25 * m)) OR grp = 'P'"""))
def select_structures(spark, sf_dir):
    every = v.structures(spark, sf_dir)
    rules = [("O", ("uniform", 50, "absolute")), ("F", ("uniform", 0.25, "relative")), ("P", ("all",))]
    return st.select_structures(every, rules, "grp").select("structure_id", "name")


@query(with_views("structures", "SELECT structure_id, name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS place FROM structures"))
def structure_order(spark, sf_dir):
    return st.numbered(v.structures(spark, sf_dir).select("structure_id", "name"), "name", "place")


@query(with_views("atoms", """, s AS (SELECT structure_id, count(DISTINCT species) AS k, min(species) AS one FROM atoms GROUP BY structure_id)
SELECT structure_id, one AS grp FROM s WHERE k = 1 UNION ALL SELECT structure_id, 'ALL' FROM s"""))
def element_groups(spark, sf_dir):
    return st.element_groups(v.atoms(spark, sf_dir))


@query("""WITH f AS (SELECT o_orderkey, x.code, x.ext, x.prec, CASE WHEN o_orderkey % 3 = 0 AND x.prec = 0 THEN NULL ELSE o_totalprice + x.prec END AS energy,
  CASE WHEN x.prec = 2 THEN NULL ELSE o_custkey * 10 + x.prec END AS enthalpy FROM orders, (VALUES ('one', 'castep', 2), ('one', 'md', 1), ('one', 'geom', 0)) x(code, ext, prec) WHERE (o_orderkey + x.prec) % 4 <> 1)
SELECT 'S' || o_orderkey AS name, arg_min(energy, prec) AS energy, CAST(arg_min(enthalpy, prec) AS BIGINT) AS enthalpy, string_agg(ext, ',' ORDER BY ext) AS files, CAST(count(DISTINCT code) AS BIGINT) AS codes
FROM f GROUP BY o_orderkey HAVING arg_min(energy, prec) IS NOT NULL""")
def merge_structures(spark, sf_dir):
    """Three partial records of each structure by file type; the first non-null value in order of precedence wins."""
    kinds = spark.createDataFrame([("one", "castep", 2), ("one", "md", 1), ("one", "geom", 0)], "code string, ext string, prec int")
    parts = v.table(spark, sf_dir, "orders").join(F.broadcast(kinds)).where((F.col("o_orderkey") + F.col("prec")) % 4 != 1)
    parts = parts.select(
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("name"), "code", "prec", F.array("ext").alias("files"),
        F.when((F.col("o_orderkey") % 3 == 0) & (F.col("prec") == 0), None).otherwise(F.col("o_totalprice") + F.col("prec")).alias("energy"),
        F.when(F.col("prec") == 2, None).otherwise(F.col("o_custkey") * 10 + F.col("prec")).alias("enthalpy"),
    )
    merged = st.merge_by_precedence(parts, ["energy", "enthalpy"]).where(F.col("energy").isNotNull())
    return merged.select("name", "energy", "enthalpy", F.array_join("files", ",").alias("files"), F.col("codes").cast("long").alias("codes"))


@query(with_views("atoms", """, one AS (SELECT DISTINCT structure_id FROM atoms WHERE species = 'A'), two AS (SELECT DISTINCT structure_id FROM atoms WHERE species = 'R')
SELECT 'both' AS kind, structure_id FROM (SELECT * FROM one INTERSECT SELECT * FROM two) UNION ALL SELECT 'only_a', structure_id FROM (SELECT * FROM one EXCEPT SELECT * FROM two)
UNION ALL SELECT 'any', structure_id FROM (SELECT * FROM one UNION SELECT * FROM two)"""))
def active_set_ops(spark, sf_dir):
    atoms = v.atoms(spark, sf_dir)
    one, two = (atoms.where(F.col("species") == s).select("structure_id").distinct() for s in "AR")
    tag = lambda kind, df: df.select(F.lit(kind).alias("kind"), "structure_id")
    return tag("both", one.intersect(two)).unionAll(tag("only_a", one.exceptAll(two))).unionAll(tag("any", one.union(two).distinct()))


@query(with_views("atoms structures", """SELECT structure_id, count(*) AS n_atoms, round(sum(fx * (a * u + 0.1 * a * v)), 5) + 0.0 AS xx, round(sum(fy * (a * u + 0.1 * a * v)), 5) + 0.0 AS xy, round(sum(fz * a * w), 5) + 0.0 AS zz
FROM atoms JOIN structures USING (structure_id) GROUP BY structure_id"""))
def virial(spark, sf_dir):
    t = st.virial(v.atoms(spark, sf_dir), v.cells(spark, sf_dir))
    return t.select("structure_id", "n_atoms", *((F.round(c, 5) + 0.0).alias(c) for c in ("xx", "xy", "zz")))


@query("""SELECT o_orderkey AS structure_id, CASE WHEN o_totalprice < 20000 THEN 'energy' WHEN o_orderstatus NOT IN ('O', 'F') THEN 'code' WHEN o_custkey % 11 = 0 THEN 'count' ELSE 'valid' END AS reason FROM orders""")
def dq_structures(spark, sf_dir):
    """Every structure with the first rule that it breaks."""
    o = v.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "structure_id")
    rules = [("energy", F.col("o_totalprice") < 20000), ("code", ~F.col("o_orderstatus").isin("O", "F")), ("count", F.col("o_custkey") % 11 == 0)]
    return st.checked(o, rules).select("structure_id", "reason")


@query(with_views("near", """, e AS (SELECT structure_id, centre_id, count(*) AS n, sum(r) AS s FROM near GROUP BY ALL)
SELECT a.structure_id, a.atom_index AS centre_id, a.species AS centre_species, coalesce(e.n, 0) AS n, round(coalesce(s, 0), 5) + 0.0 AS r_sum, round(st.energy / (SELECT count(*) FROM atoms z WHERE z.structure_id = a.structure_id), 9) + 0.0 AS energy
FROM atoms a JOIN structures st USING (structure_id) LEFT JOIN e ON e.structure_id = a.structure_id AND e.centre_id = a.atom_index"""))
def atom_environments(spark, sf_dir):
    """Every atom with its neighbours' count and distances and its structure's energy per atom, in one plan."""
    atoms = v.atoms(spark, sf_dir)
    near = near_atoms(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("r").alias("s"))
    energy = atoms.withColumn("m", F.count("*").over(Window.partitionBy("structure_id"))).join(v.structures(spark, sf_dir), "structure_id")
    own = energy.select("structure_id", F.col("atom_index").alias("centre_id"), F.col("species").alias("centre_species"), (F.col("energy") / F.col("m")).alias("energy"))
    return own.join(near, KEY, "left").select(*KEY, "centre_species", F.coalesce("n", F.lit(0)).alias("n"), (F.round(F.coalesce("s", F.lit(0.0)), 5) + 0.0).alias("r_sum"), (F.round("energy", 9) + 0.0).alias("energy"))
