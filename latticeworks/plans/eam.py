"""Queries: embedding densities, energies, forces, fits and classic potentials."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.functions import geometry as g
from latticeworks.functions.basis import PI, damping
from latticeworks.operators import eam as e
from latticeworks.operators import neighbours as nb
from latticeworks.operators import regression as rg
from latticeworks.operators import tables as tb

from . import views as v
from .density import BINS, RADIAL_SQL, STEP, radial
from .geometry import KEY, near_atoms
from .registry import query
from .regression import solution_sql
from .views import R_ANI, R_CUT, r6, with_views

K = 3
FORM = e.Form(K, 12.0, R_CUT, 0.3, 0.3)
ALPHA, BETA_E, BETA_F = 0.7, 1.3, 2.1
N_COLUMNS = 9 * K
BLOCKS = [("emb", s, K * n) for n, s in enumerate("ANR")] + [("pair", p, K * (3 + n)) for n, p in enumerate(("A-A", "A-N", "A-R", "N-N", "N-R", "R-R"))]
WEIGHTS = [((c * 37 + 11) % 17 - 8) / 20 for c in range(N_COLUMNS)]


def columns(spark):
    return spark.createDataFrame(BLOCKS, "kind string, key string, start int")


def weights(spark):
    return spark.createDataFrame(list(enumerate(WEIGHTS)), "col int, w double")


def near_tabulated(spark, sf_dir):
    """Neighbours with value and slope of their function (y, dy)."""
    return tb.lookup(near_atoms(spark, sf_dir), radial(spark), F.col("neigh_species"), F.col("r"), STEP, BINS)


def near_dense(spark, sf_dir):
    """near_tabulated with rho of the centre: a search for the densities, then one whose centres carry them."""
    atoms = v.atoms(spark, sf_dir).drop("fx", "fy", "fz")
    near = nb.neighbours(e.dense_centres(near_tabulated(spark, sf_dir), atoms), atoms, v.dealt_cells(spark, sf_dir), R_CUT)
    return tb.lookup(near, radial(spark), F.col("neigh_species"), F.col("r"), STEP, BINS)


def densities(spark, sf_dir):
    near = near_tabulated(spark, sf_dir)
    return near, e.embedding_density(near, v.atoms(spark, sf_dir))


AT = f"least(greatest(CAST(floor(r / {STEP}) AS INTEGER), 0), {BINS - 2})"
RHO_SQL = f"""{RADIAL_SQL}, looked AS (SELECT n.*, p.y + p.slope * (r - p.x) AS y, p.slope AS dy, q.slope AS dy_centre FROM near n JOIN pieces p ON p.species = neigh_species AND p.bin = {AT} JOIN pieces q ON q.species = centre_species AND q.bin = {AT}),
rho AS (SELECT a.structure_id, a.atom_index, a.species, coalesce(sum(y), 0) AS rho FROM atoms a LEFT JOIN looked l ON l.structure_id = a.structure_id AND l.centre_id = a.atom_index GROUP BY ALL)"""


def rho_views(body: str) -> str:
    return with_views("species near", f", {RHO_SQL} {body}")


@query(rho_views("SELECT structure_id, atom_index, species, round(rho, 5) + 0.0 AS rho FROM rho"))
def embedding_density(spark, sf_dir):
    return densities(spark, sf_dir)[1].select("structure_id", "atom_index", "species", (F.round("rho", 5) + 0.0).alias("rho"))


@query(rho_views(""", b AS (SELECT species, least(0, min(rho)) AS lo, greatest(0, max(rho)) AS hi FROM rho GROUP BY species)
SELECT species, round(lo - 0.1 * (hi - lo), 5) + 0.0 AS lo, round(hi + 0.1 * (hi - lo), 5) + 0.0 AS hi FROM b"""))
def density_bounds(spark, sf_dir):
    return e.padded(e.density_bounds(densities(spark, sf_dir)[1])).select("species", *((F.round(c, 5) + 0.0).alias(c) for c in ("lo", "hi")))


@query(rho_views("SELECT structure_id, atom_index, round(rho / (SELECT max(abs(rho)) FROM rho), 6) + 0.0 AS rho FROM rho"))
def density_rescale(spark, sf_dir):
    return e.rescaled(densities(spark, sf_dir)[1]).select("structure_id", "atom_index", *r6("rho"))


@query(with_views("structures atoms species", "SELECT s.structure_id, round(s.energy / count(*) - sum(e_ref) / count(*), 9) + 0.0 AS formation FROM structures s JOIN atoms USING (structure_id) JOIN species_ref USING (species) GROUP BY s.structure_id, s.energy"))
def formation_energy(spark, sf_dir):
    sums = v.atoms(spark, sf_dir).join(F.broadcast(v.species(spark)), "species").groupBy("structure_id").agg(F.count("*").alias("n"), F.sum("e_ref").alias("ref"))
    return sums.join(v.structures(spark, sf_dir), "structure_id").select("structure_id", (F.col("energy") / F.col("n") - F.col("ref") / F.col("n")).alias("formation")).select("structure_id", (F.round("formation", 9) + 0.0).alias("formation"))


def x4(x: str, at: float, w: float, off: str) -> str:
    return f"CASE WHEN {off} THEN 0 ELSE pow(({x} - {at}) / {w}, 4) / (1 + pow(({x} - {at}) / {w}, 4)) END"


def x4s(x: str, at: float, w: float, off: str) -> str:
    return f"CASE WHEN {off} THEN 0 ELSE 4 * pow(({x} - {at}) / {w}, 3) / (pow(1 + pow(({x} - {at}) / {w}, 4), 2) * {w}) END"


EMB = f"{x4('rho', 0.0, 0.3, 'rho < 0')} * cos(n * pi() * rho / 12.0)"
EMB_SLOPE = f"({x4s('rho', 0.0, 0.3, 'rho < 0')} * cos(n * pi() * rho / 12.0) - n * pi() / 12.0 * {x4('rho', 0.0, 0.3, 'rho < 0')} * sin(n * pi() * rho / 12.0))"
PAIR = f"{x4('r', R_CUT, 0.3, f'r > {R_CUT}')} * cos(n * pi() * r / {R_CUT})"
PAIR_SLOPE = f"({x4s('r', R_CUT, 0.3, f'r > {R_CUT}')} * cos(n * pi() * r / {R_CUT}) - n * pi() / {R_CUT} * {x4('r', R_CUT, 0.3, f'r > {R_CUT}')} * sin(n * pi() * r / {R_CUT}))"
COLUMNS_SQL = "blocks(kind, key, start) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in BLOCKS) + "), weights AS (SELECT c AS col, ((c * 37 + 11) % 17 - 8) / 20::DOUBLE AS w FROM (SELECT unnest(range(27)) AS c))"
PAIR_KEY = "least(centre_species, neigh_species) || '-' || greatest(centre_species, neigh_species)"
DESIGN_SQL = f"""{COLUMNS_SQL}, terms AS (SELECT unnest(range({K})) AS n),
raw AS (SELECT structure_id, start + n AS col, sum({EMB}) AS value FROM rho JOIN blocks ON kind = 'emb' AND key = species, terms GROUP BY ALL
  UNION ALL SELECT structure_id, start + n, sum({PAIR}) / 2 FROM near JOIN blocks ON kind = 'pair' AND key = {PAIR_KEY}, terms GROUP BY ALL),
size AS (SELECT structure_id, count(*) AS n_atoms FROM atoms GROUP BY 1),
design AS (SELECT structure_id, CAST(col AS INTEGER) AS col, value / n_atoms AS value FROM raw JOIN size USING (structure_id))"""


def energy_design(spark, sf_dir, near=None):
    return e.energy_design(near if near is not None else near_tabulated(spark, sf_dir), v.atoms(spark, sf_dir), columns(spark), FORM)


@query(rho_views(f", {DESIGN_SQL} SELECT structure_id, col, round(value, 5) + 0.0 AS value FROM design"))
def eam_design(spark, sf_dir):
    """Energy rows of every structure, which any weights can be applied to."""
    return energy_design(spark, sf_dir).select("structure_id", "col", (F.round("value", 5) + 0.0).alias("value"))


@query(rho_views(f", {DESIGN_SQL} SELECT structure_id, round(sum(value * w), 5) + 0.0 AS energy FROM design JOIN weights USING (col) GROUP BY structure_id"))
def eam_energy(spark, sf_dir):
    return e.weighted(energy_design(spark, sf_dir), ["structure_id"], weights(spark), "energy").select("structure_id", (F.round("energy", 5) + 0.0).alias("energy"))


FORCE_BODY = f"""axes AS (SELECT structure_id, centre_id, centre_species, neigh_index, neigh_species, r, dy, dy_centre, unnest([0, 1, 2]) AS axis, unnest([ux, uy, uz]) AS u FROM looked),
own AS (SELECT structure_id, centre_id AS atom_index, axis, sum(dy * u) AS push FROM axes GROUP BY ALL),
fraw AS (SELECT structure_id, atom_index, axis, start + n AS col, push * {EMB_SLOPE} AS value FROM own JOIN rho USING (structure_id, atom_index) JOIN blocks ON kind = 'emb' AND key = species, terms
 UNION ALL SELECT structure_id, atom_index, axis, start + n, sum(value) FROM (SELECT x.structure_id, x.centre_id AS atom_index, axis, start, n, dy_centre * u * {EMB_SLOPE} AS value FROM axes x JOIN rho r2 ON r2.structure_id = x.structure_id AND r2.atom_index = x.neigh_index JOIN blocks ON kind = 'emb' AND key = neigh_species, terms) GROUP BY ALL
 UNION ALL SELECT structure_id, centre_id, axis, start + n, sum(u * {PAIR_SLOPE}) FROM axes JOIN blocks ON kind = 'pair' AND key = {PAIR_KEY}, terms GROUP BY ALL),
force AS (SELECT structure_id, atom_index, axis, CAST(col AS INTEGER) AS col, sum(value) AS value FROM fraw GROUP BY ALL)"""
FORCE_SQL = f"{COLUMNS_SQL}, terms AS (SELECT unnest(range({K})) AS n), {FORCE_BODY}"


def force_design(spark, sf_dir):
    return e.force_design(near_dense(spark, sf_dir), columns(spark), FORM)


@query(rho_views(f", {FORCE_SQL} SELECT structure_id, atom_index, axis, round(sum(value * w), 4) + 0.0 AS f FROM force JOIN weights USING (col) GROUP BY ALL"))
def eam_forces(spark, sf_dir):
    f = e.forces(near_dense(spark, sf_dir), columns(spark), FORM, WEIGHTS)
    return f.select("structure_id", "atom_index", "axis", (F.round("f", 4) + 0.0).alias("f"))


def function_tables(spark, values=WEIGHTS):
    """Energy functions of the weights on uniform grids: F_s(rho) and phi_p(r), with their slopes."""
    w = columns(spark).withColumn("w", F.array(*(F.lit(float(x)) for x in values)))
    w = w.select("kind", "key", *(F.element_at("w", F.col("start") + n + 1).alias(f"w{n}") for n in range(K)))
    rho = tb.tabulate(w.where("kind = 'emb'"), 400, 0.05, F.lit(0.0))
    rho = rho.withColumn("rho", F.col("x")).withColumn("y", sum((F.col(f"w{n}") * FORM.emb(n) for n in range(K)), F.lit(0.0)))
    pair = tb.tabulate(w.where("kind = 'pair'"), BINS, STEP, F.lit(0.0)).withColumn("r", F.col("x"))
    pair = pair.withColumn("y", sum((F.col(f"w{n}") * FORM.pair(n) for n in range(K)), F.lit(0.0)))
    return rho.select("kind", "key", "bin", "x", "y"), pair.select("kind", "key", "bin", "x", "y")


def table_sql(kind: str, count: int, step: float, expr: str, var: str) -> str:
    total = " + ".join(f"w{n}.w * ({expr.replace('n * pi()', f'{n} * pi()')})" for n in range(K))
    joins = " ".join(f"JOIN weights w{n} ON w{n}.col = start + {n}" for n in range(K))
    return f"SELECT kind, key, CAST(b AS INTEGER) AS bin, b * {step} AS x, {total} AS y FROM (SELECT kind, key, start, b, b * {step} AS {var} FROM blocks, (SELECT unnest(range({count})) AS b) WHERE kind = '{kind}') {joins}"


TABLES_SQL = f"{COLUMNS_SQL}, tabs AS ({table_sql('emb', 400, 0.05, EMB, 'rho')} UNION ALL {table_sql('pair', BINS, STEP, PAIR, 'r')}), tpieces AS (SELECT x.kind, x.key, x.bin, x.x, x.y, (y.y - x.y) / (y.x - x.x) AS slope FROM tabs x JOIN tabs y ON x.kind = y.kind AND x.key = y.key AND y.bin = x.bin + 1)"


def _pieces(table):
    return tb.linear_pieces(table, ["key"]).select("key", "bin", "x", "y", "slope")


RHO_AT = "least(greatest(CAST(floor(rho / 0.05) AS INTEGER), 0), 398)"


@query(rho_views(f""", {TABLES_SQL}, parts AS (SELECT structure_id, p.y + p.slope * (rho - p.x) AS y FROM rho JOIN tpieces p ON p.kind = 'emb' AND p.key = species AND p.bin = {RHO_AT}
UNION ALL SELECT structure_id, (p.y + p.slope * (r - p.x)) / 2 FROM near JOIN tpieces p ON p.kind = 'pair' AND p.key = {PAIR_KEY} AND p.bin = {AT}), size AS (SELECT structure_id, count(*) AS n_atoms FROM atoms GROUP BY 1)
SELECT structure_id, round(sum(y) / any_value(n_atoms), 5) + 0.0 AS energy FROM parts JOIN size USING (structure_id) GROUP BY structure_id"""))
def eam_energy_tables(spark, sf_dir):
    """Energies of a finished potential, from its tables."""
    emb, pair = function_tables(spark)
    near = near_tabulated(spark, sf_dir).select("structure_id", F.col("centre_id").alias("atom_index"), "centre_species", "neigh_species", "r", F.col("y").alias("d"))
    two = tb.lookup(near, _pieces(pair), e.pair_key(), F.col("r"), STEP, BINS).select("structure_id", "atom_index", F.col("centre_species").alias("species"), "d", (F.col("y") / 2).alias("p"))
    every = two.unionByName(v.atoms(spark, sf_dir).select("structure_id", "atom_index", "species", F.lit(0.0).alias("d"), F.lit(0.0).alias("p")))
    rho = every.groupBy("structure_id", "atom_index", "species").agg(F.sum("d").alias("rho"), F.sum("p").alias("p"))
    one = tb.lookup(rho, _pieces(emb), F.col("species"), F.col("rho"), 0.05, 400)
    return one.groupBy("structure_id").agg((F.round(F.sum(F.col("y") + F.col("p")) / F.count("*"), 5) + 0.0).alias("energy"))


@query(rho_views(f""", {TABLES_SQL}, fp AS (SELECT structure_id, atom_index, p.slope AS ds FROM rho JOIN tpieces p ON p.kind = 'emb' AND p.key = species AND p.bin = {RHO_AT}),
axes AS (SELECT l.structure_id, centre_id AS atom_index, unnest([0, 1, 2]) AS axis, unnest([ux, uy, uz]) AS u, a.ds * dy + b.ds * dy_centre + p.slope AS pull FROM looked l JOIN fp a ON a.structure_id = l.structure_id AND a.atom_index = l.centre_id
JOIN fp b ON b.structure_id = l.structure_id AND b.atom_index = l.neigh_index JOIN tpieces p ON p.kind = 'pair' AND p.key = {PAIR_KEY} AND p.bin = {AT})
SELECT structure_id, atom_index, axis, round(sum(u * pull), 4) + 0.0 AS f FROM axes GROUP BY ALL"""))
def eam_forces_tables(spark, sf_dir):
    emb, pair = function_tables(spark)
    near = near_dense(spark, sf_dir)
    near = near.select(*KEY, "centre_species", "neigh_index", "neigh_species", "r", "ux", "uy", "uz", "rho", F.col("dy").alias("df"))
    both = tb.lookup(near, _pieces(emb), F.col("centre_species"), F.col("rho"), 0.05, 400, "_emb")
    both = tb.lookup(both, _pieces(pair), e.pair_key(), F.col("r"), STEP, BINS)
    push = F.col("dy_emb") * F.col("df")
    sides = [F.struct(F.col(atom).alias("atom_index"), *((f * F.col(f"u{x}")).alias(x) for x in e.AXES)) for atom, f in (("centre_id", push + F.col("dy")), ("neigh_index", -push))]
    f = e.by_axis(both.select("structure_id", F.inline(F.array(*sides))))
    return f.select("structure_id", "atom_index", "axis", (F.round("f", 4) + 0.0).alias("f"))


def energy_moments(spark, sf_dir, near=None) -> rg.Moments:
    phi = e.dense(energy_design(spark, sf_dir, near), ["structure_id"], N_COLUMNS)
    target = formation_energy(spark, sf_dir)
    return rg.Moments.of(rg.gram_rows(phi.join(target, "structure_id").select("phi", F.col("formation").alias("t"))))


def force_moments(spark, sf_dir, thirds: bool = False) -> rg.Moments:
    """Of the forces of all atoms on three axes, each with weight 1 / N_s for its structure's atoms; rows without neighbours are zeros."""
    return rg.Moments.of(e.force_gram(near_dense(spark, sf_dir), v.atoms(spark, sf_dir), FORM, BLOCKS, thirds))


def both_moments(spark, sf_dir, thirds: bool = False) -> tuple[rg.Moments, rg.Moments]:
    """Of energies and forces; each pass finds the neighbours, as a stored table of pairs is many times the atoms."""
    return energy_moments(spark, sf_dir), force_moments(spark, sf_dir, thirds)


ERR_SQL = rho_views(f""", {DESIGN_SQL}, target AS (SELECT s.structure_id, round(s.energy / count(*) - sum(e_ref) / count(*), 9) + 0.0 AS t FROM structures s JOIN atoms USING (structure_id) JOIN species_ref USING (species) GROUP BY s.structure_id, s.energy),
pred AS (SELECT structure_id, sum(value * w) AS y FROM design JOIN weights USING (col) GROUP BY structure_id)
""")


#: Target and predicted forces of every atom and axis, and the weight of their squares.
PUSH_SQL = f""", {FORCE_BODY}, fpred AS (SELECT structure_id, atom_index, axis, sum(value * w) AS y FROM force JOIN weights USING (col) GROUP BY ALL),
fsize AS (SELECT structure_id, count(*) AS n FROM atoms GROUP BY 1), faxes AS (SELECT structure_id, atom_index, unnest([0, 1, 2]) AS axis, unnest([fx, fy, fz]) AS t FROM atoms),
push AS (SELECT x.structure_id, x.atom_index, x.axis, x.t, coalesce(p.y, 0) AS y, n FROM faxes x JOIN fsize USING (structure_id) LEFT JOIN fpred p ON p.structure_id = x.structure_id AND p.atom_index = x.atom_index AND p.axis = x.axis)
"""


@query(ERR_SQL + PUSH_SQL + """, d AS (SELECT structure_id, atom_index, sqrt(sum((t - y) ** 2)) AS d FROM push GROUP BY ALL), fd AS (SELECT sum(m) / 3 AS f FROM (SELECT avg(d) AS m FROM d GROUP BY structure_id)), en AS (SELECT sqrt(sum((t - y) ** 2)) AS e FROM target JOIN pred USING (structure_id))
SELECT round(e, 3) + 0.0 AS error, round(f, 1) + 0.0 AS force_error, round(e + f, 1) + 0.0 AS total FROM en, fd""")
def eam_errors(spark, sf_dir):
    """Distances of predicted energies and forces from their targets over all structures: two searches of one exchange of the atoms."""
    atoms, cells, table = v.atoms(spark, sf_dir, whole=True), v.dealt_cells(spark, sf_dir), radial(spark)
    places = atoms.drop("fx", "fy", "fz")
    near = lambda centres: tb.lookup(nb.neighbours(centres, places, cells, R_CUT, None), table, F.col("neigh_species"), F.col("r"), STEP, BINS)
    centres = e.embedded_centres(near(e.placed_centres(places)), columns(spark), FORM, WEIGHTS)
    errors = e.structure_errors(e.atom_sums(near(centres), columns(spark), FORM, WEIGHTS), atoms, v.species(spark))
    target = F.round(F.col("energy") / F.col("n") - F.col("e_ref") / F.col("n"), 9) + 0.0
    d = e.distances(errors, v.dealt_energies(spark, sf_dir), target)
    return d.select((F.round("error", 3) + 0.0).alias("error"), (F.round("force_error", 1) + 0.0).alias("force_error"), (F.round("total", 1) + 0.0).alias("total"))


@query(ERR_SQL + PUSH_SQL + f"SELECT round(-0.5 * {ALPHA} * (SELECT sum(w * w) FROM weights) - 0.5 * {BETA_E} * sum((t - y) ** 2) - 0.5 * {BETA_F} * (SELECT sum((t - y) ** 2 / n) FROM push) + 0.5 * (count(*) + 27) * ln(2 * pi()) + 0.5 * 27 * ln({ALPHA}) + count(*) * (ln({BETA_E}) + ln({BETA_F})), 1) + 0.0 AS log_joint FROM target JOIN pred USING (structure_id)")
def eam_log_joint(spark, sf_dir):
    m, n = both_moments(spark, sf_dir)
    value = e.log_joint(np.array(WEIGHTS), np.full(N_COLUMNS, ALPHA), BETA_E, BETA_F, m, n, m.n)
    return spark.createDataFrame([(round(value, 1) + 0.0,)], "log_joint double")


def candidates(spark, sf_dir, names):
    part = v.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("cand_id"), *((((F.col("p_partkey") * (7 + 2 * c) + 3 * c) % 19 - 9) / 30.0).alias(n) for c, n in enumerate(names)))


@query(ERR_SQL + """, dt AS (SELECT structure_id, col, value, t FROM design JOIN target USING (structure_id)),
g AS (SELECT x.col AS i, y.col AS j, sum(x.value * y.value) AS g FROM design x JOIN design y USING (structure_id) GROUP BY ALL), b AS (SELECT col AS i, sum(value * t) AS b FROM dt GROUP BY col),
pop AS (SELECT p_partkey AS cand_id, c AS i, ((p_partkey * (7 + 2 * c) + 3 * c) % 19 - 9) / 30::DOUBLE AS w FROM part, (SELECT unnest(range(27)) AS c)),
lin AS (SELECT cand_id, sum(w * b) AS l FROM pop JOIN b USING (i) GROUP BY cand_id), quad AS (SELECT x.cand_id, sum(x.w * y.w * g) AS q FROM pop x JOIN g ON g.i = x.i JOIN pop y ON y.cand_id = x.cand_id AND y.i = g.j GROUP BY x.cand_id)
SELECT cand_id, round((SELECT sum(t * t) FROM target) - 2 * l + q, 3) + 0.0 AS sse FROM lin JOIN quad USING (cand_id)""")
def score_candidates(spark, sf_dir):
    """Every candidate's squared error against all structures, from one set of moments."""
    names = [f"w{c}" for c in range(N_COLUMNS)]
    return e.score(candidates(spark, sf_dir, names), names, energy_moments(spark, sf_dir)).select("cand_id", (F.round("sse", 3) + 0.0).alias("sse"))


@query("SELECT p_type AS kind, p_partkey AS cand_id, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS place FROM part QUALIFY place <= 5")
def top_candidates(spark, sf_dir):
    w = Window.partitionBy("p_type").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return v.table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("cand_id"), F.row_number().over(w).cast("long").alias("place")).where("place <= 5")


@query(ERR_SQL + PUSH_SQL + f"SELECT round(-0.5 * {ALPHA} * (SELECT sum(w * w) FROM weights) - 0.5 * {BETA_E} * sum((t - y) ** 2) - 0.5 * {BETA_F} * (SELECT sum((t - y) ** 2) / 3 FROM push) + 0.5 * count(*) * (ln({BETA_E}) + ln({BETA_F})) + 0.5 * 27 * ln({ALPHA}) - 0.5 * (count(*) + 27) * ln(2 * pi()), 1) + 0.0 AS log_joint FROM target JOIN pred USING (structure_id)")
def eam_log_joint_thirds(spark, sf_dir):
    """The form whose force term is a third of the sum over atoms."""
    m, n = both_moments(spark, sf_dir, True)
    value = e.log_joint_thirds(np.array(WEIGHTS), np.full(N_COLUMNS, ALPHA), BETA_E, BETA_F, m, n, m.n)
    return spark.createDataFrame([(round(value, 1) + 0.0,)], "log_joint double")


GRAM_SQL = ERR_SQL + f""", {FORCE_BODY}, ge AS (SELECT x.col AS i, y.col AS j, sum(x.value * y.value) AS g FROM design x JOIN design y USING (structure_id) GROUP BY ALL),
be AS (SELECT col AS i, sum(value * t) AS b FROM design JOIN target USING (structure_id) GROUP BY col), fsize AS (SELECT structure_id, count(*) AS n FROM atoms GROUP BY 1),
gf AS (SELECT x.col AS i, y.col AS j, sum(x.value * y.value / n) AS g FROM force x JOIN force y ON x.structure_id = y.structure_id AND x.atom_index = y.atom_index AND x.axis = y.axis JOIN fsize ON fsize.structure_id = x.structure_id GROUP BY ALL),
bf AS (SELECT col AS i, sum(value * CASE axis WHEN 0 THEN fx WHEN 1 THEN fy ELSE fz END / n) AS b FROM force JOIN atoms USING (structure_id, atom_index) JOIN fsize USING (structure_id) GROUP BY col),
cols AS (SELECT unnest(range({N_COLUMNS})) AS i),
a AS (SELECT x.i, y.i AS j, {BETA_E} * coalesce(ge.g, 0) + {BETA_F} * coalesce(gf.g, 0) + CASE WHEN x.i = y.i THEN {ALPHA} ELSE 0 END AS v FROM cols x, cols y LEFT JOIN ge ON ge.i = x.i AND ge.j = y.i LEFT JOIN gf ON gf.i = x.i AND gf.j = y.i),
b AS (SELECT i, {BETA_E} * coalesce(be.b, 0) + {BETA_F} * coalesce(bf.b, 0) AS v FROM cols LEFT JOIN be USING (i) LEFT JOIN bf USING (i))
"""


def _weights(spark, w, columns=None):
    return spark.createDataFrame([(c, round(float(w[c]), 5) + 0.0) for c in (columns or range(len(w)))], "col int, w double")


def map_weights(spark, sf_dir, held=None):
    """Weights that maximise the log-joint of energies and forces, with some columns held."""
    return e.map_weights(np.full(N_COLUMNS, ALPHA), BETA_E, BETA_F, *both_moments(spark, sf_dir), held)


FIT_SQL = (GRAM_SQL + solution_sql("fit", "a", "b")).replace("WITH ", "WITH RECURSIVE ", 1)


@query(FIT_SQL + "SELECT CAST(i AS INTEGER) AS col, round(w, 5) + 0.0 AS w FROM fit")
def eam_map_fit(spark, sf_dir):
    """Weights that maximise the log-joint."""
    return _weights(spark, map_weights(spark, sf_dir))


POPULATION = "pop AS (SELECT p_partkey AS cand_id, c AS i, ((p_partkey * (7 + 2 * c) + 3 * c) % 19 - 9) / 30::DOUBLE AS w FROM part, (SELECT unnest(range(27)) AS c))"


@query(GRAM_SQL + f""", {POPULATION}, tt AS (SELECT {BETA_E} * (SELECT sum(t * t) FROM target) + {BETA_F} * (SELECT sum((fx * fx + fy * fy + fz * fz) / n) FROM atoms JOIN fsize USING (structure_id)) AS v),
lin AS (SELECT cand_id, sum(w * v) AS l FROM pop JOIN b USING (i) GROUP BY cand_id), quad AS (SELECT x.cand_id, sum(x.w * y.w * v) AS q FROM pop x JOIN a ON a.i = x.i JOIN pop y ON y.cand_id = x.cand_id AND y.i = a.j GROUP BY x.cand_id),
m AS (SELECT cand_id, (SELECT v FROM tt) - 2 * l + q AS x FROM lin JOIN quad USING (cand_id)) SELECT cand_id, CAST(floor(log10(x)) AS INTEGER) AS exponent, round(x / pow(10, floor(log10(x))), 5) + 0.0 AS mantissa FROM m""")
def score_candidates_joint(spark, sf_dir):
    """Candidates by the weighted squared errors of energies and forces and the prior together, in decimal floating point."""
    names = [f"w{c}" for c in range(N_COLUMNS)]
    measure = lambda energy, force, penalty: BETA_E * energy + BETA_F * force + ALPHA * penalty
    made = e.score(candidates(spark, sf_dir, names), names, *both_moments(spark, sf_dir), measure, "x").withColumn("exponent", F.floor(F.log10("x")).cast("int"))
    return made.select("cand_id", "exponent", (F.round(F.col("x") / F.pow(F.lit(10.0), F.col("exponent")), 5) + 0.0).alias("mantissa"))


@query(rho_views(f""", {DESIGN_SQL}, k AS (SELECT structure_id, count(DISTINCT species) AS k, min(species) AS one FROM atoms GROUP BY structure_id), g AS (SELECT structure_id, one AS grp FROM k WHERE k = 1 UNION ALL SELECT structure_id, 'ALL' FROM k),
f AS (SELECT structure_id, s.energy / count(*) - sum(e_ref) / count(*) AS t FROM structures s JOIN atoms USING (structure_id) JOIN species_ref USING (species) GROUP BY s.structure_id, s.energy),
like_ AS (SELECT start + n AS col FROM blocks, terms WHERE kind = 'pair' AND key[1] = key[3])
SELECT grp, col, count(*) AS n, round(sum(value), 4) + 0.0 AS total, round(sum(value * t), 4) + 0.0 AS target FROM design JOIN g USING (structure_id) JOIN f USING (structure_id) WHERE NOT (grp = 'ALL' AND col IN (SELECT col FROM like_)) GROUP BY grp, col"""))
def eam_setup(spark, sf_dir):
    """The data set of each group of elements from one composed set-up: rows, sums and products with the target by free column."""
    made = e.prepare(v.structures(spark, sf_dir), v.atoms(spark, sf_dir), v.cells(spark, sf_dir), radial(spark), lambda near, t: tb.lookup(near, t, F.col("neigh_species"), F.col("r"), STEP, BINS), v.species(spark).select("species", "e_ref"), columns(spark), FORM, R_CUT)
    rows = e.group_rows(made.design, made.groups, columns(spark), K).join(made.target, "structure_id")
    return rows.groupBy("grp", "col").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"), (F.round(F.sum(F.col("value") * F.col("t")), 4) + 0.0).alias("target"))


SERIES = e.DampedSeries({s: [0.3 - 0.1 * n, -0.2 + 0.05 * n, 0.1] for n, s in enumerate("ANR")}, {key: [0.2 - 0.05 * n, 0.1 + 0.02 * n, -0.08] for n, (kind, key, _) in enumerate(b for b in BLOCKS if b[0] == "pair")}, R_CUT)


def _series_sql() -> str:
    values = lambda made: ", ".join(f"('{key}', {k}, {w!r}::DOUBLE)" for key, ws in made.items() for k, w in enumerate(ws))
    return f"""wemb(key, turn, w) AS (VALUES {values(SERIES.emb)}), wpair(key, turn, w) AS (VALUES {values(SERIES.pair)})"""


_DAMPED = "(pow(10 * ({x}), 4) / (1 + pow(10 * ({x}), 4)))"
_DAMPED_SLOPE = "(40 * pow(10 * ({x}), 3) / pow(1 + pow(10 * ({x}), 4), 2))"
_AT = f"r - {R_CUT}"
OLD_ENERGY_SQL = f"""{_series_sql()}, demb AS (SELECT structure_id, atom_index, sum(w * cos(turn * rho)) * {_DAMPED.format(x="max(rho)")} AS embedding FROM rho JOIN wemb ON key = species GROUP BY ALL),
dpair AS (SELECT structure_id, centre_id AS atom_index, sum(w * cos(turn * r) * {_DAMPED.format(x=_AT)}) / 2 AS pair FROM near JOIN wpair ON key = {PAIR_KEY} GROUP BY ALL),
olden AS (SELECT structure_id, atom_index, embedding, coalesce(pair, 0) AS pair FROM demb LEFT JOIN dpair USING (structure_id, atom_index))"""


@query(rho_views(f", {OLD_ENERGY_SQL} SELECT structure_id, atom_index, round(embedding, 5) + 0.0 AS embedding, round(pair, 5) + 0.0 AS pair, round(embedding + pair, 5) + 0.0 AS energy FROM olden"))
def legacy_atom_energy(spark, sf_dir):
    made = e.legacy_atom_energies(near_tabulated(spark, sf_dir), v.atoms(spark, sf_dir), SERIES)
    return made.select("structure_id", "atom_index", *((F.round(c, 5) + 0.0).alias(c) for c in ("embedding", "pair", "energy")))


@query(rho_views(f", {OLD_ENERGY_SQL} SELECT structure_id, count(*) AS n_atoms, round(avg(embedding), 5) + 0.0 AS embedding, round(avg(pair), 5) + 0.0 AS pair, round(avg(embedding + pair), 5) + 0.0 AS energy FROM olden GROUP BY structure_id"))
def legacy_structure_energy(spark, sf_dir):
    made = e.legacy_structure_energies(near_tabulated(spark, sf_dir), v.atoms(spark, sf_dir), SERIES)
    return made.select("structure_id", "n_atoms", *((F.round(c, 5) + 0.0).alias(c) for c in ("embedding", "pair", "energy")))


@query(rho_views(f""", {_series_sql()}, slopes AS (SELECT structure_id, atom_index, sum(w * cos(turn * rho)) * {_DAMPED_SLOPE.format(x="max(rho)")} - sum(w * turn * sin(turn * rho)) * {_DAMPED.format(x="max(rho)")} AS s FROM rho JOIN wemb ON key = species GROUP BY ALL),
bonds AS (SELECT row_number() OVER () AS bond, l.*, {PAIR_KEY} AS key FROM looked l),
bent AS (SELECT bond, sum(w * cos(turn * r)) * {_DAMPED_SLOPE.format(x="max(" + _AT + ")")} - sum(w * turn * sin(turn * r)) * {_DAMPED.format(x="max(" + _AT + ")")} AS p FROM bonds JOIN wpair USING (key) GROUP BY bond),
pushed AS (SELECT b.structure_id, b.centre_id, unnest([0, 1, 2]) AS axis, unnest([ux, uy, uz]) * (dy * c.s + dy_centre * n.s + p) AS f FROM bonds b JOIN bent USING (bond) JOIN slopes c ON c.structure_id = b.structure_id AND c.atom_index = b.centre_id JOIN slopes n ON n.structure_id = b.structure_id AND n.atom_index = b.neigh_index)
SELECT structure_id, centre_id AS atom_index, CAST(axis AS INTEGER) AS axis, round(sum(f), 4) + 0.0 AS f FROM pushed GROUP BY ALL"""))
def legacy_forces(spark, sf_dir):
    """Forces in the older form of damped series; a pair counts once at each of its ends."""
    return e.legacy_forces(near_dense(spark, sf_dir), SERIES).select("structure_id", "atom_index", "axis", (F.round("f", 4) + 0.0).alias("f"))


PAIR_K = [0.3, -0.2, 0.1]
_DAMP = f"pow(10 * (r - {R_CUT}), 4) / (1 + pow(10 * (r - {R_CUT}), 4))"


@query(with_views("near", f"SELECT structure_id, centre_id, round(sum(({' + '.join(f'({w}) * cos({k} * r)' for k, w in enumerate(PAIR_K))}) * {_DAMP}), 5) + 0.0 AS energy FROM near GROUP BY ALL"))
def pair_energy_fourier(spark, sf_dir):
    one = e.damped_fourier(F.col("r"), [F.lit(w) for w in PAIR_K], R_CUT)
    return near_atoms(spark, sf_dir).groupBy(*KEY).agg((F.round(F.sum(one), 5) + 0.0).alias("energy"))


TRIPLE = f"0.05 * cos(pi() * r0 / {R_ANI}) * cos(pi() * r1 / {R_ANI}) * cos(theta)"


@query(with_views("species triplets", f", {RHO_SQL}, t AS (SELECT structure_id, centre_id AS atom_index, sum({TRIPLE}) AS y FROM triplets GROUP BY ALL) SELECT r.structure_id, r.atom_index, round(rho + coalesce(t.y, 0), 5) + 0.0 AS rho FROM rho r LEFT JOIN t USING (structure_id, atom_index)"))
def legacy_triplet_density(spark, sf_dir):
    """Densities with the term of triplets."""
    near = near_tabulated(spark, sf_dir)
    three = 0.05 * F.cos(PI * F.col("r0") / R_ANI) * F.cos(PI * F.col("r1") / R_ANI) * F.cos("theta")
    rho = e.legacy_densities(near, v.atoms(spark, sf_dir), nb.triplets(near, KEY, R_ANI), three)
    return rho.select("structure_id", "atom_index", (F.round("rho", 5) + 0.0).alias("rho"))


_TABS = " UNION ALL ".join((table_sql("emb", 400, 0.05, EMB, "rho"), table_sql("pair", BINS, STEP, PAIR, "r"))).replace("JOIN weights ", "JOIN fitted ")


@query(FIT_SQL + f", fitted AS (SELECT i AS col, w FROM fit), tabs AS ({_TABS}) SELECT kind, key, bin, round(y, 4) + 0.0 AS y FROM tabs")
def potential_table(spark, sf_dir):
    """The tables that a potential file holds, from the weights that fit the given structures."""
    emb, pair = function_tables(spark, map_weights(spark, sf_dir))
    return emb.unionByName(pair).select("kind", "key", "bin", (F.round("y", 4) + 0.0).alias("y"))


HELD = {c: WEIGHTS[c] for kind, key, start in BLOCKS if kind == "pair" and key[0] == key[-1] for c in range(start, start + K)}
FREE = [c for c in range(N_COLUMNS) if c not in HELD]
_free, _held = ", ".join(map(str, FREE)), ", ".join(map(str, HELD))


@query((GRAM_SQL + f", af AS (SELECT * FROM a WHERE i IN ({_free}) AND j IN ({_free})), bfree AS (SELECT b.i, b.v - coalesce((SELECT sum(a.v * w) FROM a JOIN weights ON col = j WHERE a.i = b.i AND j IN ({_held})), 0) AS v FROM b WHERE b.i IN ({_free}))"
    + solution_sql("fit", "af", "bfree") + "SELECT CAST(i AS INTEGER) AS col, round(w, 5) + 0.0 AS w FROM fit").replace("WITH ", "WITH RECURSIVE ", 1))
def eam_frozen_fit(spark, sf_dir):
    """Like-pair weights are held, embedding and unlike pairs are fitted: the free weights."""
    return _weights(spark, map_weights(spark, sf_dir, HELD), FREE)


def _chained_sql() -> str:
    """Pure-element solves, their like-pair weights in the solve of all structures, and all weights together."""
    def matrix(name: str, grp: str, cols: list[int]) -> str:
        own = ", ".join(map(str, cols))
        return f""", a{name} AS (SELECT x.i, y.i AS j, {BETA_E} * coalesce(g.g, 0) + CASE WHEN x.i = y.i THEN {ALPHA} ELSE 0 END AS v FROM cols x, cols y LEFT JOIN gg g ON g.grp = '{grp}' AND g.i = x.i AND g.j = y.i WHERE x.i IN ({own}) AND y.i IN ({own})),
b{name} AS (SELECT cols.i, {BETA_E} * coalesce(gb.b, 0) AS v FROM cols LEFT JOIN gb ON gb.grp = '{grp}' AND gb.i = cols.i WHERE cols.i IN ({own}))"""

    start = {(kind, key): at for kind, key, at in BLOCKS}
    span = lambda at: list(range(at, at + K))
    body, pure = "", []
    for s in "ANR":
        like = span(start["pair", f"{s}-{s}"])
        body += matrix(s, s, span(start["emb", s]) + like) + solution_sql(f"fit{s}", f"a{s}", f"b{s}")
        pure.append(f"SELECT i AS col, w, '{s}' AS source FROM fit{s} WHERE i IN ({', '.join(map(str, like))})")
    body += f", pure AS ({' UNION ALL '.join(pure)})" + matrix("every", "ALL", list(range(N_COLUMNS)))
    body += f", af AS (SELECT * FROM aevery WHERE i IN ({_free}) AND j IN ({_free})), bf AS (SELECT b.i, b.v - coalesce((SELECT sum(a.v * w) FROM aevery a JOIN pure ON col = j WHERE a.i = b.i), 0) AS v FROM bevery b WHERE b.i IN ({_free}))"
    groups = f""", k AS (SELECT structure_id, count(DISTINCT species) AS k, min(species) AS one FROM atoms GROUP BY structure_id), grp AS (SELECT structure_id, one AS grp FROM k WHERE k = 1 UNION ALL SELECT structure_id, 'ALL' FROM k), cols AS (SELECT unnest(range({N_COLUMNS})) AS i),
gg AS (SELECT grp, x.col AS i, y.col AS j, sum(x.value * y.value) AS g FROM design x JOIN design y USING (structure_id) JOIN grp USING (structure_id) GROUP BY ALL), gb AS (SELECT grp, col AS i, sum(value * t) AS b FROM design JOIN target USING (structure_id) JOIN grp USING (structure_id) GROUP BY ALL)"""
    last = solution_sql("fit", "af", "bf") + "SELECT CAST(col AS INTEGER) AS col, round(w, 5) + 0.0 AS w, source FROM pure UNION ALL SELECT CAST(i AS INTEGER), round(w, 5) + 0.0, 'ALL' FROM fit"
    return (ERR_SQL + groups + body + last).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_chained_sql())
def eam_group_fit(spark, sf_dir):
    """Fits by groups of elements from one pass over the data, chained to one weight vector."""
    atoms = v.atoms(spark, sf_dir)
    target = formation_energy(spark, sf_dir).withColumnRenamed("formation", "t")
    moments = e.group_moments(energy_design(spark, sf_dir), target, e.element_groups(atoms), N_COLUMNS)
    fit = e.chained_fit(moments, BLOCKS, K, np.full(N_COLUMNS, ALPHA), BETA_E)
    return spark.createDataFrame([(r["col"], round(r["w"], 5) + 0.0, r["source"]) for r in fit], "col int, w double, source string")


@query()
def eam_hyper_update(spark, sf_dir):
    """Noise and prior that maximise the log-joint at the fitted weights, over alternating rounds."""
    m, n = both_moments(spark, sf_dir)
    rows = [(r["run"], k, float(r["w"][k]), float(r["beta_e"]), float(r["mse"])) for r in e.alternating_fit(m, n, keep=2) for k in range(N_COLUMNS)]
    return spark.createDataFrame(rows, "run int, col int, w double, beta_e double, mse double")


LJ = "4 * sqrt(a.eps * b.eps) * (pow((a.sigma + b.sigma) / 2 / {r}, 12) - pow((a.sigma + b.sigma) / 2 / {r}, 6))"
NEAR_LJ = "SELECT {cols} FROM near JOIN species_ref a ON a.species = centre_species JOIN species_ref b ON b.species = neigh_species"


def near_lj(spark, sf_dir):
    ref = v.species(spark)
    near = near_atoms(spark, sf_dir)
    for side, p in (("centre_species", "a"), ("neigh_species", "b")):
        near = near.join(F.broadcast(ref.select(F.col("species").alias(side), F.col("sigma").alias(f"sigma_{p}"), F.col("eps").alias(f"eps_{p}"))), side)
    return near.withColumn("sigma", (F.col("sigma_a") + F.col("sigma_b")) / 2).withColumn("eps", F.sqrt(F.col("eps_a") * F.col("eps_b")))


@query(with_views("species near", f", e AS ({NEAR_LJ.format(cols=f"structure_id, centre_id, sum({LJ.format(r='r')}) / 2 AS e")} GROUP BY structure_id, centre_id), p AS (SELECT *, CAST(floor(log10(abs(e))) AS INTEGER) AS exponent FROM e) SELECT structure_id, centre_id, exponent, round(e / pow(10, exponent), 6) + 0.0 AS mantissa FROM p"))
def pair_energy_lj(spark, sf_dir):
    """Energies of all pairs, in decimal floating point: those of near pairs are many powers of ten larger than others."""
    near = near_lj(spark, sf_dir)
    sums = near.groupBy(*KEY).agg((F.sum(e.lennard_jones(F.col("r"), F.col("sigma"), F.col("eps"))) / 2).alias("e"))
    sums = sums.withColumn("exponent", F.floor(F.log10(F.abs("e"))).cast("int"))
    return sums.select(*KEY, "exponent", (F.round(F.col("e") / F.pow(F.lit(10.0), F.col("exponent")), 6) + 0.0).alias("mantissa"))


DUFF = [(0.31, 2.1), (-0.17, 2.6), (0.05, 2.9)]
DUFF_SQL = " + ".join(f"CASE WHEN r < {s} THEN {b} * pow({s} - r, 3) ELSE 0 END" for b, s in DUFF)


@query(with_views("near", f"SELECT structure_id, centre_id, round(sum({DUFF_SQL}) / 2, 5) + 0.0 AS energy FROM near GROUP BY ALL"))
def pair_energy_duff(spark, sf_dir):
    return near_atoms(spark, sf_dir).groupBy(*KEY).agg((F.round(F.sum(e.duff(F.col("r"), DUFF)) / 2, 5) + 0.0).alias("energy"))


@query(rho_views("SELECT structure_id, round(sum(CASE WHEN rho > 0 THEN pow(10 * rho, 4) / (1 + pow(10 * rho, 4)) * (sqrt(rho) * 0.3 - 0.02 * rho * rho + 0.001 * rho * rho * rho + 0.1 * cos(0.7 * rho)) ELSE 0 END), 4) + 0.0 AS energy FROM rho GROUP BY structure_id"))
def legacy_embedding_energy(spark, sf_dir):
    rho = F.col("rho")
    one = damping(rho) * (F.sqrt(rho) * 0.3 - 0.02 * rho * rho + 0.001 * rho * rho * rho + 0.1 * F.cos(0.7 * rho))
    return densities(spark, sf_dir)[1].groupBy("structure_id").agg((F.round(F.sum(F.when(rho > 0, one).otherwise(0.0)), 4) + 0.0).alias("energy"))


DELTA = 0.001
MOVED = "sqrt(pow(r * ux - CASE WHEN axis = 0 THEN s ELSE 0 END, 2) + pow(r * uy - CASE WHEN axis = 1 THEN s ELSE 0 END, 2) + pow(r * uz - CASE WHEN axis = 2 THEN s ELSE 0 END, 2))"


@query(with_views("near", f""", m AS (SELECT structure_id, centre_id, axis, s, {MOVED} AS r FROM near, (SELECT unnest(range(3)) AS axis), (VALUES ({DELTA}), (-{DELTA})) d(s) WHERE neigh_index <> centre_id)
SELECT structure_id, centre_id AS atom_index, CAST(axis AS INTEGER) AS axis, round(-sum(sign(s) * ({DUFF_SQL})) / {2 * DELTA}, 4) + 0.0 AS f FROM m GROUP BY ALL"""))
def numeric_forces(spark, sf_dir):
    f = e.numeric_forces(near_atoms(spark, sf_dir), lambda r: e.duff(r, DUFF), DELTA)
    return f.select("structure_id", "atom_index", "axis", (F.round("f", 4) + 0.0).alias("f"))


def _bent(a: int) -> str:
    x = ("r * ux", "r * uy", "r * uz")
    return f"pow({x[a]} + s * CASE " + " ".join(f"WHEN p = {a} AND q = {b} THEN {x[b]} WHEN q = {a} AND p = {b} THEN {x[b]}" for b in range(3)) + " ELSE 0 END, 2)"


@query(with_views("near", f""", strains(mode, p, q) AS (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(e.STRAINS))}),
m AS (SELECT structure_id, mode, s, sqrt({_bent(0)} + {_bent(1)} + {_bent(2)}) AS r FROM near, strains, (VALUES ({DELTA}), (-{DELTA})) d(s))
SELECT m.structure_id, CAST(mode AS INTEGER) AS mode, round(sum(sign(s) * ({DUFF_SQL})) / 2 / (CASE WHEN mode < 3 THEN 2 ELSE 4 END * {DELTA} * any_value(a) ** 3), 5) + 0.0 AS stress FROM m JOIN structures st ON st.structure_id = m.structure_id GROUP BY m.structure_id, mode"""))
def numeric_stress(spark, sf_dir):
    volumes = v.cells(spark, sf_dir).select("structure_id", g.volume().alias("volume"))
    s = e.numeric_stress(near_atoms(spark, sf_dir), volumes, lambda r: e.duff(r, DUFF), DELTA)
    return s.select("structure_id", "mode", (F.round("stress", 5) + 0.0).alias("stress"))
