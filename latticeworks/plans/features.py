"""Queries: basis functions on one column, tapers, features of environments, bond order."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeworks.functions import basis as b
from latticeworks.operators import features as f
from latticeworks.operators import neighbours as n
from latticeworks.operators import structures as st
from latticeworks.operators import tables as tb

from . import views as v
from .geometry import KEY, near_atoms
from .registry import query
from .views import R_ANI, R_CUT, r6, with_views

#: Basis of the queries: functions, scale, where the taper ends, its width.
K_ISO, SMOOTH = 6, 0.1
K_R, K_THETA, ORDERS = 2, 3, (4, 6)


def long_form(df, *by):
    return df.select(*by, F.posexplode("x").alias("k", "value")).select(*by, "k", *r6("value"))


X = "(value / 100 - 2.31)"


@query(f"SELECT event_id AS obs_id, CAST(n AS INTEGER) AS k, round(exp(-0.5 * (({X} - (-2 + n * 0.75)) / 0.61) ** 2) / (0.61 * sqrt(2 * pi())), 6) + 0.0 AS value FROM events, (SELECT unnest(range(7)) AS n)")
def features_gaussian(spark, sf_dir):
    x = F.col("value") / 100 - 2.31
    return long_form(v.table(spark, sf_dir, "events").select(F.col("event_id").alias("obs_id"), b.gaussian_features(x, 7, -2.0, 0.75, 0.61).alias("x")), "obs_id")


@query(f"""SELECT event_id AS obs_id, CAST(n AS INTEGER) AS k, round(CASE WHEN n = 0 THEN 1 WHEN n < 5 THEN sin(n * {X}) ELSE cos((n - 4) * {X}) END, 6) + 0.0 AS value FROM events, (SELECT unnest(range(9)) AS n)""")
def features_fourier(spark, sf_dir):
    x = F.col("value") / 100 - 2.31
    return long_form(v.table(spark, sf_dir, "events").select(F.col("event_id").alias("obs_id"), b.fourier_features(x, 5).alias("x")), "obs_id")


@query(f"""WITH x AS (SELECT event_id AS obs_id, {X} / sqrt(7.3) AS x FROM events)
SELECT obs_id, CAST(t.k AS INTEGER) AS k, round(t.value, 6) + 0.0 AS value FROM (SELECT obs_id, unnest([{{'k': 0, 'value': 1.0::DOUBLE}}, {{'k': 1, 'value': x}}, {{'k': 2, 'value': 2 * x * x - 1}},
{{'k': 3, 'value': 4 * x ** 3 - 3 * x}}, {{'k': 4, 'value': 8 * x ** 4 - 8 * x * x + 1}}, {{'k': 5, 'value': 16 * x ** 5 - 20 * x ** 3 + 5 * x}}]) AS t FROM x)""")
def features_chebyshev(spark, sf_dir):
    x = (F.col("value") / 100 - 2.31) / F.sqrt(F.lit(7.3))
    return long_form(v.table(spark, sf_dir, "events").select(F.col("event_id").alias("obs_id"), b.chebyshev_features(x, 6).alias("x")), "obs_id")


@query(f"SELECT event_id AS obs_id, CAST(n AS INTEGER) AS k, round(pow({X} * sqrt(0.3), n), 6) + 0.0 AS value FROM events, (SELECT unnest(range(6)) AS n)")
def features_polynomial(spark, sf_dir):
    x = (F.col("value") / 100 - 2.31) * F.sqrt(F.lit(0.3))
    return long_form(v.table(spark, sf_dir, "events").select(F.col("event_id").alias("obs_id"), b.polynomial_features(x, 5).alias("x")), "obs_id")


T4 = "pow((r - {at}) / {w}, 4) / (1 + pow((r - {at}) / {w}, 4))"
X2 = "((r - 2.0) / 0.7)"


@query(with_views("near", f"""SELECT structure_id, centre_id, neigh_index, i, j, k, round(CASE WHEN r > {R_CUT} THEN 0 ELSE {T4.format(at=R_CUT, w=0.3)} END, 6) + 0.0 AS above,
round(CASE WHEN r < 0.5 THEN 0 ELSE {T4.format(at=0.5, w=0.3)} END * CASE WHEN r > {R_CUT} THEN 0 ELSE {T4.format(at=R_CUT, w=0.3)} END, 6) + 0.0 AS between,
round(CASE WHEN r > {R_CUT} THEN 0 ELSE 4 * pow((r - {R_CUT}) / 0.3, 3) / (pow(1 + pow((r - {R_CUT}) / 0.3, 4), 2) * 0.3) END, 6) + 0.0 AS slope,
round(CASE WHEN r < 2.0 THEN 0 ELSE pow({X2}, 4) / (1 + pow({X2}, 4)) END, 6) + 0.0 AS x4ge, round(CASE WHEN r > 2.7 THEN 0 WHEN r < 2.0 THEN 1 ELSE 0.5 * (cos(pi() * abs({X2})) + 1) END, 6) + 0.0 AS half,
round(pow(r, 4) / 625 / (1 + pow(r, 4) / 625) * 1.0, 6) + 0.0 AS damped,
round(-2 * pi() / {R_CUT} * sin(2 * pi() * r / {R_CUT}) * CASE WHEN r > {R_CUT} THEN 0 ELSE {T4.format(at=R_CUT, w=0.3)} END + cos(2 * pi() * r / {R_CUT}) * CASE WHEN r > {R_CUT} THEN 0 ELSE 4 * pow((r - {R_CUT}) / 0.3, 3) / (pow(1 + pow((r - {R_CUT}) / 0.3, 4), 2) * 0.3) END, 5) + 0.0 AS cos_slope
FROM near"""))
def taper_functions(spark, sf_dir):
    r = F.col("r")
    near = near_atoms(spark, sf_dir)
    made = {
        "above": b.taper(r, R_CUT, 0.3), "between": b.taper_between(r, 0.5, R_CUT, 0.3), "slope": b.taper_slope(r, R_CUT, 0.3), "x4ge": b.named_taper("x4ge", r, 2.0, 0.7),
        "half": b.named_taper("Behlerge", r, 2.0, 0.7), "damped": b.damping(r, 0.2), "cos_slope": b.tapered_cos_slope(r, 2, R_CUT, R_CUT, 0.3),
    }
    return near.select(*KEY, "neigh_index", "i", "j", "k", *((F.round(c, 5 if a == "cos_slope" else 6) + 0.0).alias(a) for a, c in made.items()))


@query(with_views("near", f"SELECT structure_id, centre_id, CAST(n AS INTEGER) AS basis_k, round(sum(cos(n * pi() * r / {R_CUT})), 5) + 0.0 AS value FROM near, (SELECT unnest(range(4)) AS n) GROUP BY ALL"))
def basis_fourier_r(spark, sf_dir):
    near = near_atoms(spark, sf_dir).select(*KEY, F.posexplode(b.fourier_array(F.col("r"), 4, R_CUT)).alias("basis_k", "x"))
    return near.groupBy(*KEY, "basis_k").agg((F.round(F.sum("x"), 5) + 0.0).alias("value"))


PTAPER = T4.format(at=R_CUT, w=SMOOTH)


def point_neighbours(spark, sf_dir):
    points = v.grid_points(spark, sf_dir).select("structure_id", F.col("point_id").alias("obs_id"), "density", "u", "v", "w")
    return n.neighbours(points, v.atoms(spark, sf_dir).drop("fx", "fy", "fz"), v.dealt_cells(spark, sf_dir), R_CUT)


def iso_design(spark, sf_dir):
    return f.isotropic(point_neighbours(spark, sf_dir), ["obs_id"], b.cosine_basis(K_ISO, R_CUT, R_CUT, SMOOTH))


@query(with_views("pnear", f"SELECT point_id AS obs_id, neigh_species AS species, CAST(n AS INTEGER) AS k, round(sum(cos(n * pi() * r / {R_CUT}) * {PTAPER}), 5) + 0.0 AS value FROM pnear, (SELECT unnest(range({K_ISO})) AS n) GROUP BY ALL"))
def design_matrix_iso(spark, sf_dir):
    """Isotropic features of every grid point: the design matrix in long form, absent cells are zeros."""
    return iso_design(spark, sf_dir).select("obs_id", "species", "k", (F.round("value", 5) + 0.0).alias("value"))


@query(with_views("pnear", "SELECT structure_id, point_id AS obs_id, round(any_value(density), 6) + 0.0 AS density, count(*) AS n, count(DISTINCT neigh_species) AS n_species, round(min(r), 6) + 0.0 AS r_min FROM pnear GROUP BY structure_id, point_id"))
def point_environments(spark, sf_dir):
    """Every sampled grid point with its target and a summary of its environment; points without neighbours drop out."""
    near = point_neighbours(spark, sf_dir)
    return near.groupBy("structure_id", "obs_id").agg(F.first("density").alias("density"), F.count("*").alias("n"), F.count_distinct("neigh_species").alias("n_species"), F.min("r").alias("r_min")).select("structure_id", "obs_id", "n", "n_species", *r6("density", "r_min"))


CUT3 = " * ".join(f"CASE WHEN {r} > {R_ANI} THEN 0 ELSE {T4.format(at=R_ANI, w=0.1).replace('(r ', f'({r} ')} END * {T4.format(at=0.0, w=0.1).replace('(r ', f'({r} ')}" for r in ("r0", "r1"))


def triplet_sql(g0: str, g1: str, h: str, n_h: int) -> str:
    """Sums over triplets; x and y index the distances, z the angle."""
    like = f"SELECT structure_id, centre_id, sp0, sp1, CAST(x * {n_h} + z AS INTEGER) AS k, round(sum({g0} * {g1.replace('y', 'x')} * {h} * {CUT3}), 5) + 0.0 AS value FROM triplets, (SELECT unnest(range({K_R})) AS x), (SELECT unnest(range({n_h})) AS z) WHERE sp0 = sp1 GROUP BY ALL"
    unlike = f"SELECT structure_id, centre_id, sp0, sp1, CAST((x * {K_R} + y) * {n_h} + z AS INTEGER) AS k, round(sum({g0} * {g1} * {h} * {CUT3}), 5) + 0.0 AS value FROM triplets, (SELECT unnest(range({K_R})) AS x), (SELECT unnest(range({K_R})) AS y), (SELECT unnest(range({n_h})) AS z) WHERE sp0 <> sp1 GROUP BY ALL"
    return with_views("triplets", f"{like} UNION ALL {unlike}")


def triplet_query(spark, sf_dir, kind):
    found = n.triplets(near_atoms(spark, sf_dir), KEY, R_ANI)
    return f.triplet_sums(found, KEY, R_ANI, K_R, K_THETA, 0.1, kind).select(*KEY, "sp0", "sp1", "k", (b.rounded(F.col("value"), 5) + 0.0).alias("value"))


COS3 = (f"cos(x * pi() * r0 / {R_ANI})", f"cos(y * pi() * r1 / {R_ANI})")


@query(triplet_sql(*COS3, "cos(z * theta)", K_THETA))
def triplet_features(spark, sf_dir):
    return triplet_query(spark, sf_dir, "cos")


@query(triplet_sql(*COS3, "CASE WHEN z % 2 = 0 THEN cos((z // 2) * theta) ELSE sin((z // 2) * theta) END", 2 * K_THETA))
def triplet_features_sc(spark, sf_dir):
    return triplet_query(spark, sf_dir, "sin+cos")


@query(triplet_sql(f"pow(r0 / {R_ANI}, x)", f"pow(r1 / {R_ANI}, y)", "pow(theta / pi(), z)", K_THETA))
def triplet_poly_features(spark, sf_dir):
    return triplet_query(spark, sf_dir, "poly")


MAPPER_SQL = f"""pairs AS (SELECT DISTINCT least(x.species, y.species) AS sp0, greatest(x.species, y.species) AS sp1 FROM (SELECT DISTINCT structure_id, species FROM atoms) x JOIN (SELECT DISTINCT structure_id, species FROM atoms) y USING (structure_id)),
kinds AS (SELECT 0 AS block_order, species AS block_key, {K_ISO} AS size FROM (SELECT DISTINCT species FROM atoms) UNION ALL SELECT CASE WHEN sp0 = sp1 THEN 1 ELSE 2 END, sp0 || '-' || sp1, CASE WHEN sp0 = sp1 THEN {K_R * K_THETA} ELSE {K_R * K_R * K_THETA} END FROM pairs),
blocks AS (SELECT block_order, block_key, CAST(coalesce(sum(size) OVER (ORDER BY block_order, block_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, size FROM kinds)"""


def mapper(spark, sf_dir):
    """Species, then like pairs, then unlike pairs, each with its columns."""
    atoms = v.atoms(spark, sf_dir)
    singles = atoms.select("species").distinct().select(F.lit(0).alias("block_order"), F.col("species").alias("block_key"))
    pairs = st.pair_domain(atoms).select(F.when(F.col("sp0") == F.col("sp1"), 1).otherwise(2).alias("block_order"), F.concat_ws("-", "sp0", "sp1").alias("block_key"))
    size = F.when(F.col("block_order") == 0, K_ISO).when(F.col("block_order") == 1, K_R * K_THETA).otherwise(K_R * K_R * K_THETA)
    return f.column_blocks(singles.unionByName(pairs), size)


@query(with_views("atoms", f", {MAPPER_SQL} SELECT block_key, start, start + size AS stop FROM blocks"))
def column_mapper(spark, sf_dir):
    return mapper(spark, sf_dir).select("block_key", "start", "stop")


@query(with_views("triplets", f""", {MAPPER_SQL}, iso AS (SELECT structure_id, centre_id, neigh_species AS block_key, n AS k, sum(cos(n * pi() * r / {R_CUT}) * {PTAPER}) AS value FROM near, (SELECT unnest(range({K_ISO})) AS n) GROUP BY ALL),
like_ AS (SELECT structure_id, centre_id, sp0 || '-' || sp1 AS block_key, x * {K_THETA} + z AS k, sum({COS3[0]} * {COS3[1].replace('y', 'x')} * cos(z * theta) * {CUT3}) AS value FROM triplets, (SELECT unnest(range({K_R})) AS x), (SELECT unnest(range({K_THETA})) AS z) WHERE sp0 = sp1 GROUP BY ALL),
unlike AS (SELECT structure_id, centre_id, sp0 || '-' || sp1 AS block_key, (x * {K_R} + y) * {K_THETA} + z AS k, sum({COS3[0]} * {COS3[1]} * cos(z * theta) * {CUT3}) AS value FROM triplets, (SELECT unnest(range({K_R})) AS x), (SELECT unnest(range({K_R})) AS y), (SELECT unnest(range({K_THETA})) AS z) WHERE sp0 <> sp1 GROUP BY ALL)
SELECT structure_id, centre_id, CAST(start + k AS INTEGER) AS col, round(value, 5) + 0.0 AS value FROM (SELECT * FROM iso UNION ALL SELECT * FROM like_ UNION ALL SELECT * FROM unlike) JOIN blocks USING (block_key)"""))
def design_matrix_ani(spark, sf_dir):
    """Isotropic and triplet features of every atom by the mapper's columns."""
    near = near_atoms(spark, sf_dir)  # found once for pairs and once for triplets, as a stored table of pairs is many times the atoms
    iso = f.isotropic(near, KEY, b.cosine_basis(K_ISO, R_CUT, R_CUT, SMOOTH)).select(*KEY, F.col("species").alias("block"), "k", "value")
    ani = f.triplet_sums(n.triplets(near, KEY, R_ANI), KEY, R_ANI, K_R, K_THETA, 0.1).select(*KEY, F.concat_ws("-", "sp0", "sp1").alias("block"), "k", "value")
    return f.design_rows(iso.unionByName(ani), mapper(spark, sf_dir), KEY, F.col("block")).select(*KEY, "col", (F.round("value", 5) + 0.0).alias("value"))


# q_l by the addition theorem: q_l^2 = sum over pairs of neighbours of w w' P_l(u . u')
P = {4: "(35 * pow(d, 4) - 30 * d * d + 3) / 8", 6: "(231 * pow(d, 6) - 315 * pow(d, 4) + 105 * d * d - 5) / 16"}


def bop_sql(weight: str, by: str = "structure_id, centre_id, neigh_species", species: bool = True, src: str = "near") -> str:
    sp = ", x.neigh_species" if species else ""
    return f"""wn AS (SELECT *, {weight} AS w FROM {src} WINDOW g AS (PARTITION BY {by})),
dots AS (SELECT x.structure_id, x.centre_id{sp}, x.w * y.w AS ww, x.ux * y.ux + x.uy * y.uy + x.uz * y.uz AS d FROM wn x JOIN wn y ON x.structure_id = y.structure_id AND x.centre_id = y.centre_id{' AND x.neigh_species = y.neigh_species' if species else ''}),
q AS (SELECT structure_id, centre_id{', neigh_species AS species' if species else ''}, sqrt(greatest(0, sum(ww * {P[4]}))) AS q4, sqrt(greatest(0, sum(ww * {P[6]}))) AS q6 FROM dots GROUP BY ALL)"""


BOP_OUT = "SELECT structure_id, centre_id, species, round(q4, 4) + 0.0 AS q4, round(q6, 4) + 0.0 AS q6 FROM q"
SPECIES_KEY = [*KEY, "neigh_species"]


def bop(spark, sf_dir, kind, digits=4):
    q = f.bond_order(near_atoms(spark, sf_dir), SPECIES_KEY, ORDERS, kind, R_CUT, kind == "taper")
    return q.select(*KEY, F.col("neigh_species").alias("species"), *((F.round(f"q{x}", digits) + 0.0).alias(f"q{x}") for x in ORDERS))


@query(with_views("near", ", " + bop_sql("1 / count(*) OVER g") + BOP_OUT))
def bop_q(spark, sf_dir):
    return bop(spark, sf_dir, "uniform")


@query(with_views("near", ", " + bop_sql("(1 / r) / sum(1 / r) OVER g") + BOP_OUT))
def bop_q_invr(spark, sf_dir):
    return bop(spark, sf_dir, "inverse")


@query(with_views("near", ", " + bop_sql("CASE WHEN count(*) OVER g = 1 THEN 1 ELSE (1 - r / sum(r) OVER g) / (count(*) OVER g - 1) END") + BOP_OUT))
def bop_q_linr(spark, sf_dir):
    return bop(spark, sf_dir, "linear")


def taper_sql() -> str:
    """Sums of |.| over m need explicit harmonics; l = 2 keeps them short."""
    t = lambda x: f"CASE WHEN {x} > 0 THEN pow(2 * ({x}), 4) / (1 + pow(2 * ({x}), 4)) ELSE 0 END"
    return f""", wn AS (SELECT *, pow({R_CUT} - r, 2) * {t('r')} * {t(f'{R_CUT} - r')} AS w FROM near),
s AS (SELECT structure_id, centre_id, neigh_species AS species, sum(w * (3 * uz * uz - 1)) * sqrt(5 / pi()) / 4 AS m0, sum(w * ux * uz) * sqrt(15 / (2 * pi())) / 2 AS r1, sum(w * uy * uz) * sqrt(15 / (2 * pi())) / 2 AS i1,
sum(w * (ux * ux - uy * uy)) * sqrt(15 / (2 * pi())) / 4 AS r2, sum(w * 2 * ux * uy) * sqrt(15 / (2 * pi())) / 4 AS i2 FROM wn GROUP BY ALL)
SELECT structure_id, centre_id, species, round(sqrt(4 * pi() / 5 * (abs(m0) + 2 * sqrt(r1 * r1 + i1 * i1) + 2 * sqrt(r2 * r2 + i2 * i2))), 4) + 0.0 AS q2 FROM s"""


@query(with_views("near", taper_sql()))
def bop_q_taper(spark, sf_dir):
    q = f.bond_order(near_atoms(spark, sf_dir), SPECIES_KEY, (2,), "taper", R_CUT, absolute=True)
    return q.select(*KEY, F.col("neigh_species").alias("species"), (F.round("q2", 4) + 0.0).alias("q2"))


def atom_q(spark, sf_dir):
    near = near_atoms(spark, sf_dir)
    q = f.bond_order(near, KEY, ORDERS)
    return near, q


ATOM_Q_SQL = bop_sql("1 / count(*) OVER g", "structure_id, centre_id", False)

# orders of neighbours: by key (each species and all), rounded own orders, the neighbours' own orders, and the centre's reference
KEYED_SQL = f"""nk AS (SELECT * EXCLUDE (neigh_species), unnest([neigh_species, 'all']) AS neigh_species FROM near), {bop_sql("1 / count(*) OVER g", src="nk")},
own AS (SELECT structure_id, centre_id, species, round(q4, 6) AS q4, round(q6, 6) AS q6 FROM q)"""
MET_SQL = KEYED_SQL + """, met AS (SELECT n.structure_id, n.centre_id, n.neigh_species AS species, n.neigh_index, n.r, coalesce(o.q4, 0) AS q4, coalesce(o.q6, 0) AS q6
FROM nk n LEFT JOIN own o ON o.structure_id = n.structure_id AND o.centre_id = n.neigh_index AND o.species = n.neigh_species),
weighted AS (SELECT *, CASE WHEN count(*) OVER g = 1 THEN 1 ELSE 1 - r / sum(r) OVER g END AS w FROM met WINDOW g AS (PARTITION BY structure_id, centre_id, species)),
mean AS (SELECT structure_id, centre_id, species, sum(w * q4) / sum(w) AS q4, sum(w * q6) / sum(w) AS q6 FROM weighted GROUP BY ALL)"""
_LINEAR = bop_sql("CASE WHEN count(*) OVER g = 1 THEN 1 ELSE (1 - r / sum(r) OVER g) / (count(*) OVER g - 1) END", src="nk")
REF_SQL = MET_SQL + ", " + _LINEAR.replace("wn ", "wn2 ").replace("dots", "dots2").replace("q AS (", "q2 AS (") + """,
ref AS (SELECT structure_id, centre_id, species, round(q4, 6) AS ref4, round(q6, 6) AS ref6 FROM q2)"""
PAIR_SQL = REF_SQL + """, pairs AS (SELECT m.structure_id, m.centre_id, m.neigh_index, m.r, m.q4 - f.ref4 AS d4, m.q6 - f.ref6 AS d6, unnest([m.species, 'all']) AS species
FROM met m JOIN ref f USING (structure_id, centre_id, species) WHERE m.species <> 'all')"""


def r4(x):
    """Rounded after a shift that no rounded order lies on, so that no engine sees a tie."""
    return F.round(x + 1e-9, 4) + 0.0


def keyed_orders(spark, sf_dir, reference=False):
    """(near, neighbours with their own orders and, with reference, the centre's). Each pass finds the neighbours again and the last one
    carries what the others gave, as a stored or shuffled table of pairs is many times the atoms."""
    near, atoms = near_atoms(spark, sf_dir), v.atoms(spark, sf_dir).drop("fx", "fy", "fz")
    told = f.keyed_atoms(atoms, {"own": f.own_order(near, ORDERS)})
    centres = n.atom_centres(atoms)
    if reference:
        carried = f.keyed_atoms(atoms, {"ref": f.own_reference(near, ORDERS)})
        centres = carried.select("structure_id", F.col("atom_index").alias("centre_id"), F.col("species").alias("centre_species"), "u", "v", "w", "ref")
    return near, f.told_orders(n.neighbours(centres, told, v.dealt_cells(spark, sf_dir), R_CUT, told=("own",)), ORDERS, reference)


@query(with_views("near", f", {KEYED_SQL} SELECT structure_id, centre_id, species, round(q4 + 1e-9, 4) + 0.0 AS q4, round(q6 + 1e-9, 4) + 0.0 AS q6 FROM own"))
def atom_q_table(spark, sf_dir):
    """Every atom's own bond order by species key and for all of its neighbours."""
    q = f.own_order(near_atoms(spark, sf_dir), ORDERS)
    return q.select(*KEY, "species", *(r4(F.col(f"q{x}")).alias(f"q{x}") for x in ORDERS))


@query(with_views("near", f", {REF_SQL} SELECT structure_id, centre_id, species, round(q4 + 1e-9, 4) + 0.0 AS q4, round(q6 + 1e-9, 4) + 0.0 AS q6, round(q4 - ref4 + 1e-9, 4) + 0.0 AS q4_ref, round(q6 - ref6 + 1e-9, 4) + 0.0 AS q6_ref FROM mean JOIN ref USING (structure_id, centre_id, species)"))
def bop_atom_average(spark, sf_dir):
    """Weighted means of the neighbours' own orders by key, and the same less the centre's own order."""
    near, met = keyed_orders(spark, sf_dir)
    both = f.neighbour_average(met, ORDERS).join(f.own_reference(near, ORDERS), [*KEY, "species"])
    made = {f"q{x}": F.col(f"q{x}") for x in ORDERS} | {f"q{x}_ref": F.col(f"q{x}") - F.col(f"ref{x}") for x in ORDERS}
    return both.select(*KEY, "species", *(r4(c).alias(n) for n, c in made.items()))


@query(with_views("near", f", {PAIR_SQL} SELECT structure_id, centre_id, species, count(*) AS n, round(min(d4) + 1e-9, 4) + 0.0 AS d4_min, round(max(d4) + 1e-9, 4) + 0.0 AS d4_max, round(sum(r * d4), 3) + 0.0 AS rd4, round(sum(r * d6), 3) + 0.0 AS rd6 FROM pairs GROUP BY ALL"))
def bop_neighbour_pairs(spark, sf_dir):
    """The pairs of distance and order less the reference, summed up by centre and key."""
    pairs = f.order_pairs(keyed_orders(spark, sf_dir, True)[1], None, ORDERS)
    sums = [(F.round(F.sum(F.col("r") * F.col(f"d{x}")), 3) + 0.0).alias(f"rd{x}") for x in ORDERS]
    return pairs.groupBy(*KEY, "species").agg(F.count("*").alias("n"), r4(F.min("d4")).alias("d4_min"), r4(F.max("d4")).alias("d4_max"), *sums)


#: Functions of an order, and of each index of a pair.
K_Q, K_PAIR = 3, 2


def order_mapper(spark, sf_dir, kinds, size):
    """Columns by order, kind and key: species first, then all."""
    species = v.kinds(spark, sf_dir).select(F.concat(F.lit("0"), "species").alias("o"), "species").unionByName(spark.range(1).select(F.lit("1").alias("o"), F.lit("all").alias("species")))
    at = F.explode(F.array(*(F.struct(F.lit(100 * x + n).alias("block_order"), F.lit(f"{kind}{x}").alias("name")) for x in ORDERS for n, kind in enumerate(kinds)))).alias("b")
    blocks = species.select("o", "species", at).select("b.block_order", F.concat_ws("|", "o", "b.name").alias("block_key"))
    return f.column_blocks(blocks, F.lit(size))


def by_columns(rows, mapper, name):
    key = F.concat_ws("|", F.concat(F.when(F.col("species") == "all", "1").otherwise("0"), F.when(F.col("species") != "all", F.col("species")).otherwise("")), name)
    return f.design_rows(rows, mapper, KEY, key)


def order_blocks_sql(kinds: str, size: int) -> str:
    return f"""blocks AS (SELECT species, kind, l, {size} * (row_number() OVER (ORDER BY l, kind_no, species = 'all', species) - 1) AS start
FROM (SELECT DISTINCT species FROM atoms UNION ALL SELECT 'all'), (VALUES {kinds}) k(kind, kind_no), (VALUES (4), (6)) o(l))"""


@query(with_views("near", f""", {MET_SQL}, {order_blocks_sql("('cos', 0), ('sin', 1)", K_Q)}, long AS (SELECT structure_id, centre_id, species, unnest([4, 6]) AS l, unnest([q4, q6]) AS q FROM mean)
SELECT structure_id, centre_id, CAST(start + n AS INTEGER) AS col, round(CASE kind WHEN 'cos' THEN cos(n * pi() * q) ELSE sin(n * pi() * q) END, 3) + 0.0 AS value FROM long JOIN blocks USING (species, l), (SELECT unnest(range({K_Q})) AS n)"""))
def bop_average_features(spark, sf_dir):
    """cos and sin of the averaged orders in the mapper's columns."""
    kinds = ["cos", "sin"]
    place, name = (F.split_part("block_key", F.lit("|"), F.lit(x)) for x in (1, 2))
    blocks = order_mapper(spark, sf_dir, kinds, K_Q).groupBy(F.when(place == "1", "all").otherwise(F.substring(place, 2, 99)).alias("species"))
    starts = blocks.agg(*(F.max(F.when(name == f"{kind}{x}", F.col("start"))).alias(f"{kind}{x}") for x in ORDERS for kind in kinds))
    rows = f.order_design(f.neighbour_average(keyed_orders(spark, sf_dir)[1], ORDERS), starts, ORDERS, K_Q)
    return rows.select(*KEY, "col", (b.rounded(F.col("value"), 3) + 0.0).alias("value"))


@query(with_views("near", f""", {PAIR_SQL}, {order_blocks_sql("('pair', 0)", K_PAIR**2)}, long AS (SELECT structure_id, centre_id, species, r, unnest([4, 6]) AS l, unnest([d4, d6]) AS d FROM pairs)
SELECT structure_id, centre_id, CAST(start + x * {K_PAIR} + y AS INTEGER) AS col, round(sum(cos(x * pi() * r / {R_CUT}) * cos(y * pi() * d) * {PTAPER}), 3) + 0.0 AS value
FROM long JOIN blocks USING (species, l), (SELECT unnest(range({K_PAIR})) AS x), (SELECT unnest(range({K_PAIR})) AS y) GROUP BY ALL"""))
def bop_pair_features(spark, sf_dir):
    """Products of functions of distance and of the neighbour's order less the reference, summed by key, in the mapper's columns."""
    rows = f.pair_features(f.order_pairs(keyed_orders(spark, sf_dir, True)[1], None, ORDERS), ORDERS, K_PAIR, R_CUT, R_CUT, SMOOTH)
    made = by_columns(rows, order_mapper(spark, sf_dir, ["pair"], K_PAIR**2), F.concat(F.lit("pair"), F.col("l").cast("string")))
    return made.select(*KEY, "col", (F.round("value", 3) + 0.0).alias("value"))


@query(with_views("near", f", {ATOM_Q_SQL} SELECT structure_id, centre_id, CAST(n AS INTEGER) AS k, round(CASE WHEN n < 3 THEN cos(n * pi() * q4) ELSE sin((n - 2) * pi() * q4) END, 3) + 0.0 AS value FROM q, (SELECT unnest(range(5)) AS n)"))
def bop_features(spark, sf_dir):
    q = atom_q(spark, sf_dir)[1].select(*KEY, F.posexplode(b.fourier_array(F.col("q4"), 3, 1.0, sines=True)).alias("k", "value"))
    return q.select(*KEY, "k", (F.round("value", 3) + 0.0).alias("value"))


@query(with_views("near", """, s AS (SELECT structure_id, centre_id, sqrt(1 + 0.01 * (sum(r * ux) ** 2 + sum(r * uy) ** 2 + sum(r * uz) ** 2)) AS q FROM near GROUP BY ALL)
SELECT structure_id, centre_id, round(q, 6) + 0.0 AS resultant, round(cos(pi() * q), 5) + 0.0 AS c1 FROM s"""))
def resultant_feature(spark, sf_dir):
    q = f.resultant(near_atoms(spark, sf_dir), KEY)
    return q.select(*KEY, *r6("resultant"), (F.round(F.cos(b.PI * F.col("resultant")), 5) + 0.0).alias("c1"))


@query(with_views("near", f"""SELECT structure_id, centre_id, species, count(*) AS n, round(sum(cos(pi() * r / {R_CUT})), 5) + 0.0 AS c1 FROM (SELECT structure_id, centre_id, r, unnest([neigh_species, 'all']) AS species FROM near) GROUP BY ALL"""))
def features_everything(spark, sf_dir):
    """Sums by each species and by all of them together."""
    near = f.used(near_atoms(spark, sf_dir), "everything")
    return near.groupBy(*KEY, F.col("neigh_species").alias("species")).agg(F.count("*").alias("n"), (F.round(F.sum(F.cos(b.PI * F.col("r") / R_CUT)), 5) + 0.0).alias("c1"))


GRID_Q = 20


@query(with_views("near", ", " + bop_sql("1 / count(*) OVER g") + f""", l AS (SELECT species, unnest(['q4', 'q6']) AS tag, unnest([q4, q6]) AS q FROM q),
f AS (SELECT species, tag, min(q) AS lo, max(q) AS hi, avg(1.0::DOUBLE) AS w0, avg(cos(pi() * q)) AS w1, avg(cos(2 * pi() * q)) AS w2 FROM l GROUP BY ALL), x AS (SELECT *, lo + bin * round((hi - lo) / {GRID_Q}, 6) AS x FROM f, (SELECT unnest(range({GRID_Q})) AS bin))
SELECT species, tag, CAST(bin AS INTEGER) AS bin, round(x, 5) + 0.0 AS x, round(w0 + w1 * cos(pi() * x) + w2 * cos(2 * pi() * x), 4) + 0.0 AS y FROM x"""))
def q_functions(spark, sf_dir):
    """Functions of bond order per species and order, between the bounds that occur; weights are the basis functions' means."""
    q = f.bond_order(near_atoms(spark, sf_dir), SPECIES_KEY, ORDERS)
    long = q.select(F.col("neigh_species").alias("species"), F.explode(F.map_from_arrays(F.array(F.lit("q4"), F.lit("q6")), F.array("q4", "q6"))).alias("tag", "q"))
    basis = [lambda x, k=k: F.cos(k * b.PI * x) for k in range(3)]
    bounds = long.groupBy("species", "tag").agg(F.min("q").alias("lo"), F.max("q").alias("hi"), F.array(*(F.avg(g(F.col("q"))) for g in basis)).alias("weights"))
    return tb.on_grid(bounds, GRID_Q, basis).select("species", "tag", "bin", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))
