"""Queries: text sources rendered from the given tables, grids and exports.

Numbers are rendered as integers, which every engine prints alike; lines keep the form that the readers expect.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.sources import lines as ln
from latticeworks.sources import readers as rd
from latticeworks.sources import writers as wr
from latticeworks.sources.store import shared_folder, stored

from . import views as v
from .registry import query
from .views import r6, with_views

LOG_SQL = with_views("atoms", """, l AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS n, l_returnflag, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
x AS (SELECT l_orderkey AS file, n, unnest([0, 1, 2]) AS s, l_returnflag, l_partkey, l_suppkey, q FROM l),
lines AS (SELECT file, n * 3 + s AS pos, CASE WHEN s = 0 THEN CASE l_returnflag WHEN 'A' THEN 'cell' WHEN 'N' THEN 'forces' ELSE 'run' END WHEN s = 1 THEN 'row' ELSE 'energy' END AS kind, l_partkey, l_suppkey, q FROM x),
starts AS (SELECT *, max(CASE WHEN kind = 'run' THEN pos END) OVER (PARTITION BY file) AS start FROM lines),
kept AS (SELECT *, last_value(CASE WHEN kind IN ('cell', 'forces') THEN kind END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS block FROM starts WHERE start IS NULL OR pos >= start)
SELECT 'S' || file AS file, coalesce(block, 'none') AS block, count(*) FILTER (kind = 'row') AS n_rows, CAST(coalesce(sum(l_partkey + 2 * l_suppkey) FILTER (kind = 'row'), 0) AS BIGINT) AS total, CAST(arg_max(q, pos) FILTER (kind = 'energy') AS BIGINT) AS energy FROM kept GROUP BY file, block""")


def log_lines(spark, sf_dir):
    """Each order as a log: an atom's line is a marker, a data row and an energy."""
    line = v.table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    marker = F.when(F.col("l_returnflag") == "A", " Cell Contents").when(F.col("l_returnflag") == "N", " ******** Forces ********").otherwise(" Run started: now")
    rows = F.array(marker, F.format_string(" * %d %d", "l_partkey", "l_suppkey"), F.format_string("Final energy = %d", F.col("l_quantity").cast("long")))
    made = line.select(F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("file"), n.alias("n"), F.posexplode(rows).alias("s", "line"))
    return made.select("file", (F.col("n") * 3 + F.col("s")).alias("pos"), "line")


@query(LOG_SQL)
def ingest_log_blocks(spark, sf_dir):
    """Blocks of the last run of every log, with the sums of their rows and the last energy."""
    kept = ln.last_run(log_lines(spark, sf_dir))
    tagged = ln.tag_blocks(kept, {"cell": F.col("line").contains("Cell Contents"), "forces": F.col("line").contains("Forces")})
    row = F.col("line").startswith(" * ") & ~F.col("line").contains("Forces")
    n = ln.numbers(F.col("line"))
    energy = F.col("line").startswith("Final energy")
    return tagged.groupBy("file", F.coalesce("block", F.lit("none")).alias("block")).agg(
        F.count(F.when(row, 1)).alias("n_rows"), F.coalesce(F.sum(F.when(row, n[0] + 2 * n[1])).cast("long"), F.lit(0)).alias("total"), F.max_by(n[0], F.when(energy, F.col("pos"))).cast("long").alias("energy"),
    )


def trajectory_lines(spark, sf_dir):
    """Ten structures make a trajectory: a blank line, energy, cell, then positions and forces of each atom, in atomic units."""
    atoms = v.atoms(spark, sf_dir)
    s = v.structures(spark, sf_dir).select("structure_id", F.round(F.col("a") * 100).cast("long").alias("a"), F.round(F.col("energy") * 10000).cast("long").alias("e")).join(atoms.select("structure_id").distinct(), "structure_id")
    head = s.select("structure_id", F.lit(-1).cast("long").alias("n"), F.posexplode(F.array(F.lit(""), F.format_string("%d <-- E", "e"), F.format_string("%d 0 0 <-- h", "a"), F.format_string("0 %d 0 <-- h", "a"), F.format_string("0 0 %d <-- h", "a"))).alias("s", "line"))
    i = lambda c: F.round(F.col(c) * 1000).cast("long")
    body = atoms.select("structure_id", F.col("atom_index").alias("n"), F.posexplode(F.array(F.format_string("%s %d %d %d %d <-- R", "species", F.col("atom_index") + 1, i("u"), i("v"), i("w")), F.format_string("%s %d %d %d %d <-- F", "species", F.col("atom_index") + 1, i("fx"), i("fy"), i("fz")))).alias("s", "line"))
    every = head.unionByName(body).withColumn("file", F.concat(F.lit("T"), F.floor(F.col("structure_id") / 10).cast("string"), F.lit(".md")))
    # positions and forces of a frame need only keep the order of its atoms
    return every.withColumn("name", F.regexp_extract("file", r"^([^.]*)", 1)).withColumn("pos", F.col("structure_id") * 1000 + (F.col("n") + 1) * 10 + F.col("s")).select("file", "name", "pos", "line")


@query(with_views("structures atoms", f""", s AS (SELECT structure_id, round(a * 100) AS a, round(energy * 10000) AS e, row_number() OVER (PARTITION BY structure_id // 10 ORDER BY structure_id) - 1 AS n FROM structures WHERE structure_id IN (SELECT structure_id FROM atoms)),
x AS (SELECT s.structure_id, n, e, a, count(*) AS n_atoms, sum(round(u * 1000) / a) AS u, sum(round(v * 1000) / a) AS v, sum(round(fz * 1000)) AS fz FROM s JOIN atoms USING (structure_id) WHERE n > 0 GROUP BY ALL)
SELECT 'T' || (structure_id // 10) || '-' || n AS name, n_atoms, round(e * {rd.HARTREE}, 3) + 0.0 AS energy, round(u / sqrt(2), 5) + 0.0 AS u, round(v / sqrt(2), 5) + 0.0 AS v, round(fz * {rd.HARTREE} / {rd.BOHR}, 3) + 0.0 AS fz FROM x"""))
def ingest_trajectory(spark, sf_dir):
    t = rd.trajectory(trajectory_lines(spark, sf_dir))
    total = lambda c, k: F.aggregate(c, F.lit(0.0), lambda s, x: s + x[k])
    out = t.select("name", F.size("species").cast("long").alias("n_atoms"), "energy", (total("positions", 0) / F.sqrt(F.lit(2.0))).alias("u"), (total("positions", 1) / F.sqrt(F.lit(2.0))).alias("v"), total("forces", 2).alias("fz"))
    return out.select("name", "n_atoms", *((F.round(c, d) + 0.0).alias(c) for c, d in (("energy", 3), ("u", 5), ("v", 5), ("fz", 3))))


GRID_SQL = """g AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CAST(floor(value * 100) AS BIGINT) AS raw, 3 + user_id % 5 AS s FROM events)"""


def grid_lines(spark, sf_dir):
    """Each user's events as a grid file on a cubic cell, 6 x 5 x as many as there are."""
    e = v.table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = e.select("user_id", (n + 10).alias("pos"), F.format_string("%d %d %d %d", n % 6 + 1, F.floor(n / 6) % 5 + 1, F.floor(n / 30) + 1, F.floor(F.col("value") * 100).cast("long")).alias("line"))
    u = e.select("user_id").distinct()
    s = F.format_string
    a = 3 + F.col("user_id") % 5
    head = u.select("user_id", F.posexplode(F.array(F.lit(" BEGIN header"), F.lit("  Real Lattice(A)   Lattice parameters(A)"), s("%d.0 0.0 0.0 a = %d", a, a), s("0.0 %d.0 0.0 b = %d", a, a), s("0.0 0.0 %d.0 c = %d", a, a), F.lit("1 ! nspins"), F.lit("6 5 1000 ! fine FFT grid along <a,b,c>"), F.lit(" END header: data"))).alias("pos", "line"))
    every = head.unionByName(rows)
    return every.select(F.concat(F.lit("G"), F.col("user_id").cast("string"), F.lit(".den_fmt")).alias("file"), F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("name"), "pos", "line")


@query(f"WITH {GRID_SQL} SELECT 'G' || user_id AS name, CAST(n % 6 + 1 AS INTEGER) AS a, CAST(n // 6 % 5 + 1 AS INTEGER) AS b, CAST(n // 30 + 1 AS INTEGER) AS c, round(n % 6 / 6::DOUBLE * s, 6) + 0.0 AS x, round(raw / (s * s * s)::DOUBLE, 6) + 0.0 AS density FROM g")
def ingest_grid_density(spark, sf_dir):
    return rd.grid_density(grid_lines(spark, sf_dir)).select("name", "a", "b", "c", *r6("x", "density"))


@query(f"WITH {GRID_SQL} SELECT 'G' || user_id AS name, count(*) AS n, CAST(sum(raw) AS BIGINT) AS raw FROM g WHERE raw >= 500 GROUP BY user_id")
def grid_thin(spark, sf_dir):
    grid = rd.thinned(rd.grid_density(grid_lines(spark, sf_dir)), 500.0)
    return grid.groupBy("name").agg(F.count("*").alias("n"), F.sum("raw").cast("long").alias("raw"))


#: Values of a line of a flat grid.
CHUNK = 1000


@query(f"WITH {GRID_SQL} SELECT 'G' || user_id AS name, CAST(n % 4 AS INTEGER) AS u, CAST(n // 4 % 3 AS INTEGER) AS v, CAST(n // 12 AS INTEGER) AS w, round(raw * 1.8897259886::DOUBLE ** 3, 4) + 0.0 AS density FROM g")
def ingest_flat_grid(spark, sf_dir):
    """Each user's events as a line of dimensions and lines of CHUNK values."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = v.table(spark, sf_dir, "events").select("user_id", n.alias("n"), F.floor(F.col("value") * 100).cast("long").alias("raw"))
    chunk = (F.floor(F.col("n") / CHUNK) * CHUNK).alias("first")
    body = e.groupBy("user_id", chunk).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda x: x["raw"].cast("string")), " ").alias("line"))
    head = e.select("user_id").distinct().select("user_id", F.lit(None).cast("long").alias("first"), F.lit("x-dimension: 4 y-dimension: 3 z-dimension: 99 # of spins: 1").alias("line"))
    lines = body.unionByName(head).select(F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("name"), F.lit("").alias("file"), "first", "line")
    return rd.flat_grid(lines).select("name", "u", "v", "w", (F.round("density", 4) + 0.0).alias("density"))


@query(f"WITH {GRID_SQL} SELECT 'G' || user_id AS name, CAST(n % 4 AS INTEGER) AS u, CAST(n // 4 % 3 AS INTEGER) AS v, CAST(n // 12 AS INTEGER) AS w, round(raw * 1.8897259886::DOUBLE ** 3, 4) + 0.0 AS density FROM g")
def ingest_flat_grid_files(spark, sf_dir):
    """Each user's events as a file of one line, written to the shared folder and read back by number."""
    e = v.table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100).cast("long").alias("raw"))
    text = F.concat(F.lit("  x-dimension: 4   y-dimension: 3   z-dimension: 99   # of spins: 1  "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "raw"))), lambda x: x["raw"].cast("string")), "  "))
    folder = f"{shared_folder(spark)}/grids-{uuid.uuid4().hex}"
    stored(wr.write_files(e.groupBy("user_id").agg(text.alias("text")).select(F.format_string("G%d.den", "user_id").alias("file"), "text"), folder))
    return rd.read_flat_grid(spark, folder).select("name", "u", "v", "w", (F.round("density", 4) + 0.0).alias("density"))


@query(with_views("atoms structures", """, a AS (SELECT structure_id, list(printf('%-5s %-20.6f %-20.6f %-20.6f', species, u, v, w) ORDER BY atom_index) AS t FROM atoms GROUP BY 1)
SELECT name, '%BLOCK LATTICE_CART' || chr(10) || printf('%-20.6f %-20.6f %-20.6f', a, 0.0::DOUBLE, 0.0::DOUBLE) || chr(10) || printf('%-20.6f %-20.6f %-20.6f', 0.1 * a, a, 0.0::DOUBLE) || chr(10) || printf('%-20.6f %-20.6f %-20.6f', 0.0::DOUBLE, 0.2 * a, a)
|| chr(10) || '%ENDBLOCK LATTICE_CART' || chr(10) || chr(10) || '%BLOCK POSITIONS_FRAC' || chr(10) || array_to_string(t, chr(10)) || chr(10) || '%ENDBLOCK POSITIONS_FRAC' || chr(10) AS text FROM a JOIN structures USING (structure_id)"""))
def export_ion_text(spark, sf_dir):
    return wr.ion_text(nested(spark, sf_dir))


def nested(spark, sf_dir):
    """Structures with their atoms as arrays."""
    rows = v.atoms(spark, sf_dir).groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("atom_index", "species", "u", "v", "w"))).alias("s"))
    cell = v.cells(spark, sf_dir).select("structure_id", F.array(*(F.array(*(f"{p}{d}" for d in "xyz")) for p in "abc")).alias("cell"))
    both = rows.join(cell, "structure_id").join(v.structures(spark, sf_dir).select("structure_id", "name"), "structure_id")
    return both.select("name", "cell", F.transform("s", lambda x: x["species"]).alias("species"), F.transform("s", lambda x: F.array(x["u"], x["v"], x["w"])).alias("positions"))


GAP = "coalesce(CAST(round(1 / min(g)) AS BIGINT), 1)"


def _gaps(c: str) -> str:
    return f"m_{c} AS (SELECT structure_id, {GAP} AS m_{c} FROM (SELECT structure_id, lead(x) OVER (PARTITION BY structure_id ORDER BY x) - x AS g FROM (SELECT DISTINCT structure_id, round({c}, 8) AS x FROM small)) GROUP BY 1)"


SMALL_SQL = "small AS (SELECT event_id AS point_id, event_id % 1000 AS structure_id, (event_id // 1000 % 4) / 4::DOUBLE AS u, (event_id // 4000 % 5) / 5::DOUBLE AS v, 0.0::DOUBLE AS w, value / 100 - 0.3 AS density FROM events)"


def small_grid(spark, sf_dir):
    """A grid of four by five by one points for each structure, whole for the larger tables only."""
    e = v.table(spark, sf_dir, "events")
    k = F.floor(F.col("event_id") / 1000)
    return e.select(F.col("event_id").alias("point_id"), (F.col("event_id") % 1000).alias("structure_id"), (k % 4 / 4.0).alias("u"), (F.floor(k / 4) % 5 / 5.0).alias("v"), F.lit(0.0).alias("w"), (F.col("value") / 100 - 0.3).alias("density"))


@query(f"""WITH {SMALL_SQL}, s AS (SELECT structure_id, count(DISTINCT round(u, 8)) AS n_u, count(DISTINCT round(v, 8)) AS n_v, count(DISTINCT round(w, 8)) AS n_w, count(*) AS n, count(DISTINCT (round(u, 8), round(v, 8), round(w, 8))) AS n_distinct FROM small GROUP BY 1),
{_gaps("u")}, {_gaps("v")}, {_gaps("w")} SELECT structure_id, n_u, n_v, n_w, n, n = n_u * n_v * n_w AND n_u = m_u AND n_v = m_v AND n_w = m_w AND n = n_distinct AS complete FROM s JOIN m_u USING (structure_id) JOIN m_v USING (structure_id) JOIN m_w USING (structure_id)""")
def grid_complete_check(spark, sf_dir):
    return wr.grid_report(small_grid(spark, sf_dir)).select("structure_id", "n_u", "n_v", "n_w", "n", "complete")


@query(f"WITH {SMALL_SQL} SELECT structure_id, point_id, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY round(w, 8), round(v, 8), round(u, 8), point_id) - 1 AS INTEGER) AS place, round(greatest(density, 0) / 1.8897259886::DOUBLE ** 3, 6) + 0.0 AS value FROM small")
def grid_linearise(spark, sf_dir):
    return wr.linearised(small_grid(spark, sf_dir)).select("structure_id", "point_id", "place", *r6("value"))


KINDS = ["castep", "md", "geom", "den_fmt", "profess", "den", "ion", "final.geom", "contcar", "xml"]


def rendered(spark, sf_dir):
    """(file, text): each supplier as a structure of two atoms in a file of one of ten kinds; flat grids have an .ion file beside them.

    Edge a, energy e, first coordinate u of the first atom (0.5 for the second), force g and stress p.
    """
    k = F.col("s_suppkey")
    own = v.table(spark, sf_dir, "supplier").select(k.alias("k"), (k % 10).alias("f"), (3 + k % 5).cast("double").alias("a"), F.floor("s_acctbal").cast("double").alias("e"), (k % 4 / 4.0).alias("u"), (F.col("s_nationkey") + 1).cast("double").alias("g"), (F.col("s_nationkey") - 7).cast("double").alias("p"))
    t = lambda pattern, *cols: F.format_string(pattern, *(F.col(c) if isinstance(c, str) else c for c in cols))
    cell = lambda head="", tail="": t("\n".join(head + x + tail for x in ("%.1f 0.0 0.0", "0.0 %.1f 0.0", "0.0 0.0 %.1f")) + "\n", "a", "a", "a")
    cat = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    log = cat(
        " Run started: a\n type of calculation : single point energy\n Real Lattice(A)\n", cell(), "\n Lattice parameters(A)\n x Fractional coordinates of atoms x\n", t(" x Cu 1 %.2f 0.25 0.75 x\n x Zn 1 0.50 0.25 0.75 x\n", "u"),
        t("Final energy, E = 99.0 eV\nNB est. 0K energy (E-0.5TS) = %.1f eV\n", "e"), t(" ******* Forces *******\n * Cu 1 0.0 0.0 %.1f *\n * Zn 1 0.0 0.0 1.0 *\n *****\n", "g"), t(" ***** Stress Tensor *****\n * x %.1f 0.0 0.0 *\n * y 0.0 %.1f 0.0 *\n * z 0.0 0.0 %.1f *\n * Pressure: 1 *\n", "p", "p", "p"),
    )
    frame = lambda n: cat(f"\n {n}.0\n", t(" %.1f 0.0 0.0 <-- E\n", F.col("e") + n), cell(" ", " <-- h"), t(" Cu 1 %.4f 0.0 0.0 <-- R\n Zn 1 %.4f 0.0 0.0 <-- R\n Cu 1 0.0 0.0 %.1f <-- F\n Zn 1 0.0 0.0 1.0 <-- F\n", F.col("u") * F.col("a"), F.col("a") * 0.5, "g"))
    steps = cat(" BEGIN header\n\n END header\n", frame(0), frame(1), frame(2))
    grid = cat(" BEGIN header\n Real Lattice(A)\n", cell(), "\n 1 ! nspins\n 2 1 1 ! fine FFT grid along <a,b,c>\n END header: data\n\n", t(" 1 1 1 %.1f\n 2 1 1 2.0\n", "g"))
    free = cat(t("# FINAL ENERGIES #\n# TOTAL ENERGY = %.1f eV #\n TOTAL-FORCE (eV/A)\n: Cu 1 0.0 0.0 %.1f :\n: Zn 1 0.0 0.0 1.0 :\n TOTAL-FORCE (Hartree/Bohr)\n", "e", "g"), " LATTICE VECTORS (Angstrom)\n", cell(" LAT 1 "), " STRESS (GPa)\n", t(" ST_GPa 1 %.1f 0.0 0.0\n ST_GPa 2 0.0 %.1f 0.0\n ST_GPa 3 0.0 0.0 %.1f\n", "p", "p", "p"))
    flat = t("x-dimension: 2 y-dimension: 2 z-dimension: 1 # of spins: 1 %.1f 1.0 2.0 3.0", "g")
    head = cat("%BLOCK LATTICE_CART\n", cell(), "%ENDBLOCK LATTICE_CART\n")
    ion = cat(head, t("%%BLOCK POSITIONS_FRAC\nCu %.2f 0.25 0.75\nZn 0.50 0.25 0.75\n%%ENDBLOCK POSITIONS_FRAC\n", "u"))
    final = cat(head, t("%%block positions_abs\nCu %.4f 0.0 0.0\nZn %.4f 0.0 0.0\n%%endblock positions_abs\n", F.col("u") * F.col("a"), F.col("a") * 0.5))
    places = cat("comment\n1.0\n", cell(), t("Cu Zn\n1 1\nDirect\n%.2f 0.25 0.75\n0.50 0.25 0.75\n", "u"))
    xml = cat(
        '<modeling><atominfo><array name="atoms"><set><rc><c>Cu</c></rc><rc><c>Zn</c></rc></set></array></atominfo>\n<calculation><scstep><energy><i name="e_fr_energy">1.0</i><i name="e_0_energy">1.0</i></energy></scstep>\n<structure><crystal><varray name="basis">', cell("<v>", "</v>"),
        t('</varray></crystal><varray name="positions"><v>%.2f 0.25 0.75</v><v>0.50 0.25 0.75</v></varray></structure>\n<varray name="forces"><v>0 0 %.1f</v><v>0 0 1.0</v></varray><energy><i name="e_fr_energy">%.1f</i></energy></calculation></modeling>\n', "u", "g", "e"),
    )
    text = F.element_at(F.array(log, steps, steps, grid, free, flat, ion, final, places, xml), (F.col("f") + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("f") + 1).cast("int"))
    files = own.select(t("S%d.%s", "k", kind).alias("file"), text.alias("text"))
    return files.unionByName(own.where("f = 5").select(t("S%d.ion", "k").alias("file"), ion.alias("text")))


@query(f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 10 AS f, CAST(3 + s_suppkey % 5 AS DOUBLE) AS a, floor(s_acctbal) AS e, (s_suppkey % 4) / 4::DOUBLE AS u, CAST(s_nationkey + 1 AS DOUBLE) AS g, CAST(s_nationkey - 7 AS DOUBLE) AS p FROM supplier),
n AS (SELECT *, 'S' || k || CASE WHEN f = 1 THEN '-' || n ELSE '' END AS name, CASE WHEN f IN (1, 2) THEN {rd.BOHR} ELSE 1 END AS len FROM s, (VALUES (1), (2)) x(n) WHERE n = 2 OR f = 1)
SELECT name, CASE WHEN f = 3 THEN NULL ELSE 2 END AS n_atoms, round(CASE WHEN f IN (1, 2) THEN (e + n) * {rd.HARTREE} WHEN f IN (0, 4, 9) THEN e END, 4) + 0.0 AS energy, round(pow(a * len, 3), 4) + 0.0 AS volume,
CASE WHEN f IN (3, 4) THEN NULL ELSE round(u + 0.5, 5) + 0.0 END AS u, round(CASE WHEN f IN (1, 2) THEN (g + 1) * {rd.HARTREE} / {rd.BOHR} WHEN f IN (0, 4, 9) THEN g + 1 END, 4) + 0.0 AS force, CASE WHEN f IN (0, 4) THEN 3 * p END AS stress,
CAST(CASE f WHEN 3 THEN 2 WHEN 5 THEN 4 END AS BIGINT) AS n_points, CASE f WHEN 5 THEN 'S' || k || '.den,S' || k || '.ion' ELSE 'S' || k || '.' || CASE f {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(KINDS))} END END AS files FROM n""")
def ingest_directory(spark, sf_dir):
    """Files of all ten kinds, written to the shared folder and read back as one directory."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    stored(wr.write_files(rendered(spark, sf_dir), folder))
    total = lambda c, i: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x[i]), 5) + 0.0
    diagonal = lambda c: [F.col(c)[i][i] for i in range(3)]
    x, y, z = diagonal("cell")
    return rd.read_directory(spark, folder).select(
        "name", F.when(F.col("species").isNotNull(), F.size("species")).alias("n_atoms"), (F.round("energy", 4) + 0.0).alias("energy"), (F.round(x * y * z, 4) + 0.0).alias("volume"), total("positions", 0).alias("u"),
        (F.round(F.aggregate("forces", F.lit(0.0), lambda s, q: s + q[2]), 4) + 0.0).alias("force"), sum(diagonal("stress"), F.lit(0.0)).alias("stress"), "n_points", F.array_join("files", ",").alias("files"),
    )


#: How a file of each kind is damaged (a pattern and what takes its place), and the reason for which it is rejected.
DAMAGE = {
    "castep": (r"^", "Warning: electronic minimisation did not converge when finding ground state.\n", "electronic cycles did not converge"), "md": ("<-- h", "<-- q", "no cell"), "geom": (r" Zn 1 [^\n]*<-- R\n", "", "forces do not match species"),
    "den_fmt": (r" 2 1 1 2\.0\n", "", "grid is not whole"), "profess": (r"\(Angstrom\)", "(Bohr)", "length unit is not read"), "den": ("# of spins: 1", "# of spins: 2", "more than one spin"), "ion": (r"Zn 0\.50", "Zn what", "positions do not match species"),
    "final.geom": ("LATTICE_CART", "LATTICE_OTHER", "no cell"), "contcar": (r"1 1\nDirect", "1 x\nDirect", "positions do not match species"), "xml": ("</calculation>", "", "no cell"),
}


@query(f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 10 AS f, s_suppkey % 3 = 0 AS bad FROM supplier)
SELECT 'reject' AS what, 'S' || k || '.' || CASE f {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(KINDS))} END AS name, CASE f {' '.join(f"WHEN {i} THEN '{DAMAGE[x][2]}'" for i, x in enumerate(KINDS))} END AS reason FROM s WHERE bad
UNION ALL SELECT 'structure', 'S' || k || CASE WHEN f = 1 THEN '-' || n ELSE '' END, NULL FROM s, (VALUES (1), (2)) x(n) WHERE (n = 2 OR f = 1) AND (NOT bad OR f = 5)""")
def ingest_rejects(spark, sf_dir):
    """Files of all ten kinds, every third damaged: the structures of the others, and a reason for each damaged file."""
    files = rendered(spark, sf_dir).withColumn("kind", F.regexp_extract("file", r"^[^.]*\.(.*)$", 1)).withColumn("own", F.regexp_extract("file", r"^S(\d+)", 1).cast("long"))
    text = F.col("text")
    for kind, (pattern, put, _) in DAMAGE.items():
        # the companion of a flat grid stays whole
        text = F.when((F.col("kind") == kind) & (F.col("own") % 3 == 0) & (F.col("own") % 10 == KINDS.index(kind)), F.regexp_replace("text", pattern, put)).otherwise(text)
    folder = f"{shared_folder(spark)}/damaged-{uuid.uuid4().hex}"
    stored(wr.write_files(files.select("file", text.alias("text")), folder))
    good, rejects = rd.read_checked(spark, folder)
    return rejects.select(F.lit("reject").alias("what"), F.col("file").alias("name"), "reason").unionByName(good.select(F.lit("structure").alias("what"), "name", F.lit(None).cast("string").alias("reason")))


#: Points of a grid along each axis, values of a part.
SHAPE, PART_VALUES = (3, 2, 4), 7


@query(f"""WITH g AS (SELECT s_suppkey AS structure_id, k, floor(s_acctbal) + k * (s_suppkey % 7) AS d FROM supplier, (SELECT unnest(range({SHAPE[0] * SHAPE[1] * SHAPE[2]})) AS k))
SELECT 'S' || structure_id AS name, CAST(k % {SHAPE[0]} AS INTEGER) AS u, CAST(k // {SHAPE[0]} % {SHAPE[1]} AS INTEGER) AS v, CAST(k // {SHAPE[0] * SHAPE[1]} AS INTEGER) AS w, round(greatest(d, 0), 6) + 0.0 AS density, {107 + 27 * SHAPE[0] * SHAPE[1] * SHAPE[2]} AS bytes FROM g""")
def export_flat_grid(spark, sf_dir):
    """Each supplier's grid in parts, joined to a file by the manifest, and read back."""
    nu, nv, nw = SHAPE
    k = F.col("k")
    grid = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("structure_id"), F.floor("s_acctbal").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(nu * nv * nw - 1))).alias("k"))
    grid = grid.select("structure_id", k.alias("point_id"), (k % nu / nu).alias("u"), (F.floor(k / nu) % nv / nv).alias("v"), (F.floor(k / (nu * nv)) / nw).alias("w"), (F.col("b") + k * (F.col("structure_id") % 7)).cast("double").alias("density"))
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    made = stored(wr.join_parts(stored(wr.write_parts(wr.grid_parts(grid, PART_VALUES), f"{folder}/parts")), f"{folder}/whole"))
    sizes = made.select(F.concat(F.lit("S"), F.col("structure_id").cast("string")).alias("name"), F.col("bytes").cast("int").alias("bytes"))
    return rd.read_flat_grid(spark, f"{folder}/whole").select("name", "u", "v", "w", *r6("density")).join(sizes, "name").select("name", "u", "v", "w", "density", "bytes")
