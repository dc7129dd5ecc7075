"""The engine's tables over the given ones: structures, cells, atoms, grid points and vectors, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cutoffs in the queries; no distance of the tables lies on them.
R_CUT, R_ANI = 2.9137, 2.0137
#: A task sums its pairs by atom in hash tables of up to some 2 KB an atom, which would spill as a whole if they outgrew its memory.
ATOMS_A_TASK = 50_000
#: Reference energies, Lennard-Jones sigma and epsilon by species.
SPECIES = [("A", -2.0, 1.9, 0.12), ("N", -3.0, 2.1, 0.1), ("R", -1.5, 2.3, 0.08)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("structure_id"), F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("name"),
        (F.lit(3.2) + (F.col("o_orderkey") % 5) * 0.25).alias("a"), (-F.col("o_totalprice") / 10000).alias("energy"), F.col("o_orderstatus").alias("grp"),
    )


def sheared(a) -> list:
    zero = F.lit(0.0)
    return [x.alias(n) for x, n in zip((a, zero, zero, 0.1 * a, a, zero, zero, 0.2 * a, a), ("ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"), strict=True)]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures(spark, sf_dir).select("structure_id", *sheared(F.col("a")))


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks of about ATOMS_A_TASK atoms, so that the sums of a task fit its memory at any size of the tables."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // ATOMS_A_TASK))


def dealt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in the tasks of their atoms. What is dealt out is one number; the cell and all that a search derives of it are made there."""
    own = structures(spark, sf_dir).select("structure_id", "a").repartition(tasks(spark, sf_dir), "structure_id")
    return own.select("structure_id", *sheared(F.col("a")))


def dealt_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies of the structures in the tasks of their atoms."""
    return structures(spark, sf_dir).select("structure_id", "energy").repartition(tasks(spark, sf_dir), "structure_id")


def _place() -> list:
    return [
        ((F.col("l_partkey") % 97) / 97.0).alias("u"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 89 / 89.0).alias("v"),
        ((F.col("l_quantity").cast("long") * 11 + F.col("l_linenumber") * 17) % 83 / 83.0).alias("w"),
    ]


def atoms(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Whole structures by task. whole: numbered by all columns, so that every use of the atoms needs all of them and one exchange of the
    table serves all uses; rows that the order leaves tied have the same number in each use, too."""
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "structure_id")
    line = line.repartition(tasks(spark, sf_dir), "structure_id")
    order = Window.partitionBy("structure_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *(["l_quantity", "l_discount", "l_tax", "l_returnflag"] if whole else []))
    return line.select(
        "structure_id", (F.row_number().over(order) - 1).cast("long").alias("atom_index"), F.col("l_returnflag").alias("species"),
        *_place(),
        (F.col("l_discount") - 0.05).alias("fx"), (F.col("l_tax") - 0.04).alias("fy"), ((F.col("l_quantity") - 25) / 100).alias("fz"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where atoms are, without numbering them or dealing them out."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("structure_id"), *_place())


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The species that occur, without dealing out the atoms."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("species")).distinct()


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("point_id"), (F.col("event_id") % 1000).alias("structure_id"),
        (F.col("event_id") * 37 % 101 / 101.0).alias("u"), (F.col("event_id") * 53 % 103 / 103.0).alias("v"), (F.col("event_id") * 71 % 107 / 107.0).alias("w"), (F.col("value") / 100).alias("density"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("obs_id"), F.col("embedding").cast("array<double>").alias("phi"), F.col("label").cast("double").alias("t"))


def species(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPECIES, "species string, e_ref double, sigma double, eps double")


# The same tables as SQL for DuckDB; a query's SQL starts with the ones it needs.
_SQL = {
    "structures": """structures AS (SELECT o_orderkey AS structure_id, 'S' || CAST(o_orderkey AS VARCHAR) AS name, 3.2::DOUBLE + (o_orderkey % 5) * 0.25::DOUBLE AS a,
        -o_totalprice / 10000 AS energy, o_orderstatus AS grp FROM orders)""",
    "atoms": """atoms AS (SELECT l_orderkey AS structure_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS atom_index,
        l_returnflag AS species, (l_partkey % 97) / 97::DOUBLE AS u, ((l_suppkey * 7 + l_linenumber) % 89) / 89::DOUBLE AS v,
        ((CAST(l_quantity AS BIGINT) * 11 + l_linenumber * 17) % 83) / 83::DOUBLE AS w, l_discount - 0.05::DOUBLE AS fx, l_tax - 0.04::DOUBLE AS fy, (l_quantity - 25) / 100 AS fz FROM lineitem)""",
    "points": """points AS (SELECT event_id AS point_id, event_id % 1000 AS structure_id, ((event_id * 37) % 101) / 101::DOUBLE AS u, ((event_id * 53) % 103) / 103::DOUBLE AS v,
        ((event_id * 71) % 107) / 107::DOUBLE AS w, value / 100 AS density FROM events)""",
    "species": "species_ref(species, e_ref, sigma, eps) AS (VALUES " + ", ".join(f"('{s}', {e}::DOUBLE, {g}::DOUBLE, {p}::DOUBLE)" for s, e, g, p in SPECIES) + ")",
    "shifts": "shifts AS (SELECT i.i, j.j, k.k FROM (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j), (VALUES (-1), (0), (1)) k(k))",
    # every atom's neighbours, self excluded
    "near": f"""cand AS (SELECT c.structure_id, c.atom_index AS centre_id, c.species AS centre_species, n.atom_index AS neigh_index, n.species AS neigh_species, h.i, h.j, h.k, s.a,
        n.u + h.i - c.u AS du, n.v + h.j - c.v AS dv, n.w + h.k - c.w AS dw FROM atoms c JOIN atoms n USING (structure_id) JOIN structures s USING (structure_id), shifts h),
    vec AS (SELECT *, a * du + 0.1 * a * dv AS dx, a * dv + 0.2 * a * dw AS dy, a * dw AS dz FROM cand),
    near AS (SELECT structure_id, centre_id, centre_species, neigh_index, neigh_species, i, j, k, sqrt(dx * dx + dy * dy + dz * dz) AS r,
        dx / sqrt(dx * dx + dy * dy + dz * dz) AS ux, dy / sqrt(dx * dx + dy * dy + dz * dz) AS uy, dz / sqrt(dx * dx + dy * dy + dz * dz) AS uz
        FROM vec WHERE sqrt(dx * dx + dy * dy + dz * dz) <= {R_CUT} AND sqrt(dx * dx + dy * dy + dz * dz) > 1e-6)""",
    # atoms around grid points
    "pnear": f"""pcand AS (SELECT p.point_id, p.density, n.atom_index AS neigh_index, n.species AS neigh_species, h.i, h.j, h.k, s.a, p.structure_id,
        n.u + h.i - p.u AS du, n.v + h.j - p.v AS dv, n.w + h.k - p.w AS dw FROM points p JOIN atoms n USING (structure_id) JOIN structures s USING (structure_id), shifts h),
    pvec AS (SELECT *, a * du + 0.1 * a * dv AS dx, a * dv + 0.2 * a * dw AS dy, a * dw AS dz FROM pcand),
    pnear AS (SELECT point_id, density, structure_id, neigh_index, neigh_species, i, j, k, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM pvec
        WHERE sqrt(dx * dx + dy * dy + dz * dz) <= {R_CUT} AND sqrt(dx * dx + dy * dy + dz * dz) > 1e-6)""",
    "ranked": "ranked AS (SELECT *, row_number() OVER (PARTITION BY structure_id, centre_id ORDER BY round(r, 8), neigh_species, neigh_index, i, j, k) AS rank FROM near)",
    "ani": f"ani AS (SELECT *, row_number() OVER (PARTITION BY structure_id, centre_id ORDER BY round(r, 8), neigh_species, neigh_index, i, j, k) AS rank FROM near WHERE r < {R_ANI})",
    "triplets": """triplets AS (SELECT x.structure_id, x.centre_id, x.neigh_species AS sp0, y.neigh_species AS sp1, x.r AS r0, y.r AS r1,
        acos(least(1, greatest(-1, round(x.ux * y.ux + x.uy * y.uy + x.uz * y.uz, 10)))) AS theta FROM ani x JOIN ani y USING (structure_id, centre_id)
        WHERE x.neigh_species < y.neigh_species OR (x.neigh_species = y.neigh_species AND x.rank < y.rank))""",
    "vectors": "vectors AS (SELECT vec_id AS obs_id, CAST(embedding AS DOUBLE[]) AS phi, CAST(label AS DOUBLE) AS t FROM embeddings)",
}
_NEEDS = {"near": ["structures", "atoms", "shifts"], "pnear": ["structures", "atoms", "points", "shifts"], "ranked": ["near"], "ani": ["near"], "triplets": ["ani"]}


def with_views(names: str, body: str) -> str:
    """WITH clause of the named tables and all that they need, then body (which may go on with `, x AS (...) SELECT`)."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(_SQL[n] for n in order) + "\n" + body


def r6(*columns: str):
    """Rounded columns, without negative zeros."""
    return [(F.round(F.col(c), 6) + 0.0).alias(c) for c in columns]
