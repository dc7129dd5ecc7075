"""Periodic neighbours: image expansion, ball queries, k nearest, triplets.

Tables: cells (structure_id, ax..cz), atoms (structure_id, atom_index, species, u, v, w), centres (structure_id, centre_id, u, v, w
and whatever else they carry).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.functions.basis import rounded
from latticeworks.functions.geometry import CELL, angle, cartesian, heights, volume
from latticeworks.sources.store import stored

AXES = ("i", "j", "k")
#: Cells of at least so many bins of the cutoff's size are searched bin by bin.
MANY_BINS = 27


def _known(x: Column | str) -> Column:
    """A number that the rows' filter has found to be there; Spark leaves out its checks for nulls."""
    return F.coalesce(x, F.lit(0.0))


def images(atoms: DataFrame, cells: DataFrame, r_cut: float) -> DataFrame:
    """Every image of every atom in the cells that can lie within r_cut of the home cell, with its position x, y, z."""
    size = [(F.ceil(F.lit(r_cut) / h)).cast("int") for h in heights()]
    out = atoms.join(cells.select("structure_id", *CELL, *(n.alias(f"n{a}") for n, a in zip(size, AXES, strict=True))), "structure_id")
    for a in AXES:
        out = out.withColumn(a, F.explode(F.sequence(-F.col(f"n{a}"), F.col(f"n{a}"))))
    x, y, z = cartesian(F.col("u") + F.col("i"), F.col("v") + F.col("j"), F.col("w") + F.col("k"))
    return out.select(*atoms.columns, *AXES, x.alias("x"), y.alias("y"), z.alias("z"))


def neighbours(centres: DataFrame, atoms: DataFrame, cells: DataFrame, r_cut: float, self_below: float | None = 1e-6, told: tuple[str, ...] = ()) -> DataFrame:
    """All atom images within r_cut (inclusive) of each centre: the columns of centres without u, v, w, then neigh_index,
    neigh_species, the columns of atoms that are told of the neighbour, i, j, k, r and the unit vector ux, uy, uz. Pairs of at most
    self_below apart are left out.

    Positions must lie in [0, 1). Small cells are joined whole by structure, with exactly the images that can be near; cells of
    MANY_BINS bins or more are joined by structure and bin, so that work follows the atoms and no structure lands in one task. A flat cell
    has no neighbours. Without any large cell the pairs stay partitioned by structure, so that sums by atom need no shuffle of pairs.
    """
    geo = cells.select("structure_id", *CELL, *(x.alias(f"h{a}") for x, a in zip(heights(), AXES, strict=True)))
    geo = geo.select("*", *(F.greatest(F.lit(1), F.floor(F.col(f"h{a}") / r_cut)).cast("int").alias(f"n{a}") for a in AXES))
    # A filter by the sizes of cells would be moved below them, as a long formula that is inferred for atoms, too, where cells are made from
    # their structure_id. It is not moved below an explode, and left out where no cell is large.
    sized = geo.withColumn("many", F.explode(F.array(F.col("ni") * F.col("nj") * F.col("nk") >= MANY_BINS)))
    large = sized.where("many")
    mixed = not large.isEmpty()
    carried = [c for c in centres.columns if c not in ("structure_id", "u", "v", "w")]
    placed = "u + v + w IS NOT NULL"
    left = centres.where(placed).select("structure_id", *carried, *(_known(p).alias(f"c{p}") for p in "uvw"))
    right = atoms.where(placed).select("structure_id", F.col("atom_index").alias("neigh_index"), F.col("species").alias("neigh_species"), *told, *(_known(p).alias(f"n{p}") for p in "uvw"))
    parts = list(zip(AXES, "uvw", "abc", strict=True))
    keep = ["structure_id", *carried, "neigh_index", "neigh_species", *told, *AXES, *(f"d{x}" for x in "xyz")]

    def placed_at(pairs: DataFrame, a: str, p: str, vector: str) -> DataFrame:
        """pairs with the part of their difference along one of the cell's vectors added to dx, dy, dz."""
        step = F.col(f"n{p}") + F.col(a) - F.col(f"c{p}")
        part = {f"d{x}": step * F.col(f"{vector}{x}") for x in "xyz"}
        return pairs.withColumns({d: F.col(d) + x if d in pairs.columns else x for d, x in part.items()})

    def near(pairs: DataFrame) -> DataFrame:
        r = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
        return pairs.select(*keep).where((r <= r_cut) & (r > self_below) if self_below is not None else r <= r_cut).select(*keep, r.alias("r"))

    reach = [_known(F.lit(r_cut) / F.col(f"h{a}")).alias(f"h{a}") for a in AXES]
    small = sized.where(~F.col("many")) if mixed else geo
    whole = left.join(small.select("structure_id", *(_known(c).alias(c) for c in CELL), *reach), "structure_id").join(right, "structure_id")
    for a, p, vector in parts:
        gap = F.col(f"n{p}") - F.col(f"c{p}")
        low, high = F.ceil(-F.col(f"h{a}") - gap - 1e-9).cast("int"), F.floor(F.col(f"h{a}") - gap + 1e-9).cast("int")
        whole = placed_at(whole.withColumn(a, F.explode(F.sequence(low, F.greatest(low, high)))), a, p, vector)
    found = near(whole)

    if mixed:
        spread = left.join(large, "structure_id")
        for a, p, _ in parts:
            offsets = F.ceil(F.lit(r_cut) / F.col(f"h{a}") * F.col(f"n{a}")).cast("int")
            spread = spread.withColumn(f"o{a}", F.explode(F.sequence(-offsets, offsets))).withColumn(f"t{a}", F.col(f"o{a}") + F.floor(F.col(f"c{p}") * F.col(f"n{a}")).cast("int"))
            spread = spread.withColumn(a, F.floor(F.col(f"t{a}") / F.col(f"n{a}")).cast("int")).withColumn(f"b{a}", F.pmod(f"t{a}", f"n{a}"))
        binned = right.join(large.select("structure_id", *(f"n{a}" for a in AXES)), "structure_id")
        binned = binned.select(*right.columns, *(F.floor(F.col(f"n{p}") * F.col(f"n{a}")).cast("int").alias(f"b{a}") for a, p, _ in parts))
        spread = spread.join(binned, ["structure_id", "bi", "bj", "bk"])
        for a, p, vector in parts:
            spread = placed_at(spread, a, p, vector)
        found = found.unionByName(near(spread))

    unit = [F.when(F.col("r") > 0, F.col(f"d{c}") / F.col("r")).otherwise(0.0).alias(f"u{c}") for c in "xyz"]
    return found.select(*keep[:-3], "r", *unit)


def atom_centres(atoms: DataFrame) -> DataFrame:
    return atoms.select("structure_id", F.col("atom_index").alias("centre_id"), F.col("species").alias("centre_species"), "u", "v", "w")


def ranked(near: DataFrame, by: list[str]) -> DataFrame:
    """near with each neighbour's rank by distance; distances that differ by noise only are ties, which the other columns order."""
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(rounded(F.col("r"), 8), "neigh_species", "neigh_index", "i", "j", "k")))


def k_nearest(centres: DataFrame, atoms: DataFrame, cells: DataFrame, k: int, r_first: float, by: list[str]) -> DataFrame:
    """The k nearest images of each centre, in rank order.

    Centres with fewer than k in the first radius are searched again with twice the radius, and so on until all are full, so that only
    they pay for a wide search. A structure with an atom has any number of images within reach; centres of structures without atoms or
    cell, of a flat cell, or without a position, have no neighbours.
    """
    whole = atoms.select("structure_id").intersect(cells.where(volume() > 0).select("structure_id"))
    todo, found, r = centres.where("u + v + w IS NOT NULL").join(whole, "structure_id", "left_semi"), None, r_first
    while True:
        near = stored(ranked(neighbours(todo, atoms, cells, r), by).where(F.col("rank") <= k))
        full = near.where(F.col("rank") == k).select(*by)
        done = near.join(full, by, "left_semi")
        found = done if found is None else found.unionByName(done)
        todo = todo.join(full, by, "left_anti")
        if todo.isEmpty():
            return found
        r *= 2


def triplets(near: DataFrame, by: list[str], r_ani: float) -> DataFrame:
    """Unordered pairs of a centre's neighbours nearer than r_ani (strict): sp0 <= sp1, their distances and the angle between them.
    Of two of one species the nearer comes first.

    A centre's neighbours within r_ani are few, so they are gathered in order and paired in place; the neighbour table is read once.
    """
    order = F.struct(rounded(F.col("r"), 8).alias("r8"), "neigh_species", "neigh_index", "i", "j", "k", "r", "ux", "uy", "uz")
    own = near.where(F.col("r") < r_ani).groupBy(*by).agg(F.sort_array(F.collect_list(order)).alias("s")).where(F.size("s") > 1)
    firsts = own.select(*by, "s", F.posexplode("s").alias("at", "x"))
    both = firsts.select(*by, "x", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("y"))
    swap = F.col("y.neigh_species") < F.col("x.neigh_species")
    dot = F.col("x.ux") * F.col("y.ux") + F.col("x.uy") * F.col("y.uy") + F.col("x.uz") * F.col("y.uz")
    pick = lambda f, a, b, name: F.when(swap, F.col(f"{b}.{f}")).otherwise(F.col(f"{a}.{f}")).alias(name)
    return both.select(*by, pick("neigh_species", "x", "y", "sp0"), pick("neigh_species", "y", "x", "sp1"), pick("r", "x", "y", "r0"), pick("r", "y", "x", "r1"), angle(dot).alias("theta"))
