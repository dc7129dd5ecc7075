"""Choice of sample points: reproducible draws from integer hashes, and points near atoms.

A group (a structure's points) may be larger than a task: places are counted by ranges of the key, the first n of a group are found
among the first n of its shares, and nearness is searched by bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.functions.geometry import CELL, cartesian, heights, volume
from latticeworks.sources.lines import places
from latticeworks.sources.store import stored

#: Keys of a range, shares of a group.
RANGE, SHARES = 1 << 16, 64
#: Structures whose keys and cells are broadcast.
FEW = 1 << 16


def uniform(key: Column, seed: int = 0) -> Column:
    """A value in (0, 1) fixed by an integer key, in arithmetic that every SQL engine shares."""
    return ((key * 7919 + 104729 * (seed + 1)) % 1000003 + 0.5) / 1000003


def with_replacement(points: DataFrame, by: str, order: str, n: int, seed: int = 0) -> DataFrame:
    """n draws (capped at the group's size) of each group's points, with replacement: draw d takes the row at floor(u * size).

    Rows are numbered by ranges of the key (an integer column), then the draws are joined to them.
    """
    ranged = points.withColumn("_range", F.floor(F.col(order) / RANGE))
    numbered = places(ranged, [by], "_range", [order], "_at").withColumn("_at", F.col("_at") - 1).drop("_range")
    draws = points.groupBy(by).agg(F.count("*").alias("_n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_n")).cast("int") - 1)))
    draws = draws.withColumn("_at", F.floor(uniform(F.col("draw") * 31 + F.col(by), seed) * F.col("_n"))).drop("_n")
    return draws.join(numbered, [by, "_at"]).drop("_at")


def first_of_group(rows: DataFrame, by: list[str], order: list, n: int, shares: int = SHARES) -> DataFrame:
    """The n first rows of each group: those of the n first of each of its shares. What meets in a task is n rows a share, not a group."""
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.lit(shares)))
    local = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_share").orderBy(*order))).where(F.col("_r") <= n)
    return local.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_share", "_r")


def by_importance(points: DataFrame, by: str, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n points of each group without replacement, likelier the larger weight - min(weight) is: the n least -ln(u) / w, a reservoir that
    merges."""
    low = points.groupBy(by).agg(F.min(weight).alias("_low"))
    w = F.col(weight) - F.col("_low")
    score = F.when(w > 0, F.round(-F.log(uniform(F.col(key), seed)) / w, 9)).otherwise(F.lit(float("inf")))
    return first_of_group(points.join(low, by).withColumn("_s", score).drop("_low"), [by], ["_s", key], n).drop("_s")


def subsample(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, in a fixed pseudo-random order."""
    return first_of_group(rows, [by], [(F.col(key) * 7919 + seed) % 1000003, F.col(key)], n)


def _binned(points: DataFrame, atoms: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, list[Column]]:
    """(points by bin, atoms by bin with reach, the conditions under which a point lies within an atom's reach).

    cells carries reach. Space is cut into bins at least twice as wide as the reach, so that an atom goes to the two bins along an axis that
    its reach can meet, eight in all. An axis that has room for one bin only is not cut: no atom is copied along it.
    """
    count = [F.greatest(F.lit(1.0), F.floor(F.least(F.coalesce(h / (2 * F.col("reach")), F.lit(1.0)), F.lit(1e6)))) for h in heights()]
    side = [F.coalesce(F.col("reach") / h, F.lit(0.0)) for h in heights()]
    geo = cells.select("structure_id", "reach", *CELL, *(c.alias(f"n{x}") for c, x in zip(count, "uvw", strict=True)), *(c.alias(f"s{x}") for c, x in zip(side, "uvw", strict=True)))
    key = ["structure_id", "bu", "bv", "bw"]
    at = lambda x, shift=0.0: F.when(F.col(f"n{x}") > 1, F.floor((F.col(x) + shift) * F.col(f"n{x}"))).otherwise(F.lit(0)).cast("long")
    homes = points.select("structure_id", "point_id", "u", "v", "w").join(geo.select("structure_id", "nu", "nv", "nw"), "structure_id")
    homes = homes.select("structure_id", "point_id", "u", "v", "w", *(at(x).alias(f"b{x}") for x in "uvw"))
    around = atoms.join(geo, "structure_id")
    for x in "uvw":
        around = around.withColumn(f"b{x}", F.explode(F.sequence(at(x, -F.col(f"s{x}") - 1e-9), at(x, F.col(f"s{x}") + 1e-9))))
    around = around.select(*(F.col(k).alias(f"{k}_") for k in key), *(c for c in atoms.columns if c not in ("structure_id", "u", "v", "w")), "reach", *CELL, *(F.col(x).alias(f"a{x}_") for x in "uvw"))
    return homes, around, [*(F.col(k) == F.col(f"{k}_") for k in key), _distance() <= F.col("reach")]


def _distance() -> Column:
    return F.sqrt(sum((x * x for x in cartesian(*(F.col(f"a{x}_") - F.col(x) for x in "uvw"))), F.lit(0.0)))


def within_reach(points: DataFrame, atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """(structure_id, point_id, atom_index, reach, r) of points and atoms of a home cell, without images, at most the structure's reach apart.

    cells carries reach. Points and atoms meet by bins, so that work follows the points near atoms and one large structure spreads over
    many tasks.
    """
    homes, around, met = _binned(points, atoms.select("structure_id", "atom_index", "u", "v", "w"), cells)
    return homes.join(around, met).select("structure_id", "point_id", "atom_index", "reach", _distance().alias("r"))


def near_atoms(points: DataFrame, atoms: DataFrame, cells: DataFrame, r: float) -> DataFrame:
    """(structure_id, point_id) of the points within r of an atom of the home cell. A point is kept for the first atom that is near it; pairs
    are not made.

    Where at most FEW structures have points, the atoms of all others are dropped where they are read.
    """
    own = points.select("structure_id").distinct()
    atoms, cells = atoms.select("structure_id", "u", "v", "w"), cells.withColumn("reach", F.lit(float(r)))
    if own.limit(FEW + 1).count() <= FEW:
        atoms, cells = (t.join(F.broadcast(own), "structure_id", "left_semi") for t in (atoms, cells))
        cells = F.broadcast(cells)
    homes, around, met = _binned(points, atoms, cells)
    return homes.join(around, met, "left_semi").select("structure_id", "point_id").distinct()


def nearest_of_atoms(points: DataFrame, atoms: DataFrame, cells: DataFrame, n: int, ties: bool = False) -> DataFrame:
    """(structure_id, point_id) of the n nearest points of each atom; with ties, all points as near as the nearest.

    A structure's first reach is that of a ball with some times n points at its mean density. Atoms that have fewer within it are searched
    again with twice the reach, until it spans the cell; so only they pay for a wide search. The nearest of an atom are merged from the
    nearest of tasks (a window with a group limit).
    """
    sizes = points.groupBy("structure_id").agg(F.count("*").alias("_n"))
    ball = F.pow(F.lit(4.0 * n) * volume() * 3 / (4 * 3.141592653589793 * F.col("_n")), 1 / 3)
    across = sum((F.sqrt(sum((F.col(f"{p}{d}") * F.col(f"{p}{d}") for d in "xyz"), F.lit(0.0))) for p in "abc"), F.lit(0.0))
    spread = points.groupBy("structure_id").agg(F.max(F.greatest(*(F.abs(x) for x in "uvw"))).alias("_p"))
    wide = atoms.groupBy("structure_id").agg(F.max(F.greatest(*(F.abs(x) for x in "uvw"))).alias("_a"))
    geo = cells.join(sizes, "structure_id").join(spread, "structure_id").join(wide, "structure_id")
    geo = geo.withColumn("_most", across * (F.col("_p") + F.col("_a") + 1)).withColumn("reach", F.least("_most", F.greatest(ball, F.col("_most") * 1e-6))).where("reach > 0")
    geo = stored(geo.select("structure_id", *CELL, "reach", "_most"))
    todo, found = atoms.select("structure_id", "atom_index", "u", "v", "w").join(geo.select("structure_id"), "structure_id", "left_semi"), None
    order = Window.partitionBy("structure_id", "atom_index").orderBy(*([F.round("r", 8)] if ties else [F.round("r", 8), "point_id"]))
    while True:
        near = within_reach(points, todo, geo).withColumn("_p", (F.rank() if ties else F.row_number()).over(order)).where(F.col("_p") <= (1 if ties else n))
        near = stored(near.join(geo.select("structure_id", "_most"), "structure_id"))
        # what lies at the very edge of the reach may have a tie beyond it
        full = near.groupBy("structure_id", "atom_index").agg(F.count_if(F.col("r") < F.col("reach") - 1e-7).alias("_c"), F.max(F.col("reach") >= F.col("_most")).alias("_all"))
        full = full.where(F.col("_all") | (F.col("_c") >= (1 if ties else n))).select("structure_id", "atom_index")
        done = near.join(full, ["structure_id", "atom_index"], "left_semi").select("structure_id", "point_id")
        found = done if found is None else found.unionByName(done)
        todo = stored(todo.join(full, ["structure_id", "atom_index"], "left_anti").join(geo.where("reach < _most").select("structure_id"), "structure_id", "left_semi"))
        if todo.isEmpty():
            return found.distinct()
        geo = geo.withColumn("reach", F.least(F.col("reach") * 2, F.col("_most")))


def shift_positive(df: DataFrame, column: str, margin: float = 1e-6) -> DataFrame:
    """If any value is negative, all less (the least - margin)."""
    low = df.agg(F.min(column).alias("_low"))
    return df.join(F.broadcast(low)).withColumn(column, F.when(F.col("_low") < 0, F.col(column) - (F.col("_low") - margin)).otherwise(F.col(column))).drop("_low")
