"""Operators over collections of structures: selection, merge, groups, checks, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.sources.store import stored


def shuffled(key: str, seed: int = 13) -> Column:
    """A fixed pseudo-random order of integer keys, in arithmetic that every SQL engine shares."""
    return (F.col(key) * 7919 + seed) % 1000003


def select_structures(structures: DataFrame, rules: list[tuple[str, tuple]], column: str = "name", seed: int = 13, exact: bool = True) -> DataFrame:
    """The union of what each rule picks among the structures whose column has its text.

    A rule is ("all",), ("uniform", n, "absolute") or ("uniform", share, "relative").
    """
    picked = None
    for text, how in rules:
        own = structures.where(F.col(column) == text if exact else F.col(column).contains(text))
        if how[0] == "uniform":
            if how[2] not in ("absolute", "relative"):
                raise ValueError(f"not a selection: {how}")
            if how[2] == "absolute":  # a top-k over shuffled keys: each task keeps its k
                own = own.orderBy(shuffled("structure_id", seed), "structure_id").limit(how[1])
            else:  # a share grows with the table: places are given by ranges of the shuffled keys
                n = int(how[1] * own.count())
                own = numbered(own.withColumn("_s", shuffled("structure_id", seed)), ["_s", "structure_id"], "_place").where(F.col("_place") <= n).drop("_s", "_place")
        elif how[0] != "all":
            raise ValueError(f"not a selection: {how}")
        picked = own if picked is None else picked.unionByName(own)
    return picked.dropDuplicates(["structure_id"])


def merge_by_precedence(parts: DataFrame, columns: list[str], key: str | list[str] = "name") -> DataFrame:
    """One row per key: of each column the first non-null value by prec, all files, and the number of codes, which should be 1."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("prec"))).alias(c) for c in columns]
    return parts.groupBy(*([key] if isinstance(key, str) else key)).agg(*first, F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"), F.count_distinct("code").alias("codes"))


def element_groups(atoms: DataFrame) -> DataFrame:
    """Every structure in group ALL, those of one species in its group too."""
    kinds = atoms.groupBy("structure_id").agg(F.count_distinct("species").alias("k"), F.min("species").alias("one"))
    return kinds.select("structure_id", F.explode(F.when(F.col("k") == 1, F.array("one", F.lit("ALL"))).otherwise(F.array(F.lit("ALL")))).alias("grp"))


def pair_domain(atoms: DataFrame) -> DataFrame:
    own = atoms.groupBy("structure_id").agg(F.array_sort(F.collect_set("species")).alias("s"))
    pairs = own.select("s").distinct().select(F.explode("s").alias("sp0"), "s").select("sp0", F.explode("s").alias("sp1")).where("sp0 <= sp1")
    return pairs.distinct()


def neighbour_statistics(near: DataFrame, by: list[str]) -> DataFrame:
    """Per centre and species, and for all species as `all`."""
    stats = near.groupingSets([[*(near[c] for c in by), near["neigh_species"]], [near[c] for c in by]], *by, "neigh_species")
    stats = stats.agg(F.count("*").alias("n"), F.min("r").alias("r_min"), F.sum("r").alias("r_sum"), F.sum("ux").alias("ux_sum"), F.sum("uy").alias("uy_sum"), F.sum("uz").alias("uz_sum"))
    return stats.withColumn("species", F.coalesce("neigh_species", F.lit("all"))).drop("neigh_species")


def numbered(df: DataFrame, by: str | list[str], name: str) -> DataFrame:
    """df with the place of each row in the order of columns of distinct values, from 1.

    Rows are dealt by ranges of the values, numbered inside their range and moved by the rows of the ranges before; the only window over
    everything is over one row per range. Ranges are sampled, so they are stored before they are counted.
    """
    by = [by] if isinstance(by, str) else by
    ranged = stored(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(*by)).cast("long"))
    return inside.join(F.broadcast(before), "_range").withColumn(name, F.col("_row") + F.col("_before")).drop("_range", "_row", "_before")


def virial(atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """The nine sums of r_i F_j over each structure's atoms."""
    from latticeworks.functions.geometry import cartesian

    r = dict(zip("xyz", cartesian(F.col("u"), F.col("v"), F.col("w")), strict=True))
    both = atoms.join(cells, "structure_id")
    return both.groupBy("structure_id").agg(F.count("*").alias("n_atoms"), *(F.sum(r[p] * F.col(f"f{q}")).alias(p + q) for p in "xyz" for q in "xyz"))


def checked(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with the name of the first rule that a row breaks, or `valid`; a rule on a null breaks too."""
    reason = F.lit("valid")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(reason)
    return rows.withColumn("reason", reason)
