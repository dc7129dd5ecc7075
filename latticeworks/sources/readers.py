"""Readers of simulation output: single-point logs, trajectories, grid densities, orbital-free logs, cell files, XML runs.

Each gives structures (name, ext, prec, code, cell, species, positions, forces, stress, energy, enthalpy, files) or grid points;
what a file lacks is null. Files of a kind are read in one plan, however many there are. `read_directory` dispatches on the extension
and merges partial records of one name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticeworks.operators.structures import merge_by_precedence

from .lines import frames, gathered, in_order, in_splits, leading, nth, numbers, places, read_lines, scan_text, tag_blocks, words
from .store import stored

#: CODATA 2002 units, as the trajectory files' writer uses them.
HARTREE, BOHR, GPA = 27.2113845, 0.5291772108, 29421.0124
#: Order of precedence of the files of a structure, first is best.
PRECEDENCE = {"geom": 0, "md": 1, "castep": 2, "den_fmt": 3, "profess": 0, "den": 1, "final.geom": 2, "ion": 3, "xml": 0, "contcar": 1}
CODES = {"geom": "castep", "md": "castep", "castep": "castep", "den_fmt": "castep", "profess": "profess", "den": "profess", "final.geom": "profess", "ion": "profess", "xml": "vasp", "contcar": "vasp"}
#: Structure fields that a reader may fill, besides name, ext and files.
FIELDS = {"cell": "array<array<double>>", "species": "array<string>", "positions": "array<array<double>>", "forces": "array<array<double>>", "stress": "array<array<double>>", "energy": "double", "enthalpy": "double", "spacegroup": "string", "grid": "array<int>", "n_points": "bigint"}


def _structures(df: DataFrame, ext: str) -> DataFrame:
    have = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in FIELDS.items()]
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    return df.select(folder.alias("folder"), "name", F.lit(ext).alias("ext"), F.lit(PRECEDENCE[ext]).alias("prec"), F.lit(CODES[ext]).alias("code"), *have, F.array(F.regexp_extract("file", r"([^/]*)$", 1)).alias("files"))


def _inverse(cell: Column, x: Column) -> Column:
    """Fractional coordinates of a Cartesian row vector; null for a flat cell."""
    c = lambda i, j: nth(nth(cell, i % 3), j % 3)
    minor = lambda i, j: c(i + 1, j + 1) * c(i + 2, j + 2) - c(i + 1, j + 2) * c(i + 2, j + 1)
    det = c(0, 0) * minor(0, 0) + c(0, 1) * minor(0, 1) + c(0, 2) * minor(0, 2)
    return F.array(*(F.try_divide(nth(x, 0) * minor(k, 0) + nth(x, 1) * minor(k, 1) + nth(x, 2) * minor(k, 2), det) for k in range(3)))


ENERGIES = {
    "total": "Final energy, E", "plain": "Final energy =", "zero_k": "NB est. 0K energy (E-0.5TS)", "sedc": "Dispersion corrected final energy",
    "sedc_zero_k": "NB dispersion corrected est. 0K energy", "basis": "Total energy corrected for finite basis set",
}


FRACTIONAL = r"^\s*x\s+([A-Z][A-Za-z]?)\s+\d+\s+[-+.\d]+\s+[-+.\d]+\s+[-+.\d]+\s+x"
PUSH = r"^\s*\*\s+([A-Z][A-Za-z]?)\s+\d+\s+[-+.\d]+\s+[-+.\d]+\s+[-+.\d]+"
DYNAMICS = "molecular dynamics"


def log_blocks(lines: DataFrame) -> DataFrame:
    """The last calculation of each log as tagged lines with kind, the calculation's, and what a data line holds: v, three numbers, and
    sp, a species. A line that begins a run is a marker like others, and what a file's last one is comes with the sums of its splits."""
    line, key = F.col("line"), ["file", "split"]
    rows = in_splits(lines).withColumn("_run", line.contains("Run started")).withColumn("_kind", F.nullif(F.lower(F.regexp_extract("line", r"type of calculation\s*:\s*(.*\S)", 1)), F.lit("")))
    last = lambda test: F.max(F.when(test, F.col("pos")))
    told = rows.groupBy(*key).agg(last(F.col("_run")).alias("start"), F.max(F.when(F.col("_kind").isNotNull(), F.struct("pos", "_kind"))).alias("kind"))
    whole = Window.partitionBy("file")  # a row for each split
    told = told.select(*key, F.max("start").over(whole).alias("_start"), F.max("kind").over(whole).alias("_told"))
    rows = rows.join(told, key).where("_start IS NULL OR pos >= _start").withColumn("kind", F.when(F.col("_start").isNull() | (F.col("_told.pos") >= F.col("_start")), F.col("_told._kind")))
    tagged = tag_blocks(rows.drop("_run", "_kind", "_start", "_told"), {"cell": line.contains("Real Lattice(A)"), "atoms": line.contains("Fractional coordinates of atoms"), "forces": line.rlike(r"\*+ (Symmetrised |Constrained |Unconstrained )*Forces \*+"), "stress": line.rlike(r"\*+ (Symmetrised )?Stress Tensor \*+"), "other": line.contains("Lattice parameters(A)") | line.contains("Pressure:")})
    block, n = F.col("block"), numbers(line)
    holds = F.when((block == "cell") & F.col("since").between(1, 3), leading(line)).when((block == "atoms") & line.rlike(FRACTIONAL), F.slice(n, 2, 3)).when((block == "forces") & line.rlike(PUSH), F.slice(n, 2, 3))
    holds = holds.when((block == "stress") & line.rlike(r"^\s*\*\s+[xyz]\s+[-+.\d]"), F.slice(n, 1, 3))
    return tagged.withColumn("v", holds).withColumn("sp", F.regexp_extract("line", FRACTIONAL, 1))


def log_structures(lines: DataFrame) -> DataFrame:
    """The last calculation of each single-point or geometry log, and every step of a log of molecular dynamics (see log_steps).

    Energy: the dispersion-corrected 0 K value, or the basis-set correction that follows it; else the 0 K estimate; else the plain
    final energy. Energies of a basis-set convergence run come first and are never the last ones. Lines are gathered by block, and of a
    file's blocks of a kind the last one counts.
    """
    tagged = log_blocks(lines)
    one = tagged.where(F.coalesce(F.col("kind") != DYNAMICS, F.lit(True)))
    line = F.col("line")
    value = lambda text: F.max(F.when(line.contains(text), F.struct("pos", nth(numbers(F.regexp_extract("line", r"=(.*)$", 1)), 0).alias("x"))))
    said = {**ENERGIES, "enthalpy": "Final Enthalpy"}
    parts = one.groupBy("file", "name", "block", "block_no").agg(
        in_order(F.col("v"), F.col("v").isNotNull()).alias("v"), in_order(F.col("sp"), F.col("v").isNotNull()).alias("sp"), *(value(t).alias(n) for n, t in said.items()), F.max(F.regexp_extract("line", r"Space group of crystal =\s*\d+:\s*([^,]+)", 1)).alias("spacegroup")
    )
    newest = lambda c, block: F.max_by(c, F.when((F.col("block") == block) & F.col("v").isNotNull(), F.col("block_no")))
    made = parts.groupBy("file", "name").agg(
        newest("v", "cell").alias("cell"), newest("v", "atoms").alias("positions"), newest("sp", "atoms").alias("species"), newest("v", "forces").alias("forces"), newest("v", "stress").alias("stress"), *(F.max(n)["x"].alias(n) for n in said), F.max("spacegroup").alias("spacegroup")
    )
    made = made.withColumn("energy", F.coalesce(F.when(F.col("sedc_zero_k").isNotNull() & F.col("basis").isNotNull(), F.col("basis")), "sedc_zero_k", "zero_k", "plain", "total")).withColumn("spacegroup", F.nullif("spacegroup", F.lit("")))
    return _structures(made, "castep").unionByName(log_steps(tagged.where(F.col("kind") == DYNAMICS)))


def log_steps(tagged: DataFrame) -> DataFrame:
    """A structure named <file's name>-<n> for each step of the logs of molecular dynamics among log_blocks.

    What is printed before the first step (positions, energies, forces, stress) is dropped, of force blocks that are the same
    throughout only the last one counts, a single stress belongs to no step, and a single cell belongs to all steps.
    """
    line = F.col("line")
    blocks = tagged.where("v IS NOT NULL").groupBy("file", "name", "block", "block_no").agg(in_order(F.col("v")).alias("v"), in_order(F.col("sp")).alias("sp"), F.min("split").alias("split"))
    again = F.row_number().over(Window.partitionBy("file", "block", F.when(F.col("block") == "forces", F.xxhash64("v")).otherwise(F.col("block_no"))).orderBy(F.col("block_no").desc()))
    blocks = blocks.withColumn("again", again).where("again = 1").select("file", "name", "block", "block_no", "split", "v", "sp")
    counted = places(blocks, ["file", "block"], "split", ["block_no"], "n").withColumn("n", F.col("n") - 1)
    energy = tagged.select("file", "split", "pos", *(F.when(line.contains(t), nth(numbers(F.regexp_extract("line", r"=(.*)$", 1)), 0)).alias(n) for n, t in (("zero_k", ENERGIES["zero_k"]), ("sedc_zero_k", ENERGIES["sedc_zero_k"]), ("plain", ENERGIES["plain"]))))
    best = lambda c: places(energy.where(f"{c} IS NOT NULL"), ["file"], "split", ["pos"], "n").select("file", F.lit(c).alias("c"), F.col(c).alias("e"), (F.col("n") - 1).alias("n"))
    energies = best("sedc_zero_k").unionAll(best("zero_k")).unionAll(best("plain")).groupBy("file", "n").agg(F.min_by("e", F.when(F.col("c") == "sedc_zero_k", 0).when(F.col("c") == "zero_k", 1).otherwise(2)).alias("energy"))
    step = lambda block: F.when((F.col("block") == block), F.col("v"))
    whole = counted.where("n > 0 AND block <> 'cell'").groupBy("file", "name", "n").agg(F.max(step("atoms")).alias("positions"), F.max(F.when(F.col("block") == "atoms", F.col("sp"))).alias("species"), F.max(step("forces")).alias("forces"), F.max(step("stress")).alias("stress")).where("positions IS NOT NULL")
    cells = counted.where("block = 'cell'")
    moving, fixed = cells.select("file", "n", F.col("v").alias("own_cell")), cells.groupBy("file").agg(F.count("*").alias("all"), F.first("v").alias("one_cell")).where("all = 1").drop("all")
    made = whole.join(energies, ["file", "n"], "left").join(moving, ["file", "n"], "left").join(fixed, "file", "left").withColumn("cell", F.coalesce("one_cell", "own_cell"))
    return _structures(made.withColumn("name", F.concat_ws("-", "name", F.col("n").cast("string"))), "castep")


def trajectory(lines: DataFrame, ext: str = "md", drop_first: bool = True, last_only: bool = False) -> DataFrame:
    """A structure for each frame of tagged lines in atomic units: E energy, h cell, S stress, R positions, F forces.

    Structures are named <file's name>-<n>, counted from 1 after the first frame is dropped; last_only keeps the final frame under
    the file's name. A frame without positions (the header) is none.
    """
    tag = F.regexp_extract("line", r"<--\s*(\w)\s*$", 1)
    rows = frames(lines).withColumn("tag", tag).where(F.col("tag").isin("E", "h", "S", "R", "F"))
    rows = rows.withColumn("n", numbers(F.col("line"))).withColumn("sp", nth(words(F.col("line")), 0))
    scaled = lambda first, factor: F.transform(F.slice("n", first, 3), lambda x: x * factor)
    of = lambda t: F.col("tag") == t
    made = rows.groupBy("file", "name", "frame").agg(
        F.min("split").alias("split"), F.count_if(of("R")).alias("n_r"), in_order(scaled(2, BOHR), of("R")).alias("xyz"), in_order(F.col("sp"), of("R")).alias("species"), in_order(scaled(1, BOHR), of("h")).alias("cell"),
        in_order(scaled(1, GPA), of("S")).alias("stress"), in_order(scaled(2, HARTREE / BOHR), of("F")).alias("forces"), (F.min_by(nth(F.col("n"), 0), F.when(of("E"), F.col("pos"))) * HARTREE).alias("energy"),
    )
    made = made.where("n_r > 0")
    if last_only:
        newest = made.groupBy("file").agg(F.max("frame").alias("frame"))
        made = made.join(newest, ["file", "frame"], "left_semi")
    else:
        made = places(made, ["file"], "split", ["frame"], "_n").withColumn("_n", F.col("_n") - int(drop_first)).where("_n >= 1").withColumn("name", F.concat_ws("-", "name", "_n"))
    return _structures(made.withColumn("positions", F.transform("xyz", lambda x: _inverse(F.col("cell"), x))), ext)


GRID_ROW = r"^\s*\d+\s+\d+\s+\d+\s+[-+.\deEdD]+\s*$"


def grid_density(lines: DataFrame) -> DataFrame:
    """(name, file, a, b, c, x, y, z, raw, density, n1, n2, n3, cell) of grid files: x = ((a, b, c) - 1) / n times the cell."""
    lines = in_splits(lines)
    tagged = tag_blocks(lines, {"cell": F.col("line").contains("Real Lattice(A)"), "data": F.col("line").contains("END header"), "grid": F.col("line").contains("FFT grid")})
    row = leading(F.col("line"))
    cell = (F.col("block") == "cell") & F.col("since").between(1, 3)
    head = tagged.where(cell | F.col("line").contains("FFT grid")).groupBy("file").agg(in_order(row, cell).alias("cell"), F.max_by(row, F.when(F.col("line").contains("FFT grid"), F.col("pos"))).alias("n")).where("cell IS NOT NULL AND n IS NOT NULL")
    rows = tagged.where((F.col("block") == "data") & F.col("line").rlike(GRID_ROW)).select("file", "name", "split", numbers(F.col("line")).alias("v"))
    # a file's head goes to each of its splits, so that its rows stay spread
    heads = lines.select("file", "split").distinct().join(head, "file")
    both = rows.join(heads, ["file", "split"])
    f = [F.try_divide(nth(F.col("v"), k) - 1, nth(F.col("n"), k)) for k in range(3)]
    c = lambda i, j: nth(nth(F.col("cell"), i), j % 3)
    xyz = [sum((f[k] * c(k, d) for k in range(3)), F.lit(0.0)) for d in range(3)]
    det = sum((c(0, i) * (c(1, i + 1) * c(2, i + 2) - c(1, i + 2) * c(2, i + 1)) for i in range(3)), F.lit(0.0))
    index = [nth(F.col("v"), k).try_cast("int").alias(n) for k, n in enumerate("abc")]
    return both.select("name", "file", *index, *(x.alias(d) for x, d in zip(xyz, "xyz", strict=True)), nth(F.col("v"), 3).alias("raw"), F.try_divide(nth(F.col("v"), 3), F.abs(det)).alias("density"), *(nth(F.col("n"), k).try_cast("int").alias(f"n{k + 1}") for k in range(3)), "cell")


def thinned(grid: DataFrame, least: float = 1.0) -> DataFrame:
    return grid.where(F.col("raw") >= least)


def profess_structures(lines: DataFrame) -> DataFrame:
    """Orbital-free logs: final energy, last cell and stress, forces in eV/A."""
    line = F.col("line")
    tagged = tag_blocks(lines, {"energies": line.contains("FINAL ENERGIES"), "forces": line.contains("TOTAL-FORCE (eV/A)"), "cell": line.contains("LATTICE VECTORS"), "stress": line.contains("STRESS (GPa)"), "other": line.contains("TOTAL-FORCE (Hartree/Bohr)") | line.contains("STRESS (a.u.)")})
    tests = {"energies": r"^#\s+TOTAL ENERGY", "forces": r"^:\s*[A-Z][a-z]?\s+\d+\s", "cell": r"^\s*LAT\s+\d", "stress": r"^\s*ST_GPa\s+\d"}
    row = F.lit(False)
    for block, test in tests.items():
        row = row | ((F.col("block") == block) & line.rlike(test))
    held = tagged.withColumn("row", F.coalesce(row, F.lit(False)))
    three = F.slice(numbers(line), 2, 3)
    parts = held.where("row").groupBy("file", "name", "block", "block_no").agg(in_order(three).alias("v"), in_order(nth(words(line), 1)).alias("sp"), F.max(F.struct("pos", nth(numbers(F.regexp_extract("line", r"=(.*)$", 1)), 0).alias("x"))).alias("e"))
    newest = lambda c, block: F.max_by(c, F.when(F.col("block") == block, F.col("block_no")))
    made = parts.groupBy("file", "name").agg(newest("e.x", "energies").alias("energy"), newest("v", "forces").alias("forces"), newest("sp", "forces").alias("species"), newest("v", "cell").alias("cell"), newest("v", "stress").alias("stress"))
    whole = lines.select("file", "name").distinct().join(made, ["file", "name"], "left")
    return _structures(whole, "profess")


def cell_file(lines: DataFrame, ext: str = "ion") -> DataFrame:
    """%BLOCK sections: the cell, and positions that are fractional or Cartesian."""
    upper = F.upper("line")
    tagged = tag_blocks(lines, {"cell": upper.rlike(r"^\s*%BLOCK LATTICE_CART"), "frac": upper.rlike(r"^\s*%BLOCK POSITIONS_FRAC"), "abs": upper.rlike(r"^\s*%BLOCK POSITIONS_(ABS|CART)"), "other": upper.rlike(r"^\s*%(END)?BLOCK") & ~upper.rlike(r"^\s*%BLOCK (LATTICE_CART|POSITIONS)")})
    rows = tagged.withColumn("w", words(F.col("line"))).withColumn("data", (F.col("since") > 0) & (F.size("w") > 0))
    place = lambda first: F.transform(F.slice("w", first, 3), lambda x: x.try_cast("double"))
    cell = F.col("data") & (F.col("block") == "cell") & (F.size("w") >= 3)
    atom = F.col("data") & F.col("block").isin("frac", "abs") & (F.size("w") >= 4)
    made = rows.groupBy("file", "name").agg(in_order(place(1), cell).alias("cell"), in_order(place(2), atom).alias("xyz"), in_order(nth(F.col("w"), 0), atom).alias("species"), F.max(F.when(atom, F.col("block"))).alias("kind"))
    return _structures(made.withColumn("positions", F.when(F.col("kind") == "abs", F.transform("xyz", lambda x: _inverse(F.col("cell"), x))).otherwise(F.col("xyz"))), ext)


def coordinate_file(lines: DataFrame) -> DataFrame:
    """Coordinate files: comment, scale, three vectors, species, counts, Direct or Cartesian, one position a line.

    The line of species may be missing (then species are numbered from 1), and a line that begins with S (selective dynamics) may come
    before the mode; what follows a position on its line is left out. A negative scale is the cell's volume. Cartesian positions are not scaled. What is no number is null.
    """
    upto = range(1, 9)
    head = lines.where(F.col("pos").isin(*upto)).groupBy("file", "name").agg(*(F.max(F.when(F.col("pos") == k, F.trim("line"))).alias(f"l{k}") for k in upto))
    named = F.col("l5").rlike("[A-Za-z]")
    counts = F.transform(words(F.when(named, F.col("l6")).otherwise(F.col("l5"))), lambda x: x.try_cast("int"))
    after = F.when(named, F.col("l7")).otherwise(F.col("l6"))
    selective = F.lower(F.substring(after, 1, 1)) == "s"
    mode = F.when(selective, F.when(named, F.col("l8")).otherwise(F.col("l7"))).otherwise(after)
    kinds = F.when(named, words(F.col("l5"))).otherwise(F.transform(F.sequence(F.lit(1), F.size(counts)), lambda x: x.cast("string")))
    scale, vectors = F.col("l1").try_cast("double"), [leading(F.col(f"l{k}")) for k in (2, 3, 4)]
    head = head.select("file", "name", F.array(*vectors).alias("raw"), scale.alias("scale"), kinds.alias("kinds"), counts.alias("counts"), F.lower(F.substring(mode, 1, 1)).alias("mode"), (F.lit(7) + F.coalesce(named, F.lit(True)).cast("int") + F.coalesce(selective, F.lit(False)).cast("int")).alias("from"))
    c = lambda i, j: nth(nth(F.col("raw"), i), j % 3)
    minor = lambda i: c(1, i + 1) * c(2, i + 2) - c(1, i + 2) * c(2, i + 1)
    volume = F.abs(c(0, 0) * minor(0) + c(0, 1) * minor(1) + c(0, 2) * minor(2))
    factor = F.when(F.col("scale") < 0, F.pow(F.try_divide(-F.col("scale"), volume), 1 / 3)).otherwise(F.col("scale"))
    copies = F.transform(F.arrays_zip(F.col("kinds").alias("s"), F.col("counts").alias("n")), lambda x: F.when(x["s"].isNotNull() & (x["n"] >= 0), F.array_repeat(x["s"], x["n"])))
    head = head.withColumn("factor", factor).withColumn("species", F.flatten(copies))
    head = head.withColumn("cell", F.when(F.forall("raw", lambda r: F.size(r) == 3), F.transform("raw", lambda r: F.transform(r, lambda x: x * F.col("factor")))))
    rows = lines.where("pos >= 6").withColumn("w", words(F.col("line"))).where(F.size("w") >= 3).join(head.select("file", "from"), "file").where(F.col("pos") >= F.col("from"))
    rows = rows.withColumn("v", F.transform(F.slice("w", 1, 3), lambda x: x.try_cast("double")))
    made = head.join(gathered(rows, ["file"], "pos", "v", "xyz"), "file", "left").withColumn("xyz", F.slice("xyz", F.lit(1), F.greatest(F.size("species"), F.lit(0))))
    cartesian = F.transform("xyz", lambda x: _inverse(F.col("cell"), x))
    return _structures(made.withColumn("positions", F.when(F.col("mode").isin("c", "k"), cartesian).otherwise(F.col("xyz"))), "contcar")


def flat_grid(values: DataFrame) -> DataFrame:
    """(file, name, u, v, w, density) of one-line grids (file, name, line): dimensions and spins, then values with u fastest, in
    electrons per cubic Bohr. Cells come from companion files (see with_cells). Of a grid that comes in chunks, column `first` has the
    place of a chunk's first value, and null for the line of dimensions, which then has no values."""
    head = F.lit(True) if "first" not in values.columns else F.col("first").isNull()
    size = [F.col("n")[k].cast("int").alias(f"n{k + 1}") for k in range(3)]
    parts = values.withColumn("n", numbers(F.col("line")))
    if "first" in values.columns:
        sizes = parts.where(head).select("file", "name", *size)  # one row per file
        parts = parts.where(~head).select("file", "name", F.col("first"), F.posexplode("n").alias("at", "raw")).join(sizes, ["file", "name"]).withColumn("pos", F.col("first") + F.col("at"))
    else:
        parts = parts.select("file", "name", *size, F.posexplode(F.slice("n", 5, F.size("n"))).alias("pos", "raw"))
    at = F.col("pos")
    u, v, w = at % F.col("n1"), F.floor(at / F.col("n1")) % F.col("n2"), F.floor(at / (F.col("n1") * F.col("n2")))
    return parts.select("file", "name", u.cast("int").alias("u"), v.cast("int").alias("v"), w.cast("int").alias("w"), "n1", "n2", "n3", (F.col("raw") * 1.8897259886**3).alias("density"))


def flat_numbers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, split, n, x): the numbers of one-line grids in order, counted from 1; the first four are dimensions and spins.

    A row ends at a blank, not at a line's end, so a line of any length is read in splits: the reader ends a number that a split's edge
    cuts, and numbers are counted by split (see places). No row holds more than a number's text.
    """
    found = scan_text(spark, paths, ["den"], separator=" ").where(F.col("line").rlike(r"\d")).select("file", "name", "split", "pos", F.posexplode(numbers(F.col("line"))).alias("at", "x"))
    return places(found, ["file"], "split", ["pos", "at"], "n").select("file", "name", "split", "n", "x")


def _flat_sizes(found: DataFrame) -> DataFrame:
    return found.where("n <= 3").groupBy("file").agg(*(F.max(F.when(F.col("n") == k, F.col("x").try_cast("int"))).alias(f"n{k}") for k in (1, 2, 3)))


def read_flat_grid(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """flat_grid of files, of which no line need fit into a row."""
    found = flat_numbers(spark, paths)
    sizes = found.select("file", "split").distinct().join(_flat_sizes(found), "file")  # to every split, so that a file stays spread
    parts = found.where("n > 4").join(sizes, ["file", "split"]).withColumn("pos", F.col("n") - 5)
    u, v, w = F.col("pos") % F.col("n1"), F.floor(F.col("pos") / F.col("n1")) % F.col("n2"), F.floor(F.col("pos") / (F.col("n1").cast("long") * F.col("n2")))
    return parts.select("file", "name", u.cast("int").alias("u"), v.cast("int").alias("v"), w.cast("int").alias("w"), "n1", "n2", "n3", (F.col("x") * 1.8897259886**3).alias("density"))


def flat_file_structures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """What one-line grids say of their structures: grid and number of points."""
    found = flat_numbers(spark, paths)
    made = found.groupBy("file", "name").agg(F.greatest(F.count("*") - 4, F.lit(0)).alias("n_points")).join(_flat_sizes(found), "file", "left")
    return _structures(made.withColumn("grid", F.array("n1", "n2", "n3")), "den")


def companion_cells(structures: DataFrame) -> DataFrame:
    """(folder, name, cell) from the best file that has one."""
    return structures.where("cell IS NOT NULL").groupBy("folder", "name").agg(F.min_by("cell", "prec").alias("cell"))


def with_cells(grid: DataFrame, structures: DataFrame) -> DataFrame:
    """Points of flat grids (see flat_grid) with the cell of their companion file and Cartesian places x, y, z; without a companion null."""
    f = [F.col(c) / F.col(f"n{k + 1}") for k, c in enumerate("uvw")]
    both = grid.withColumn("folder", F.regexp_extract("file", r"^(.*)/[^/]*$", 1)).join(companion_cells(structures), ["folder", "name"], "left")
    return both.select(*grid.columns, "cell", *(sum((f[k] * nth(nth(F.col("cell"), k), d) for k in range(3)), F.lit(0.0)).alias(x) for d, x in enumerate("xyz")))


def grid_structures(lines: DataFrame) -> DataFrame:
    """What grid files say of their structures: cell, grid and number of points."""
    line = F.col("line")
    tagged = tag_blocks(lines, {"cell": line.contains("Real Lattice(A)"), "data": line.contains("END header"), "grid": line.contains("FFT grid")})
    cell = (F.col("block") == "cell") & F.col("since").between(1, 3)
    size = F.transform(F.slice(numbers(line), 1, 3), lambda x: x.try_cast("int"))
    made = tagged.groupBy("file", "name").agg(in_order(leading(line), cell).alias("cell"), F.max_by(size, F.when(line.contains("FFT grid"), F.col("pos"))).alias("grid"), F.count_if((F.col("block") == "data") & line.rlike(GRID_ROW)).alias("n_points"))
    return _structures(made, "den_fmt")


XML_DDL = "structure struct<crystal:struct<varray:array<struct<_name:string,v:array<string>>>>,varray:array<struct<_name:string,v:array<string>>>>, varray array<struct<_name:string,v:array<string>>>, energy struct<i:array<struct<_VALUE:double,_name:string>>>, scstep array<struct<energy:struct<i:array<struct<_VALUE:double,_name:string>>>>>"


def xml_structures(spark: SparkSession, paths: str | list[str], steps: str | list[int] = "last", glob: str = "*") -> DataFrame:
    """Ionic steps of XML runs: e_fr_energy plus the last electronic step's e_0 - e_fr. steps: last, all, or a list of numbers."""
    raw = spark.read.format("xml").option("pathGlobFilter", glob).option("rowTag", "calculation").schema(XML_DDL).load(paths).withColumn("file", F.col("_metadata.file_path")).withColumn("split", F.col("_metadata.file_block_start"))
    raw = raw.withColumn("at", F.monotonically_increasing_id())
    kinds = spark.read.format("xml").option("pathGlobFilter", glob).option("rowTag", "atominfo").schema("array array<struct<_name:string,set:struct<rc:array<struct<c:array<string>>>>>>").load(paths).withColumn("file", F.col("_metadata.file_path"))
    kinds = kinds.select("file", F.transform(nth(F.filter("array", lambda a: a["_name"] == "atoms"), 0)["set"]["rc"], lambda r: F.trim(nth(r["c"], 0))).alias("species"))
    rows = lambda a, name: F.transform(nth(F.filter(a, lambda x: x["_name"] == name), 0)["v"], lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda y: y.try_cast("double")))
    pick = lambda e, name: nth(F.filter(e, lambda x: x["_name"] == name), 0)["_VALUE"]
    final = F.try_element_at("scstep", F.lit(-1))["energy"]["i"]
    made = raw.select("file", "split", "at", rows(F.col("structure.crystal.varray"), "basis").alias("cell"), rows(F.col("structure.varray"), "positions").alias("positions"), rows(F.col("varray"), "forces").alias("forces"), (pick(F.col("energy.i"), "e_fr_energy") + pick(final, "e_0_energy") - pick(final, "e_fr_energy")).alias("energy"))
    made = places(made, ["file"], "split", ["at"], "n")
    newest = made.groupBy("file").agg(F.max("n").alias("m"))
    made = made.join(newest, "file").join(kinds, "file", "left").withColumn("name", F.regexp_extract("file", r"([^./]*)[^/]*$", 1))
    if steps == "last":
        made = made.where("n = m")
    else:
        made = (made if steps == "all" else made.where((F.col("n") - 1).isin(*steps))).withColumn("name", F.concat_ws("_", "name", (F.col("n") - 1)))
    return _structures(made, "xml")


def read_directory(spark: SparkSession, paths: str | list[str], merge: bool = True) -> DataFrame:
    """All structures of one or many folders, one row per folder and name. Files of other extensions are left out (see unsupported); names
    whose files belong to more than one simulation code have codes > 1. Fields take their first value in order of the files' precedence."""
    of = lambda e: scan_text(spark, paths, [e])
    parts = [
        log_structures(of("castep")), trajectory(of("md")), trajectory(of("geom"), "geom", last_only=True), grid_structures(of("den_fmt")), profess_structures(of("profess")), flat_file_structures(spark, paths),
        cell_file(of("ion")), cell_file(of("final.geom"), "final.geom"), coordinate_file(read_lines(spark, paths, ["contcar"])), xml_structures(spark, paths, glob="*.[xX][mM][lL]"),
    ]
    every = reduce(DataFrame.unionByName, parts)
    return merge_by_precedence(every, list(FIELDS), ["folder", "name"]) if merge else every


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """The structures of one file; an extension that no reader takes is an error."""
    ext = path.rstrip("/").rsplit("/", 1)[-1].partition(".")[2].lower()
    if ext not in PRECEDENCE:
        raise ValueError(f"no reader for {path}")
    return read_directory(spark, path)


def read_grids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, file, x, y, z, density, cell) of every grid point of the folders; flat grids take their cells from companion files."""
    of = lambda e: scan_text(spark, paths, [e])
    named = reduce(DataFrame.unionByName, [profess_structures(of("profess")), cell_file(of("final.geom"), "final.geom"), cell_file(of("ion"))])
    columns = ["name", "file", "x", "y", "z", "density", "cell"]
    return grid_density(of("den_fmt")).select(columns).unionByName(with_cells(read_flat_grid(spark, paths), named).select(columns))


def first_of(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Stored tables of one form, of which a later one overrides an earlier one row by row of the same key: reloaded weights, functions."""
    ranked = [p.withColumn("_prec", F.lit(-n)) for n, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    others = [c for c in every.columns if c not in (*by, "_prec")]
    return every.groupBy(*by).agg(F.min_by(F.struct(*others), "_prec").alias("_v")).select(*by, "_v.*")


def reload(spark: SparkSession, paths: list[str], by: list[str]) -> DataFrame:
    """Fitted artefacts (weights, tabulated functions, predictions) saved under several paths; later paths override earlier ones."""
    return first_of([spark.read.parquet(p) for p in paths], by)


def unsupported(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ext) of the files that no reader takes."""
    listed = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))  # no content is read
    return listed.withColumn("ext", F.lower(F.regexp_extract("file", r"^[^.]*\.(.*)$", 1))).where(~F.col("ext").isin(*PRECEDENCE))


def quality(structures: DataFrame) -> DataFrame:
    """structures with reason, the first rule that each breaks, or `valid`."""
    from latticeworks.operators.structures import checked

    n = F.size("species")
    rules = [("no cell", F.col("cell").isNull() | (F.size("cell") != 3)), ("no species", F.col("species").isNull()), ("no energy", F.col("energy").isNull() | F.isnan("energy")), ("positions do not match species", F.col("positions").isNotNull() & (F.size("positions") != n)), ("forces do not match species", F.col("forces").isNotNull() & (F.size("forces") != n)), ("stress is not 3 x 3", F.col("stress").isNotNull() & (F.size("stress") != 3))]
    return checked(structures, [(a, F.coalesce(b, F.lit(False))) for a, b in rules])


#: Units that are read, by what a log or an orbital-free log prints them for.
UNITS = {"length": "A", "energy": "eV", "force": "eV/A", "pressure": "GPa"}
#: What a structure from a file of each kind must have.
NEEDS = {"castep": "cell positions energy", "md": "cell positions energy", "geom": "cell positions energy", "den_fmt": "cell grid", "profess": "energy cell", "den": "grid", "ion": "cell positions", "final.geom": "cell positions", "contcar": "cell positions", "xml": "cell positions energy"}


def unconverged(lines: DataFrame) -> DataFrame:
    """(file, reason) of logs whose electronic or geometry cycles did not converge."""
    line = F.col("line")
    electronic = line.contains("SCF cycles performed but system has not reached the groundstate") | line.contains("electronic minimisation did not converge")
    reason = F.when(electronic, "electronic").when(F.lower("line").contains("failed to converge"), "geometry")
    return lines.select("file", reason.alias("reason")).where("reason IS NOT NULL").distinct()


def line_faults(logs: DataFrame, free: DataFrame) -> DataFrame:
    """(file, reason) of faults that a file states: cycles that did not converge, a relaxation that did nothing, units that are not read."""
    line = F.col("line")
    stopped = unconverged(logs).select("file", F.concat("reason", F.lit(" cycles did not converge")).alias("reason"))
    told = F.regexp_extract(line, r"^\s*output\s+(length|energy|force|pressure) unit\s*:\s*(\S+)", 1)
    unit, right = F.regexp_extract(line, r"unit\s*:\s*(\S+)", 1), F.coalesce(*(F.when(told == k, F.lit(u)) for k, u in UNITS.items()))
    units = logs.where((told != "") & (unit != right)).select("file", F.concat(told, F.lit(" unit is not read")).alias("reason"))
    idle = logs.where(line.contains("there is nothing to optimise")).select("file", F.lit("nothing was optimised").alias("reason"))
    cell = F.lower(F.regexp_extract(line, r"LATTICE VECTORS\s*\(([^)]*)\)", 1))
    energy = F.lower(F.regexp_extract(line, r"^#\s+TOTAL ENERGY\s*=\s*\S+\s+([A-Za-z]+)", 1))
    other = F.when((cell != "") & (cell != "angstrom"), "length unit is not read").when((energy != "") & (energy != "ev"), "energy unit is not read")
    return reduce(DataFrame.unionByName, [stopped, units, idle, free.select("file", other.alias("reason")).where("reason IS NOT NULL")]).distinct()


def row_fault() -> Column:
    """Of a reader's row (before merging) the first rule that it breaks, or null. What is no number was read as null."""
    n, cell = F.size("species"), F.col("cell")
    needs = lambda what: F.coalesce(*(F.when(F.col("ext") == e, F.lit(what in have.split())) for e, have in NEEDS.items()))
    bad = lambda c: F.exists(c, lambda r: r.isNull() | (F.size(r) != 3) | F.exists(r, lambda x: x.isNull() | F.isnan(x)))
    c = lambda i, j: nth(nth(cell, i), j % 3)
    det = sum((c(0, i) * (c(1, i + 1) * c(2, i + 2) - c(1, i + 2) * c(2, i + 1)) for i in range(3)), F.lit(0.0))
    rules = [
        ("no cell", needs("cell") & cell.isNull()), ("cell is not 3 x 3 numbers", cell.isNotNull() & ((F.size("cell") != 3) | bad("cell"))), ("cell is flat", cell.isNotNull() & (det == 0)), ("no grid", needs("grid") & (F.col("grid").isNull() | F.exists("grid", lambda x: x.isNull()))),
        ("no positions", needs("positions") & F.col("positions").isNull()), ("positions do not match species", F.col("positions").isNotNull() & (F.col("species").isNull() | (F.size("positions") != n) | bad("positions"))),
        ("no energy", needs("energy") & (F.col("energy").isNull() | F.isnan("energy"))), ("forces do not match species", F.col("forces").isNotNull() & F.col("species").isNotNull() & ((F.size("forces") != n) | bad("forces"))), ("stress is not 3 x 3 numbers", F.col("stress").isNotNull() & ((F.size("stress") != 3) | bad("stress"))),
        ("grid is not whole", F.col("grid").isNotNull() & (F.col("n_points") != F.aggregate("grid", F.lit(1).cast("long"), lambda p, x: p * x))),
    ]
    out = F.lit(None).cast("string")
    for reason, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), reason).otherwise(out)
    return out


def read_checked(spark: SparkSession, paths: str | list[str], merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """(structures as from read_directory, rejects) of files that may be damaged.

    rejects (folder, file, ext, reason) has one row for every file with a fault: what it states itself (see line_faults), else the first
    rule that one of its structures breaks, else that nothing could be read from it (an empty file has no row anywhere). Structures of a file that states a fault, and others
    that break a rule, are left out; all others are kept. Files that no reader takes are no rejects (see unsupported).
    """
    path = F.concat_ws("/", F.nullif("folder", F.lit("")), F.col("files")[0])
    rows = stored(read_directory(spark, paths, merge=False).withColumn("path", path).withColumn("reason", row_fault()))  # both tables read it
    of = lambda e: scan_text(spark, paths, [e])
    spins = flat_numbers(spark, paths).where("n = 4 AND x <> 1").select("file", F.lit("more than one spin").alias("reason"))
    told = line_faults(of("castep"), of("profess")).unionByName(spins).select(F.col("file").alias("path"), "reason").groupBy("path").agg(F.min("reason").alias("told"))
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"))  # no content is read
    listed = listed.withColumn("file", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("ext", F.lower(F.regexp_extract("file", r"^[^.]*\.(.*)$", 1))).where(F.col("ext").isin(*PRECEDENCE))
    seen = rows.groupBy("path").agg(F.min("reason").alias("broken"))
    every = listed.join(told, "path", "left").join(seen.withColumn("seen", F.lit(True)), "path", "left")
    reason = F.coalesce("told", "broken", F.when(F.col("seen").isNull(), F.lit("nothing could be read")))
    rejects = every.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "file", "ext", reason.alias("reason")).where("reason IS NOT NULL")
    good = rows.where("reason IS NULL").join(told, "path", "left_anti").drop("path", "reason")
    return merge_by_precedence(good, list(FIELDS), ["folder", "name"]) if merge else good, rejects
