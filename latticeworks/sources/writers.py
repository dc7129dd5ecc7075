"""Writers: structures and tables as text in the formats of other programs, and everything else as Parquet."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = "%-20.6f %-20.6f %-20.6f"


def _rows(rows: Column, pattern: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.format_string(pattern, r[0], r[1], r[2])), "\n")


def ion_text(structures: DataFrame) -> DataFrame:
    """(name, text) of structures (name, cell, species, positions) as %BLOCK sections."""
    atoms = F.transform(F.arrays_zip("species", "positions"), lambda a: F.format_string("%-5s " + TRIPLE, a["species"], a["positions"][0], a["positions"][1], a["positions"][2]))
    return structures.select("name", F.concat(F.lit("%BLOCK LATTICE_CART\n"), _rows(F.col("cell"), TRIPLE), F.lit("\n%ENDBLOCK LATTICE_CART\n\n%BLOCK POSITIONS_FRAC\n"), F.array_join(atoms, "\n"), F.lit("\n%ENDBLOCK POSITIONS_FRAC\n")).alias("text"))


def config_text(structures: DataFrame) -> DataFrame:
    """(name, text) with Cartesian positions around the cell's middle and ids from 1."""
    def place(a):
        f = [a["positions"][k] - 0.5 for k in range(3)]
        xyz = [sum((f[k] * F.col("cell")[k][d] for k in range(3)), F.lit(0.0)) for d in range(3)]
        return F.format_string("%-20f%-20f%-20f", *xyz)

    atoms = F.transform(F.arrays_zip("species", "positions"), lambda a, i: F.concat(F.format_string("%-8s%-10d", a["species"], i + 1), F.lit("\n"), place(a)))
    head = F.format_string("%s\n%-10d%-10d%-10d\n", F.col("name"), F.lit(0), F.lit(2), F.size("species"))
    return structures.select("name", F.concat(head, _rows(F.col("cell"), "%-20f%-20f%-20f"), F.lit("\n"), F.array_join(atoms, "\n"), F.lit("\n")).alias("text"))


def write_texts(texts: DataFrame, path: str) -> None:
    """A folder for each name with its text in it."""
    texts.write.mode("overwrite").partitionBy("name").text(path)


def flat_grid_text(grid: DataFrame) -> DataFrame:
    """(structure_id, text) of whole grids (see grid_report) as one line of dimensions and values, u fastest."""
    sizes = grid_report(grid).where("complete").select("structure_id", "n_u", "n_v", "n_w")
    placed = linearised(grid).join(sizes, "structure_id").groupBy("structure_id", "n_u", "n_v", "n_w").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s"))
    head = F.format_string("  x-dimension:%12d   y-dimension:%12d   z-dimension:%12d   # of spins: %12d", "n_u", "n_v", "n_w", F.lit(1))
    return placed.select("structure_id", F.concat(head, F.array_join(F.transform("s", lambda x: F.format_string(" %26.16e", x["value"])), "")).alias("text"))


def write_files(texts: DataFrame, folder: str) -> DataFrame:
    """Writes each text of texts (file, text) to a file of that name in a folder that all executors share; returns (file, bytes). A task
    that runs twice writes the same files again."""

    def write(batches):
        fs, path = _place(folder)
        fs.create_dir(path, recursive=True)
        for b in batches:
            sizes = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                    out.write(raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["file", "bytes"])

    return texts.select("file", "text").mapInArrow(write, "file string, bytes long")


def grid_report(grid: DataFrame) -> DataFrame:
    """Per structure of grid points (structure_id, u, v, w, fractional): sizes by distinct values and by the least gap, and whether
    the grid is whole: both sizes agree, no point is missing or double."""
    key = ["structure_id"]
    sizes = grid.groupBy(*key).agg(*(F.count_distinct(F.round(c, 8)).alias(f"n_{c}") for c in "uvw"), F.count("*").alias("n"), F.count_distinct(F.round("u", 8), F.round("v", 8), F.round("w", 8)).alias("n_distinct"))
    for c in "uvw":
        gap = grid.select(*key, F.round(c, 8).alias("x")).distinct().withColumn("g", F.lead("x").over(Window.partitionBy(*key).orderBy("x")) - F.col("x"))
        sizes = sizes.join(gap.groupBy(*key).agg(F.coalesce(F.round(1 / F.min("g")), F.lit(1.0)).cast("long").alias(f"m_{c}")), key)
    whole = F.col("n") == F.col("n_u") * F.col("n_v") * F.col("n_w")
    even = (F.col("n_u") == F.col("m_u")) & (F.col("n_v") == F.col("m_v")) & (F.col("n_w") == F.col("m_w"))
    return sizes.withColumn("complete", whole & even & (F.col("n") == F.col("n_distinct")))


def linearised(grid: DataFrame) -> DataFrame:
    """Grid points with their place in the order that puts u fastest, negative densities as 0, in electrons per cubic Bohr."""
    place = F.row_number().over(Window.partitionBy("structure_id").orderBy(F.round("w", 8), F.round("v", 8), F.round("u", 8), "point_id")) - 1
    return grid.withColumn("place", place).withColumn("value", F.greatest("density", F.lit(0.0)) / 1.8897259886**3)


#: Values of a part of a grid's file, width of a value, bytes that are copied at once.
PART, VALUE, COPY = 1 << 16, " %26.16e", 1 << 20


def grid_places(grid: DataFrame) -> DataFrame:
    """(structure_id, n_u, n_v, n_w, place, value) of whole grids (see grid_report): place counts u fastest, value is as in linearised.

    A point's place follows from where its coordinates stand among the distinct ones of each axis, so no grid is sorted as a whole.
    """
    sizes = grid_report(grid).where("complete").select("structure_id", "n_u", "n_v", "n_w")
    out = grid.join(sizes, "structure_id")
    for c in "uvw":
        axis = grid.select("structure_id", F.round(c, 8).alias(f"_{c}")).distinct()  # an axis has few values
        axis = axis.withColumn(f"i_{c}", F.row_number().over(Window.partitionBy("structure_id").orderBy(f"_{c}")).cast("long") - 1)
        out = out.withColumn(f"_{c}", F.round(c, 8)).join(axis, ["structure_id", f"_{c}"])
    place = (F.col("i_w") * F.col("n_v") + F.col("i_v")) * F.col("n_u") + F.col("i_u")
    return out.select("structure_id", "n_u", "n_v", "n_w", place.alias("place"), (F.greatest("density", F.lit(0.0)) / 1.8897259886**3).alias("value"))


def grid_parts(grid: DataFrame, part: int = PART) -> DataFrame:
    """(structure_id, part, offset, text): the file of a grid (see flat_grid_text) in parts of so many values; values have one width, so
    the first byte of a part is known without those before it. The first part begins with the dimensions."""
    placed = grid_places(grid).withColumn("part", F.floor(F.col("place") / part))
    pair = F.struct("place", F.format_string(VALUE, "value").alias("t"))
    made = placed.groupBy("structure_id", "n_u", "n_v", "n_w", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), "").alias("text"))
    head = F.format_string("  x-dimension:%12d   y-dimension:%12d   z-dimension:%12d   # of spins: %12d", "n_u", "n_v", "n_w", F.lit(1))
    first = F.col("part") == 0
    return made.select("structure_id", "part", F.when(first, 0).otherwise(F.length(head) + F.col("part") * part * len(VALUE % 0.0)).alias("offset"), F.when(first, F.concat(head, "text")).otherwise(F.col("text")).alias("text"))


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    plain = folder.removeprefix("file://") if folder.startswith("file:") else folder
    return (pafs.LocalFileSystem(), plain) if "://" not in plain else pafs.FileSystem.from_uri(plain)


def write_parts(parts: DataFrame, folder: str) -> DataFrame:
    """Writes each part of grid_parts to a file of its own; the manifest (structure_id, part, offset, bytes, path), which must be stored
    before it is read twice: names are those of an attempt, so what a lost attempt leaves behind is in no manifest."""

    def write(batches):
        fs, path = _place(folder)
        fs.create_dir(path, recursive=True)
        for b in batches:
            names, sizes = [], []
            for key, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                names.append(f"{path}/{key}-{part}-{uuid.uuid4().hex}.part")
                raw = text.as_py().encode()
                with fs.open_output_stream(names[-1], compression=None) as out:
                    out.write(raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 2)), pa.array(sizes, pa.int64()), pa.array(names)], ["structure_id", "part", "offset", "bytes", "path"])

    own = parts.select(F.col("structure_id").cast("long").alias("structure_id"), F.col("part").cast("long").alias("part"), F.col("offset").cast("long").alias("offset"), "text")
    return own.mapInArrow(write, "structure_id long, part long, offset long, bytes long, path string")


def join_parts(manifest: DataFrame, folder: str) -> DataFrame:
    """(structure_id, file, bytes): the parts of each manifest entry one after the other in <folder>/S<structure_id>.den. A task copies a
    file in pieces of COPY bytes; parts that do not follow each other are an error."""

    def join(table: pa.Table) -> pa.Table:
        fs, path = _place(folder)
        fs.create_dir(path, recursive=True)
        table, at = table.sort_by("offset"), 0
        key = table.column("structure_id")[0].as_py()
        name = f"{path}/S{key}.den"
        with fs.open_output_stream(name, compression=None) as out:
            for offset, size, part in zip(table.column("offset").to_pylist(), table.column("bytes").to_pylist(), table.column("path").to_pylist(), strict=True):
                if offset != at:
                    raise ValueError(f"{name}: byte {at} is missing")
                with fs.open_input_stream(part, compression=None) as source:
                    while piece := source.read(COPY):
                        out.write(piece)
                at += size
        return pa.table({"structure_id": pa.array([key], pa.int64()), "file": [f"S{key}.den"], "bytes": pa.array([at], pa.int64())})

    return manifest.groupBy("structure_id").applyInArrow(join, "structure_id long, file string, bytes long")


def potential_text(tables: DataFrame) -> DataFrame:
    """(text): blocks of tables (kind, key, bin, y) in the order of kind, key and bin, one value a line; sorted, not gathered."""
    return tables.orderBy("kind", "key", "bin").select(F.concat(F.when(F.col("bin") == 0, F.concat("kind", F.lit(" "), "key", F.lit("\n"))).otherwise(F.lit("")), F.format_string("%24.16e", "y")).alias("text"))


def save(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
