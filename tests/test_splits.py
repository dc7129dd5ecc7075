"""Files larger than a task: whatever the splits, lines are tagged as one window over the file would."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_sources import CONTCAR, DEN_FMT, ION, LOG, MD, PROFESS, STEPS, XML

from latticeworks.sources import lines as ln
from latticeworks.sources import readers as rd


@contextmanager
def settings(spark, **values):
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k in values:
            spark.conf.unset(k.replace("__", "."))


SPLITS = {"spark__sql__files__maxPartitionBytes": "1k", "spark__sql__files__openCostInBytes": "1", "spark__sql__shuffle__partitions": "64", "spark__sql__adaptive__coalescePartitions__enabled": "false"}


def by_window(lines, markers):
    """tag_blocks and frames with one window for each file."""
    order = Window.partitionBy("file").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    name = F.coalesce(*(F.when(test, n) for n, test in markers.items()))
    out = lines.withColumn("m", name).withColumn("block", F.last("m", True).over(upto)).withColumn("block_no", F.count("m").over(upto))
    out = out.withColumn("since", F.col("pos") - F.last(F.when(F.col("m").isNotNull(), F.col("pos")), True).over(upto))
    blank = F.trim("line") == ""
    fresh = blank & ~F.coalesce(F.lag(blank).over(order), F.lit(False))
    return out.withColumn("frame", F.sum(fresh.cast("int")).over(upto))


def noise(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(["\n", "  \n", "\n", "MARK one\n", "MARK two\n", f"{rng.random()}\n", "x" * rng.randrange(90) + "\n", "plain\n", "plain\n"]) for _ in range(n))


def test_tags_in_many_splits(spark, tmp_path):
    for k, n in (("a", 7000), ("b", 700), ("c", 3)):
        (tmp_path / f"{k}.md").write_text(noise(k, n) + ("no end of line" if k == "a" else ""))
    (tmp_path / "long.md").write_text("\n" * 5000 + "MARK one\n" + "plain\n" * 1000)  # most splits have no marker at all, blank lines go on
    markers = {"one": F.col("line").contains("MARK one"), "two": F.col("line").contains("MARK two")}
    want = {(r.name, r.pos): r for r in by_window(ln.read_lines(spark, str(tmp_path)), markers).collect()}
    with settings(spark, **SPLITS):
        lines = ln.scan_text(spark, str(tmp_path))
        assert lines.where("name = 'a'").select("split").distinct().count() >= 64
        dense = {(r.file, r.split, r.line, r.pos - r.split) for r in lines.collect()}
        assert len(dense) == len(want)
        numbered = {(r.name, r.pos): r.line for r in ln.read_lines(spark, str(tmp_path)).collect()}
        assert numbered == {k: r.line for k, r in want.items()}
        tagged = ln.tag_blocks(lines, markers).withColumn("task", F.spark_partition_id())
        plan = tagged._jdf.queryExecution().executedPlan().toString()
        specs = [x.split("specifiedwindowframe")[0] for x in plan.split("windowspecdefinition(")[1:]]
        assert specs and all("split#" in x for x in specs if "pos#" in x)  # a window over lines is one over a split
        place = Window.partitionBy("name").orderBy("pos")
        got = tagged.withColumn("n", F.row_number().over(place) - 1).collect()
        assert {(r.name, r.n): (r.block, r.block_no, r.since) for r in got} == {k: (r.block, r.block_no, r.since) for k, r in want.items()}
        assert len({r.task for r in got if r.name == "a"}) > 30
        framed = ln.frames(ln.read_lines(spark, str(tmp_path))).collect()
        assert {(r.name, r.pos): r.frame for r in framed} == {k: r.frame for k, r in want.items() if r.line.strip()}


def test_last_run_in_many_splits(spark, tmp_path):
    text = noise(1, 400) + "Run started: a\n" + noise(2, 900) + "Run started: b\n" + noise(3, 500)
    (tmp_path / "r.castep").write_text(text)
    (tmp_path / "n.castep").write_text(noise(4, 300))
    with settings(spark, **SPLITS):
        got = ln.last_run(ln.read_lines(spark, str(tmp_path))).orderBy("pos").collect()
    assert [r.line for r in got if r.name == "r"] == text[text.index("Run started: b") :].split("\n")[:-1]
    assert len([r for r in got if r.name == "n"]) == 300


def fields(rows):
    return sorted(repr({k: v for k, v in r.asDict().items() if k != "folder"}) for r in rows)


def test_readers_do_not_depend_on_splits(spark, tmp_path):
    rng = random.Random(9)
    frame = lambda k: f"\n\n {k}.0\n -{k}.0 0 0 <-- E\n" + "".join(f" {'2.0 0 0' if d == 0 else '0 2.0 0' if d == 1 else '0 0 2.0'} <-- h\n" for d in range(3)) + "".join(f" Al {j} {rng.random():.6f} 0.5 0.0 <-- R\n Al {j} 0 0 {rng.random():.6f} <-- F\n" for j in range(9))
    files = {"A1.castep": "old\n" * 900 + LOG, "run.md": "header\n" + "".join(map(frame, range(120))), "A1.den_fmt": DEN_FMT + "".join(f" {k % 2 + 1} 1 1 {k}.5\n" for k in range(800)), "B2.ion": ION, "B2.profess": "#\n" * 1500 + PROFESS, "C3.contcar": CONTCAR, "D4.xml": XML, "H8.castep": STEPS, "L.geom": "\n".join(map(frame, range(60)))}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    want, grid = rd.read_directory(spark, str(tmp_path)).collect(), rd.read_grids(spark, str(tmp_path)).collect()
    assert len([r for r in want if r.name.startswith("run-")]) == 119
    with settings(spark, **SPLITS | {"spark__sql__shuffle__partitions": "4"}):
        assert fields(rd.read_directory(spark, str(tmp_path)).collect()) == fields(want)
        assert fields(rd.read_grids(spark, str(tmp_path)).collect()) == fields(grid)


@pytest.mark.parametrize("newlines", [False, True])
def test_one_line_grid_in_ranges(spark, tmp_path, newlines):
    """A line of 90 KB in ranges of 1 KB gives the points of the whole line."""
    rng = random.Random(2)
    values = [rng.choice(["1.5", "2.25E-01", "3D+00", "-.5", "7", f"{rng.random():.16e}"]) for _ in range(20 * 25 * 21)]
    text = "  x-dimension:      20   y-dimension:  25   z-dimension:    21   # of spins:  1" + "".join(" " * rng.choice([1, 1, 3]) + v + ("\n" if newlines and k % 7 == 0 else "") for k, v in enumerate(values))
    (tmp_path / "P.den").write_text(text)
    (tmp_path / "Q.den").write_text("x-dimension: 1 y-dimension: 1 z-dimension: 2 # of spins: 1 4.0 5.0\n")
    want = {("P", k % 20, k // 20 % 25, k // 500): float(v.replace("D", "E")) * 1.8897259886**3 for k, v in enumerate(values)}
    want |= {("Q", 0, 0, 0): 4.0 * 1.8897259886**3, ("Q", 0, 0, 1): 5.0 * 1.8897259886**3}
    with settings(spark, **SPLITS | {"spark__sql__shuffle__partitions": "8"}):
        assert ln.scan_text(spark, str(tmp_path), ["den"], " ").select("split").distinct().count() > 80
        rows = rd.read_flat_grid(spark, str(tmp_path)).collect()
        sizes = {r.name: (r.grid, r.n_points) for r in rd.flat_file_structures(spark, str(tmp_path)).collect()}
    assert {(r.name, r.u, r.v, r.w): r.density for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert sizes == {"P": ([20, 25, 21], 10500), "Q": ([1, 1, 2], 2)}


def test_equal_names_in_two_folders(spark, tmp_path):
    for k, u in (("x", 1.0), ("y", 2.0)):
        (tmp_path / k).mkdir()
        (tmp_path / k / "A.ion").write_text(ION.replace("Fe 1.0", f"Fe {u - 0.5}"))
        (tmp_path / k / "A.den").write_text(f"x-dimension: 1 y-dimension: 1 z-dimension: 1 # of spins: 1 {u}")
    got = rd.read_directory(spark, [str(tmp_path / "x"), str(tmp_path / "y")]).collect()
    assert {(r.folder.rsplit("/", 1)[1], r.name, len(r.cell), r.positions[0][0], tuple(r.files)) for r in got} == {("x", "A", 3, 0.25, ("A.den", "A.ion")), ("y", "A", 3, 0.75, ("A.den", "A.ion"))}
    points = rd.read_grids(spark, [str(tmp_path / "x"), str(tmp_path / "y")]).collect()
    assert sorted(r.density for r in points) == pytest.approx([1.8897259886**3, 2 * 1.8897259886**3]) and all(r.cell for r in points)


FORMS = {
    "plain": ("Al Ni\n1 1\nDirect\n", ["Al", "Ni"], [0.5, 0.25, 0.75]),
    "selective": ("Al Ni\n1 1\nSelective dynamics\nDirect\n", ["Al", "Ni"], [0.5, 0.25, 0.75]),
    "unnamed": ("1 1\nDirect\n", ["1", "2"], [0.5, 0.25, 0.75]),
    "both": ("1 1\nselective\ncartesian\n", ["1", "2"], [0.25, 0.125, 0.375]),
}


def test_forms_of_coordinate_files(spark, tmp_path):
    for name, (head, _, _) in FORMS.items():
        (tmp_path / f"{name}.contcar").write_text("comment\n1.0\n2.0 0.0 0.0\n0.0 2.0 0.0\n0.0 0.0 2.0\n" + head + "0.5 0.25 0.75 T T F\n0.0 0.0 0.0\n\n0.1 0.1 0.1\n")
    (tmp_path / "volume.contcar").write_text("comment\n-27.0\n1.0 0.0 0.0\n0.0 1.0 0.0\n0.0 0.0 1.0\nAl\n1\nDirect\n0.5 0.25 0.75\n")
    (tmp_path / "broken.contcar").write_text("comment\nscale\n1.0 0.0\nwhat\n")
    got = {r.name: r for r in rd.read_directory(spark, str(tmp_path)).collect()}
    for name, (_, species, place) in FORMS.items():
        assert (got[name].species, got[name].positions) == (species, [place, [0.0, 0.0, 0.0]]), name
    assert got["volume"].cell[0] == pytest.approx([3.0, 0.0, 0.0]) and got["broken"].cell is None and got["broken"].positions is None


def test_rejects_in_two_folders(spark, tmp_path):
    """Damaged and whole files of each kind: the whole ones are read, each damaged one has one reason."""
    whole = {"A1.castep": LOG, "run.md": MD, "A1.den_fmt": DEN_FMT, "B2.ion": ION, "B2.profess": PROFESS, "C3.contcar": CONTCAR, "D4.xml": XML, "F6.geom": MD, "G7.final.geom": ION, "H8.castep": STEPS, "B2.den": "x-dimension: 2 y-dimension: 1 z-dimension: 1 # of spins: 1 1.0 2.0", "notes.txt": "x"}
    damaged = {
        "A1.castep": (LOG + "Warning: electronic minimisation did not converge when finding ground state.\n", "electronic cycles did not converge"), "U.castep": (" output        length unit  : Bohr\n" + LOG, "length unit is not read"), "V.castep": ("\n", "no cell"),
        "W.castep": (LOG.replace("  2.5  0.0  0.0", "  2.5  what  0.0"), "cell is not 3 x 3 numbers"), "X.castep": (LOG.replace(" * Zn  1   -0.1   -0.2   0.3 *\n", ""), "forces do not match species"),
        "run.md": (MD.replace(" Al 1 1.0 0.5 0.0 <-- R\n", ""), None), "z.md": (MD.replace(" -3.0 -1.0 0.0 <-- E\n", ""), "no energy"), "A1.den_fmt": (DEN_FMT + "  3 1 1 4.0\n", "grid is not whole"), "n.den_fmt": (DEN_FMT.replace("FFT grid", "no grid"), "no grid"),
        "B2.ion": (ION.replace("0.0 2.0 0.0", "2.0 0.0 0.0"), "cell is flat"), "B2.profess": (PROFESS.replace("-3.25E+01 eV", "-3.25E+01 Ha"), "energy unit is not read"), "C3.contcar": (CONTCAR.replace("1.0 1.0 1.0\n0.5 0.0 0.0\n", ""), "positions do not match species"),
        "D4.xml": (XML.replace("-4.0", "x"), None), "B2.den": ("x-dimension: 2 y-dimension: 2 z-dimension: 1 # of spins: 1 1.0 2.0", "grid is not whole"), "S.den": ("x-dimension: 1 y-dimension: 1 z-dimension: 1 # of spins: 2 1.0", "more than one spin"), "E.den": ("no numbers", "nothing could be read"),
    }
    for folder, files in (("good", whole), ("bad", {k: t for k, (t, _) in damaged.items()})):
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / name).write_text(text)
    structures, rejects = rd.read_checked(spark, [str(tmp_path / "good"), str(tmp_path / "bad")])
    got = {(r.folder.rsplit("/", 1)[1], r.file): r.reason for r in rejects.collect()}
    fixed = {("bad", k): why for k, (_, why) in damaged.items() if why}
    assert {k: v for k, v in got.items() if k in fixed} == fixed
    assert set(got) - set(fixed) <= {("bad", "run.md"), ("bad", "D4.xml")} and rejects.count() == len(got)
    names = {(r.folder.rsplit("/", 1)[1], r.name) for r in structures.collect()}
    assert {n for f, n in names if f == "good"} == {r.name for r in rd.read_directory(spark, str(tmp_path / "good")).collect()}
    assert {n for f, n in names if f == "bad"} <= {"run-1", "z-1", "D4"} and ("bad", "z-1") in names


def test_grid_written_in_parts(spark, tmp_path):
    """A grid that is written by many tasks has the bytes of the one-string version, and is read back."""
    from latticeworks.sources import writers as wr
    from latticeworks.sources.store import stored

    n = (9, 8, 7)
    points = [(s, k, (k % 9) / 9, (k // 9 % 8) / 8, (k // 72) / 7, (k * 37 % 101) - 3.5 + s) for s in (1, 2) for k in range(504)]
    points += [(3, k, k / 4, 0.0, 0.0, 1.0) for k in range(3)]  # not whole
    grid = spark.createDataFrame(points, "structure_id long, point_id long, u double, v double, w double, density double").repartition(8)
    want = {r.structure_id: r.text for r in wr.flat_grid_text(grid).collect()}
    parts = wr.grid_parts(grid, 10)
    assert parts.select("part").distinct().count() == 51
    manifest = stored(wr.write_parts(parts.repartition(8), f"file://{tmp_path}/parts"))
    assert manifest.count() == 102
    made = wr.join_parts(manifest, f"file://{tmp_path}/whole").collect()
    assert {r.structure_id: (tmp_path / "whole" / r.file).read_text() for r in made} == want and set(want) == {1, 2}
    assert all(len(want[r.structure_id]) == r.bytes for r in made)
    back = {(r.name, r.u, r.v, r.w): r.density for r in rd.read_flat_grid(spark, str(tmp_path / "whole")).collect()}
    assert back == pytest.approx({(f"S{s}", k % 9, k // 9 % 8, k // 72): max(d, 0.0) for s, k, *_, d in points if s < 3}) and n == (9, 8, 7)
    with pytest.raises(Exception, match="missing"):
        wr.join_parts(manifest.where("part <> 5"), f"file://{tmp_path}/broken").collect()
