"""Readers on small hand-written files."""

import pytest

from latticeworks.sources import lines as ln
from latticeworks.sources import readers as rd
from latticeworks.sources import writers as wr

LOG = """
 Run started: Monday
 Final energy, E             =  -1.0     eV
 Run started: Tuesday
        Real Lattice(A)                      Reciprocal Lattice(1/A)
  2.5  0.0  0.0     9.1  9.2  9.3
  0.0  4.0  0.0     9.4  9.5  9.6
  0.0  0.0  7.5     9.7  9.8  9.9

                       Lattice parameters(A)       Cell Angles
            x  Element    Atom        Fractional coordinates of atoms  x
            x            Number           u          v          w      x
            x----------------------------------------------------------x
   x  Cu  1   .0   0.25   0.5  x
   x  Zn  1   0.5   0.5   0.125  x
            xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx
                      Space group of crystal = 62: Pnma, other
Final energy, E  =  -20.25  eV
NB est. 0K energy (E-0.5TS)  =  -20.5  eV
 ***************** Symmetrised Forces *****************
 *                   x            y            z      *
 * Cu  1   0.1   0.2   -0.3 *
 * Zn  1   -0.1   -0.2   0.3 *
 ******************************************************

 *********** Symmetrised Stress Tensor ***********
 *             x             y             z     *
 *  x   1.25   0.5   -.75  *
 *  y   0.5   2.25   0.0  *
 *  z   -.75   0.0   3.25  *
 *  Pressure:   -2.25  *
"""
MD = """ BEGIN header

 END header

 0.0
 -1.0 -1.0 0.0 <-- E
 2.0 0.0 0.0 <-- h
 0.0 2.0 0.0 <-- h
 0.0 0.0 2.0 <-- h
 Al 1 0.0 0.0 0.0 <-- R
 Al 1 0.0 0.0 0.1 <-- F

 1.0
 -2.0 -1.0 0.0 <-- E
 2.0 0.0 0.0 <-- h
 0.0 2.0 0.0 <-- h
 0.0 0.0 2.0 <-- h
 Al 1 1.0 0.5 0.0 <-- R
 Al 1 0.0 0.0 0.2 <-- F

 2.0
 -3.0 -1.0 0.0 <-- E
 2.0 0.0 0.0 <-- h
 0.0 2.0 0.0 <-- h
 0.0 0.0 2.0 <-- h
 Al 1 1.5 0.5 0.0 <-- R
 Al 1 0.0 0.0 0.3 <-- F"""
DEN_FMT = """ BEGIN header
           Real Lattice(A)               Lattice parameters(A)    Cell Angles
   2.0   0.0   0.0     a =    2.0  alpha =   90.0
   0.0   2.0   0.0     b =    2.0  beta  =   90.0
   0.0   0.0   2.0     c =    2.0  gamma =   90.0

   1                            ! nspins
   2     1     1                ! fine FFT grid along <a,b,c>
 END header: data is "<a b c> charge" in units of electrons/grid_point * number
 of grid_points

     1     1     1            8.0
     2     1     1            0.5
"""
ION = """%block lattice_cart
2.0 0.0 0.0
0.0 2.0 0.0
0.0 0.0 4.0
%endblock lattice_cart

%BLOCK POSITIONS_ABS
Fe 1.0 0.5 1.0
%ENDBLOCK POSITIONS_ABS
"""
PROFESS = """# FINAL ENERGIES #
# a part =   1.5E+00 eV #
#  TOTAL ENERGY =  -3.25E+01 eV  #
 TOTAL-FORCE (eV/A)
:               x                  y                  z                      :
: Fe  1   1.5D-01   2.5E-01  -4.0E-01  :
 TOTAL-FORCE (Hartree/Bohr)
: Fe  1   8.0E+00   8.0E+00  -8.0E+00  :
                         LATTICE VECTORS (Angstrom)
 LAT 1   2.0  0.0  0.0
 LAT 2   0.0  2.0  0.0
 LAT 3   0.0  0.0  4.0
                                STRESS (GPa)
 ST_GPa 1   0.5  0.0  0.25
 ST_GPa 2   0.0  0.75  0.0
 ST_GPa 3   0.25  0.0  1.5
 STRESS (a.u.)
"""
CONTCAR = """comment
2.0
1.0 0.0 0.0
0.0 1.0 0.0
0.0 0.0 1.0
Al Ni
1 2
Cartesian
0.0 0.0 0.0
1.0 1.0 1.0
0.5 0.0 0.0
"""
XML = """<modeling><atominfo><array name="atoms"><set><rc><c>Al </c><c>1</c></rc></set></array></atominfo>
<calculation><scstep><energy><i name="e_fr_energy">-1.0</i><i name="e_0_energy">-1.5</i></energy></scstep>
<structure><crystal><varray name="basis"><v>2 0 0</v><v>0 2 0</v><v>0 0 2</v></varray></crystal><varray name="positions"><v>0.5 0 0</v></varray></structure>
<varray name="forces"><v>0 0 1</v></varray><energy><i name="e_fr_energy">-3.0</i></energy></calculation>
<calculation><scstep><energy><i name="e_fr_energy">-2.0</i><i name="e_0_energy">-2.25</i></energy></scstep>
<structure><crystal><varray name="basis"><v>2 0 0</v><v>0 2 0</v><v>0 0 2</v></varray></crystal><varray name="positions"><v>0.25 0 0</v></varray></structure>
<varray name="forces"><v>0 0 2</v></varray><energy><i name="e_fr_energy">-4.0</i></energy></calculation></modeling>
"""


DEN = "  x-dimension: 2   y-dimension: 1   z-dimension: 2   # of spins: 1  .5 1.0 1.5 2.0"


def _step(u, e, f, cell="", stress=True):
    """What a log of molecular dynamics prints for a step."""
    out = f"Final energy, E = {e - 1} eV\nNB est. 0K energy (E-0.5TS) = {e} eV\n x Fractional coordinates of atoms x\n x Cu 1 {u} 0.5 0.25 x\n"
    out += f" ******** Forces ********\n * Cu 1 {f} 0.0 0.0 *\n *****\n\n"
    return cell + out + (f" ***** Stress Tensor *****\n * x {f} 0 0 *\n * y 0 {f} 0 *\n * z 0 0 {f} *\n * Pressure: 1 *\n" if stress else "")


CELL = "  Real Lattice(A)\n 5.0 0.0 0.0\n 0.0 5.0 0.0\n 0.0 0.0 5.0\n\n  Lattice parameters(A)\n"
#: The last block of forces is printed again.
STEPS = " Run started: x\n type of calculation : molecular dynamics\n ensemble : NVT\n" + CELL + _step(0.1, -1.5, 0.5) + _step(0.2, -2.5, 0.25) + _step(0.3, -3.5, 0.75) + " ******** Forces ********\n * Cu 1 0.75 0.0 0.0 *\n *****\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, text in {"A1.castep": LOG, "run.md": MD, "A1.den_fmt": DEN_FMT, "B2.ion": ION, "B2.profess": PROFESS, "C3.contcar": CONTCAR, "notes.txt": "nothing", "B2.den": DEN, "D4.xml": XML, "F6.geom": MD, "G7.final.geom": ION, "H8.castep": STEPS}.items():
        (d / name).write_text(text)
    return str(d)


def test_directory(spark, folder):
    got = {r.name: r for r in rd.read_directory(spark, folder).collect()}
    assert set(got) == {"A1", "run-1", "run-2", "B2", "C3", "D4", "F6", "G7", "H8-1", "H8-2"}
    assert got["D4"].energy == -4.25 and got["D4"].positions == [[0.25, 0.0, 0.0]] and got["F6"].energy == pytest.approx(-3 * rd.HARTREE) and got["G7"].cell[2][2] == 4.0
    a = got["A1"]
    assert a.energy == -20.5 and a.species == ["Cu", "Zn"] and a.positions[1] == [0.5, 0.5, 0.125] and a.spacegroup == "Pnma"
    assert a.cell == [[2.5, 0, 0], [0, 4, 0], [0, 0, 7.5]] and a.forces[0] == [0.1, 0.2, -0.3] and a.stress == [[1.25, 0.5, -0.75], [0.5, 2.25, 0], [-0.75, 0, 3.25]] and a.grid == [2, 1, 1] and a.n_points == 2
    assert got["run-1"].positions[0] == pytest.approx([0.5, 0.25, 0.0]) and got["run-1"].energy == pytest.approx(-2 * rd.HARTREE)
    b = got["B2"]
    assert b.energy == -32.5 and b.cell[2][2] == 4.0 and b.forces[0] == [0.15, 0.25, -0.4] and b.stress[0] == [0.5, 0.0, 0.25] and b.files == ["B2.den", "B2.ion", "B2.profess"] and b.grid == [2, 1, 2] and b.codes == 1
    assert b.positions[0] == pytest.approx([0.5, 0.25, 0.25])
    assert got["C3"].species == ["Al", "Ni", "Ni"] and got["C3"].positions[2] == pytest.approx([0.25, 0.0, 0.0])
    assert [r.file for r in rd.unsupported(spark, folder).collect()] == ["notes.txt"]
    reasons = {r.name: r.reason for r in rd.quality(rd.read_directory(spark, folder)).collect()}
    assert reasons["A1"] == "valid" and reasons["C3"] == "no energy" and reasons["H8-1"] == "valid"


def test_steps_of_a_log(spark, folder):
    got = {r.name: r for r in rd.log_structures(ln.read_lines(spark, f"{folder}/H8.castep")).collect()}
    assert set(got) == {"H8-1", "H8-2"}
    for name, u, e, f in (("H8-1", 0.2, -2.5, 0.25), ("H8-2", 0.3, -3.5, 0.75)):
        r = got[name]
        assert (r.positions, r.energy, r.forces, r.species, r.cell[0][0], r.stress[1][1]) == ([[u, 0.5, 0.25]], e, [[f, 0.0, 0.0]], ["Cu"], 5.0, f)


def test_grids_with_companion_cells(spark, folder):
    got = {(r.name, r.x, r.z): r.density for r in rd.read_grids(spark, folder).collect()}
    k = 1.8897259886**3
    assert got == {("A1", 0.0, 0.0): 1.0, ("A1", 1.0, 0.0): 0.0625, ("B2", 0.0, 0.0): pytest.approx(0.5 * k), ("B2", 1.0, 0.0): pytest.approx(k), ("B2", 0.0, 2.0): pytest.approx(1.5 * k), ("B2", 1.0, 2.0): pytest.approx(2 * k)}


def test_single_files(spark, folder):
    assert [r.name for r in rd.read_file(spark, f"{folder}/D4.xml").collect()] == ["D4"]
    with pytest.raises(ValueError, match="notes"):
        rd.read_file(spark, f"{folder}/notes.txt")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "long.md").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = ln.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.pos, r.line) for r in rows) == [(i, f"line {i}") for i in range(5000)]


def test_files_and_reload(spark, tmp_path):
    grid = spark.createDataFrame([(1, k, u / 2, 0.0, w / 2, 1.0 + k) for k, (w, u) in enumerate((a, b) for a in range(2) for b in range(2))], "structure_id long, point_id long, u double, v double, w double, density double")
    text = wr.flat_grid_text(grid).withColumn("file", ln.F.concat(ln.F.lit("S"), "structure_id", ln.F.lit(".den")))
    assert wr.write_files(text, f"file://{tmp_path}/out").count() == 1
    back = rd.flat_grid(ln.read_lines(spark, f"{tmp_path}/out")).collect()
    assert {(r.u, r.v, r.w): round(r.density, 9) for r in back} == {(0, 0, 0): 1.0, (1, 0, 0): 2.0, (0, 0, 1): 3.0, (1, 0, 1): 4.0}
    for n, data in enumerate([[(0, 1.0), (1, 2.0)], [(1, 5.0), (2, 6.0)]]):
        wr.save(spark.createDataFrame(data, "col int, w double"), f"{tmp_path}/w{n}")
    assert {r.col: r.w for r in rd.reload(spark, [f"{tmp_path}/w0", f"{tmp_path}/w1"], ["col"]).collect()} == {0: 1.0, 1: 5.0, 2: 6.0}


def test_last_frame_and_grid(spark, folder):
    md = ln.read_lines(spark, folder, ["md"])
    last = rd.trajectory(md, "geom", last_only=True).collect()
    assert len(last) == 1 and last[0].name == "run" and last[0].energy == pytest.approx(-3 * rd.HARTREE)
    grid = rd.grid_density(ln.read_lines(spark, folder, ["den_fmt"]))
    assert [(r.a, r.x, r.density) for r in grid.orderBy("a").collect()] == [(1, 0.0, 1.0), (2, 1.0, 0.0625)]
    assert rd.thinned(grid).count() == 1


def test_xml(spark, tmp_path):
    (tmp_path / "D4.xml").write_text(XML)
    last = rd.xml_structures(spark, str(tmp_path)).collect()
    assert [(r.name, r.energy, r.species, r.positions, r.forces) for r in last] == [("D4", -4.25, ["Al"], [[0.25, 0.0, 0.0]], [[0.0, 0.0, 2.0]])]
    assert sorted(r.name for r in rd.xml_structures(spark, str(tmp_path), "all").collect()) == ["D4_0", "D4_1"]


def test_round_trip(spark, folder, tmp_path):
    s = rd.read_directory(spark, folder).where("name = 'A1'")
    wr.write_texts(wr.ion_text(s), str(tmp_path / "out"))
    back = rd.cell_file(ln.read_lines(spark, str(tmp_path / "out" / "name=A1" / "*"))).first()
    assert back.cell == s.first().cell and back.positions == s.first().positions and back.species == s.first().species
    assert "Zn" in wr.config_text(s).first().text


def test_grid_report(spark):
    whole = [(1, k, u / 2, v / 2, 0.0, 1.0) for k, (u, v) in enumerate((a, b) for a in range(2) for b in range(2))]
    grid = spark.createDataFrame(whole + [(2, *r[1:]) for r in whole[:3]] + [(3, *r[1:]) for r in [*whole, whole[0]]], "structure_id long, point_id long, u double, v double, w double, density double")
    assert {r.structure_id: r.complete for r in wr.grid_report(grid).collect()} == {1: True, 2: False, 3: False}
