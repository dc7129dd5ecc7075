"""Fits over all rows against dense algebra."""

import numpy as np

from latticeworks.operators import eam as e
from latticeworks.plans import registry  # isort: skip (registers the others)
from latticeworks.plans import eam, views


def test_fits_see_every_force(spark, sf_dir, monkeypatch):
    """Force moments against dense sums over all atoms; the log-joint carries their term."""
    cells = eam.force_design(spark, sf_dir).toPandas()
    atoms = views.atoms(spark, sf_dir).toPandas().set_index(["structure_id", "atom_index"])
    weight = 1 / atoms.groupby("structure_id").size()
    at = {k: n for n, k in enumerate(atoms.index)}
    x = np.zeros((len(atoms) * 3, eam.N_COLUMNS))
    x[[3 * at[k] + a for k, a in zip(zip(cells["structure_id"], cells["atom_index"]), cells["axis"])], cells["col"]] = cells["value"]
    t, w = atoms[["fx", "fy", "fz"]].to_numpy(float).ravel(), np.repeat(weight[atoms.index.get_level_values(0)].to_numpy(), 3)
    m = eam.force_moments(spark, sf_dir)
    assert m.n == len(t) and np.allclose(m.gram, x.T @ (w[:, None] * x)) and np.allclose(m.xty, x.T @ (w * t)) and np.isclose(m.tt, w @ (t * t))
    n = eam.energy_moments(spark, sf_dir)
    monkeypatch.setattr(eam, "force_moments", lambda *_: m)
    monkeypatch.setattr(eam, "energy_moments", lambda *_: n)
    want = e.log_joint(np.array(eam.WEIGHTS), np.full(eam.N_COLUMNS, eam.ALPHA), eam.BETA_E, eam.BETA_F, n, m, n.n)
    assert np.isclose(registry.QUERIES["eam_log_joint"](spark, sf_dir).first()[0], want, atol=0.06)
    seen = np.array([r["w"] for r in registry.QUERIES["eam_hyper_update"](spark, sf_dir).where("run = 0").orderBy("col").collect()])
    alone = {r["run"]: r["w"] for r in e.alternating_fit(n, keep=2)}
    both = {r["run"]: r["w"] for r in e.alternating_fit(n, m, keep=2)}
    assert np.allclose(seen, both[0]) and not np.allclose(seen, alone[0])
    w = np.linalg.solve(np.diag(np.full(eam.N_COLUMNS, eam.ALPHA)) + eam.BETA_E * n.gram + eam.BETA_F * m.gram, eam.BETA_E * n.xty + eam.BETA_F * m.xty)
    got = {r["col"]: r["w"] for r in registry.QUERIES["eam_map_fit"](spark, sf_dir).collect()}
    assert np.allclose([got[c] for c in range(eam.N_COLUMNS)], w, atol=1e-4)
