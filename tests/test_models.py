"""Fits on moments against dense algebra, forces against differences, streams against batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.functions.basis import basis_sizes
from latticeworks.operators import eam, tables
from latticeworks.operators import regression as rg
from latticeworks.streaming import moments as stream


def design(spark, n=300, m=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, m))
    t = 2 * x[:, 2] - 1.5 * x[:, min(7, m - 1)] + 0.01 * rng.normal(size=n)
    return x, t, spark.createDataFrame([(i, r.tolist(), float(y)) for i, (r, y) in enumerate(zip(x, t, strict=True))], "obs_id long, phi array<double>, t double")


def test_moments_and_sparse_fit(spark):
    x, t, df = design(spark)
    m = rg.Moments.of(rg.gram_rows(df))
    assert np.allclose(m.gram, x.T @ x) and np.allclose(m.xty, x.T @ t) and m.n == len(t)
    for options in ({}, {"beta_rule": "all_columns"}, {"sequential": True}):
        fit = rg.Rvm(**options).fit(m)
        assert {2, 7} <= set(fit.active) and abs(fit.weights[2] - 2) < 0.01 and abs(fit.weights[7] + 1.5) < 0.01
    assert set(np.flatnonzero(rg.orthogonal_matching_pursuit(m, 2))) == {2, 7}
    w, *_ = rg.bayesian_ridge(m)
    assert np.allclose(w, np.linalg.lstsq(x, t, rcond=None)[0], atol=1e-2)


def test_predict_std(spark):
    x, _, df = design(spark, 20, 4)
    cov = np.diag([1.0, 2, 3, 4])
    got = rg.predict(df, np.arange(4.0), cov, 2.0).orderBy("obs_id").select("mean", "std").toPandas()
    assert np.allclose(got["mean"], x @ np.arange(4.0)) and np.allclose(got["std"], np.sqrt(np.einsum("ni,ij,nj->n", x, cov, x) + 0.5))


def test_stream_equals_batch(spark, tmp_path):
    _, _, df = design(spark, 100, 3)
    df.repartition(3).write.parquet(str(tmp_path / "rows"))
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    stream.stream_gram(rows, str(tmp_path / "gram"), str(tmp_path / "checkpoint")).awaitTermination(120)
    a, b = (rg.Moments.of(g) for g in (stream.stored_gram(spark, str(tmp_path / "gram")), rg.gram_rows(df)))
    assert np.allclose(a.gram, b.gram) and a.n == b.n == 100


def test_map_weights_are_the_optimum():
    rng = np.random.default_rng(0)
    x, f = rng.normal(size=(40, 5)), rng.normal(size=(90, 5))
    t, u = rng.normal(size=40), rng.normal(size=90)
    e, g = (rg.Moments(a.T @ a, a.T @ b, b @ b, b.sum(), len(b)) for a, b in ((x, t), (f, u)))
    alpha = np.full(5, 0.3)
    w = eam.map_weights(alpha, 1.1, 0.4, e, g)
    best = eam.log_joint(w, alpha, 1.1, 0.4, e, g, 40)
    assert all(eam.log_joint(w + 0.01 * rng.normal(size=5), alpha, 1.1, 0.4, e, g, 40) < best for _ in range(200))
    held = eam.map_weights(alpha, 1.1, 0.4, e, g, {1: 0.5})
    assert held[1] == 0.5 and eam.log_joint(held, alpha, 1.1, 0.4, e, g, 40) < best


def test_spline_of_a_cubic_is_exact():
    x = np.linspace(0, 2, 9)
    c = tables.cubic_spline(x, x**3 - x)
    t = 0.1
    assert np.allclose(c[:, 0] + t * (c[:, 1] + t * (c[:, 2] + t * c[:, 3])), (x[:-1] + t) ** 3 - x[:-1] - t)


def test_forces_are_slopes_of_the_energy(spark):
    """Analytic forces of both terms against differences of the total energy."""
    from latticeworks.operators import neighbours as nb
    from test_geometry import cells

    rng = np.random.default_rng(5)
    pos, cell, w = rng.random((4, 3)), np.array([[3.4, 0, 0], [0.4, 3.3, 0], [0, 0.5, 3.6]]), rng.normal(size=12)
    form = eam.Form(2, 9.0, 3.1, 0.3, 0.4)
    blocks = spark.createDataFrame([("emb", "A", 0), ("emb", "B", 2), ("pair", "A-A", 4), ("pair", "A-B", 6), ("pair", "B-B", 8)], "kind string, key string, start int")
    f = lambda r, s: F.when(s == "A", 0.7).otherwise(1.1) * F.exp(-0.8 * r)
    df = lambda r, s: -0.8 * f(r, s)
    shifts = [(0, 0, 0.0)] + [(a, d, s) for a in range(2) for d in range(3) for s in (1e-4, -1e-4)]
    rows = []
    for k, (a, d, s) in enumerate(shifts):
        p = pos @ cell
        p[a, d] += s
        rows += [(k, i, "AB"[i % 2], *map(float, q)) for i, q in enumerate((p @ np.linalg.inv(cell)) % 1.0)]
    atoms = spark.createDataFrame(rows, "structure_id long, atom_index long, species string, u double, v double, w double")
    near = nb.neighbours(nb.atom_centres(atoms), atoms, cells(spark, [(k, cell) for k in range(len(shifts))]), 3.1)
    near = near.withColumn("y", f(F.col("r"), F.col("neigh_species"))).withColumn("dy", df(F.col("r"), F.col("neigh_species")))
    weights = spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "col int, w double")
    energy = {r.structure_id: r.e * 4 for r in eam.weighted(eam.energy_design(near, atoms, blocks, form), ["structure_id"], weights, "e").collect()}
    force = {(r.atom_index, r.axis): r.f for r in eam.weighted(eam.force_design(near, blocks, form), ["structure_id", "atom_index", "axis"], weights, "f").where("structure_id = 0").collect()}
    same = {(r.atom_index, r.axis): r.f for r in eam.forces(near, blocks, form, list(map(float, w))).where("structure_id = 0").collect()}
    assert same == pytest.approx(force)
    for k in range(1, len(shifts), 2):
        a, d, s = shifts[k]
        assert force[(a, d)] == pytest.approx(-(energy[k] - energy[k + 1]) / (2 * s), abs=1e-4)


def test_forces_of_the_older_form_are_slopes_of_its_energy(spark):
    """With atoms that are their own neighbours' images; energies against plain loops, an atom without neighbours has none."""
    from latticeworks.operators import neighbours as nb
    from test_geometry import cells

    rng = np.random.default_rng(9)
    cut, pos, cell = 3.1, rng.random((4, 3)), np.array([[3.2, 0, 0], [0.3, 3.4, 0], [0, 0.4, 2.9]])
    draw = lambda: [float(x) for x in rng.normal(size=3)]
    form = eam.DampedSeries({"A": draw(), "B": draw()}, {"A-A": draw(), "A-B": draw()}, cut)  # B-B gives nothing
    shifts = [(0, 0, 0.0)] + [(a, d, s) for a in range(2) for d in range(3) for s in (1e-4, -1e-4)]
    rows, alone = [], len(shifts)
    for k, (a, d, s) in enumerate(shifts):
        p = pos @ cell
        p[a, d] += s
        rows += [(k, i, "AB"[i % 2], *map(float, q)) for i, q in enumerate((p @ np.linalg.inv(cell)) % 1.0)]
    atoms = spark.createDataFrame([*rows, (alone, 0, "A", 0.5, 0.5, 0.5)], "structure_id long, atom_index long, species string, u double, v double, w double")
    near = nb.neighbours(nb.atom_centres(atoms), atoms, cells(spark, [*((k, cell) for k in range(alone)), (alone, 9 * np.eye(3))]), cut)
    near = near.withColumn("y", F.when(F.col("neigh_species") == "A", 0.07).otherwise(0.02) * F.exp(-0.8 * F.col("r"))).withColumn("dy", -0.8 * F.col("y"))
    whole = {r.structure_id: r for r in eam.legacy_structure_energies(near, atoms, form).collect()}
    force = {(r.atom_index, r.axis): r.f for r in eam.legacy_forces(near, form).where("structure_id = 0").collect()}
    for k in range(1, alone, 2):
        a, d, s = shifts[k]
        assert force[a, d] == pytest.approx(-4 * (whole[k].energy - whole[k + 1].energy) / (2 * s), abs=2e-4)
    damp = lambda x: (10 * x) ** 4 / (1 + (10 * x) ** 4)
    series = lambda w, x: sum(c * np.cos(k * x) for k, c in enumerate(w))
    rho, pair = dict.fromkeys(range(4), 0.0), dict.fromkeys(range(4), 0.0)
    for r in near.where("structure_id = 0").collect():
        rho[r.centre_id] += r.y
        pair[r.centre_id] += damp(r.r - cut) * series(form.pair.get("-".join(sorted((r.centre_species, r.neigh_species))), []), r.r) / 2
    own = {r.atom_index: r for r in eam.legacy_atom_energies(near, atoms, form).where("structure_id = 0").collect()}
    for i in range(4):
        assert (own[i].embedding, own[i].pair) == (pytest.approx(damp(rho[i]) * series(form.emb["AB"[i % 2]], rho[i])), pytest.approx(pair[i]))
    assert whole[0].energy == pytest.approx(sum(r.energy for r in own.values()) / 4) and whole[0].n_atoms == 4
    assert (whole[alone].n_atoms, whole[alone].energy) == (1, 0.0)


def test_repeated_fits(spark):
    """Every run against numpy, runs of unequal size and any name; one run has no spread."""
    rng = np.random.default_rng(3)
    data = {k: (rng.normal(size=(n, 3)), rng.normal(size=n)) for k, n in (("a", 40), ("b", 7), ("c", 3))}
    rows = [(k, x.tolist(), float(t)) for k, (xs, ts) in data.items() for x, t in zip(xs, ts, strict=True)]
    design = spark.createDataFrame(rows, "run string, phi array<double>, t double").repartition(5)
    fits = rg.replicated(design, 0.2)
    want = {k: np.linalg.solve(x.T @ x + 0.2 * np.eye(3), x.T @ t) for k, (x, t) in data.items()}
    assert {(r.run, r.i): r.w for r in fits.collect()} == pytest.approx({(k, i): w[i] for k, w in want.items() for i in range(3)})
    all_ = np.array(list(want.values()))
    got = {r.i: r for r in rg.replicate_summary(fits).collect()}
    assert [got[i].mean for i in range(3)] == pytest.approx(all_.mean(0)) and [got[i].spread for i in range(3)] == pytest.approx(2 * all_.std(0, ddof=1)) and got[0].runs == 3
    assert [r.spread for r in rg.replicate_summary(fits.where("run = 'a'")).collect()] == [None] * 3
    assert rg.replicated(design.limit(0)).count() == 0


def test_arguments():
    assert basis_sizes(3) == {k: {"r": 3, "theta": 3} for k in ("like", "unlike")}
    with pytest.raises(ValueError):
        basis_sizes({"like": 3})
    with pytest.raises(ValueError):
        basis_sizes("x")


def direct_rvm(x, t, rounds=400):
    """Sparse Bayesian regression on the rows themselves, one column of evidence at a time."""
    n, size = x.shape
    alpha, beta = np.where(np.arange(size) == 0, 1.0, np.inf), 1 / np.var(t)
    w = np.zeros(size)
    for _ in range(rounds):
        on = np.flatnonzero(np.isfinite(alpha))
        cov = np.linalg.inv(beta * x[:, on].T @ x[:, on] + np.diag(alpha[on]))
        new = np.zeros(size)
        new[on] = beta * cov @ x[:, on].T @ t
        if np.abs(new - w).sum() < 1e-6 and w.any():
            break
        w = new
        c = np.eye(n) / beta + (x[:, on] / alpha[on]) @ x[:, on].T
        s, q = np.einsum("ni,ni->i", x, np.linalg.solve(c, x)), x.T @ np.linalg.solve(c, t)
        own = np.isfinite(alpha)
        f = np.where(own, alpha / np.where(own, alpha - s, 1.0), 1.0) if own.any() else np.ones(size)
        f[~own] = 1.0
        s, q = s * f, q * f
        after = np.where(q * q > s, s * s / np.maximum(q * q - s, 1e-300), np.inf)
        still = own & np.isfinite(after)
        gamma = dict(zip(on, np.diag(cov), strict=True))
        beta = max(n - own.sum() + sum(after[k] * gamma[k] for k in np.flatnonzero(still)), 1e-3) / ((t - x @ new) ** 2).sum()
        alpha = after
    return w


def test_sparse_fit_equals_the_direct_one(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 8))
    t = x @ np.array([0, 1.5, 0, 0, -2.0, 0, 0, 0.7]) + 0.3 * rng.normal(size=120)
    m = rg.Moments(x.T @ x, x.T @ t, t @ t, t.sum(), len(t), x.sum(0))
    fit = rg.Rvm().fit(m)
    assert np.allclose(fit.weights, direct_rvm(x, t), atol=1e-3)
    assert fit.log[-1]["step"] < 299 and np.isclose(fit.sse, ((t - x @ fit.weights) ** 2).sum())
    assert np.isclose(m.log_likelihood(fit.weights, 2.0), sum(0.5 * np.log(2 / (2 * np.pi)) - (a - b) ** 2 for a, b in zip(t, x @ fit.weights, strict=True)))
    for options in ({}, {"normalise": True}):
        with_offset = rg.Rvm(intercept=True, alpha=np.ones(8), **options).fit(rg.Moments(x.T @ x, x.T @ (t + 5), (t + 5) @ (t + 5), (t + 5).sum(), len(t), x.sum(0)))
        assert abs(with_offset.offset - 5) < 0.2 and np.allclose(with_offset.weights, fit.weights, atol=0.15)
    assert np.allclose(rg.Rvm(update_pct=0.5, rounds=600).fit(m).weights, fit.weights, atol=0.1)
    with pytest.raises(ValueError):
        rg.Rvm(update_pct=2.0).fit(m)
    calls = []
    assert rg.Rvm(converged=lambda new, old, model: calls.append(1) or len(calls) == 3, alpha=lambda k: np.ones(k), beta=lambda m: 2.0).fit(m).log[-1]["step"] == 3


def test_comparison_fits(spark):
    """Lasso and elastic net by coordinate descent; Huber ignores an outlier."""
    x, t, _ = design(spark, 150, 5)
    t[0] += 500
    df = spark.createDataFrame([(r.tolist(), float(y)) for r, y in zip(x, t, strict=True)], "phi array<double>, t double")
    got = {}
    for r in rg.comparison_fits(df, 0.2, 0.5).collect():
        got.setdefault(r.model, np.zeros(5))[r.col] = r.w
    for name, mix in (("lasso", 1.0), ("elastic_net", 0.5)):
        w = np.zeros(5)
        for _ in range(500):
            for k in range(5):
                rho = x[:, k] @ (t - x @ w + x[:, k] * w[k]) / len(t)
                w[k] = np.sign(rho) * max(abs(rho) - 0.2 * mix, 0) / (x[:, k] @ x[:, k] / len(t) + 0.2 * (1 - mix))
        assert np.allclose(got[name], w, atol=1e-3)
    assert abs(got["huber"][2] - 2) < 0.05 and abs(got["huber"][4] + 1.5) < 0.05


def test_setup_checks_its_arguments(spark):
    atoms = spark.createDataFrame([(1, 0, "A", 0.0, 0.0, 0.0)], "structure_id long, atom_index long, species string, u double, v double, w double")
    structures, cells_ = atoms.select("structure_id", F.lit("S").alias("name")), atoms.select("structure_id")
    for r_cut, k in ((None, None), (2.0, 3), (-1.0, None), (None, 0)):
        with pytest.raises(ValueError):
            eam.observations(structures, atoms, cells_, atoms, None, r_cut, k)
    with pytest.raises(ValueError, match="selected"):
        eam.observations(structures, atoms, cells_, atoms, None, 2.0, None, [("none", ("all",))])
