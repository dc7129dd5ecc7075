"""One group that holds all rows: quantiles, nearness, samples and forms against direct versions."""

import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.operators import eam, quantiles, regression, sampling


def specs(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x.split("specifiedwindowframe")[0] for x in plan.split("windowspecdefinition(")[1:]]


# --- quantiles ---


def samples():
    rng = np.random.default_rng(7)
    return {
        "normal": rng.standard_normal(5001), "skewed": np.exp(40 * rng.standard_normal(3000)), "constant": np.full(700, 2.5), "tied": rng.integers(0, 3, 999).astype(float), "one": np.array([3.25]), "two": np.array([1.0, 2.0]),
        "wide": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1.0]), "zeros": np.array([0.0, -0.0, 0.0, -0.0]), "infinite": np.array([-np.inf, -np.inf, 1.0, 2.0, np.inf, np.inf, np.inf]), "signs": np.concatenate([-np.exp(rng.standard_normal(400) * 9), np.exp(rng.standard_normal(401) * 9)]),
    }


@pytest.mark.parametrize("bins", [2048, 3])
def test_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    groups = {k: v for k, v in samples().items() if bins > 3 or len(v) < 800}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("normal", None), ("nothing", None)] + [(None, float(x)) for x in range(10)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"lo": 0.0, "q1": 0.1, "median": 0.5, "q9": 0.93, "hi": 1.0}
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], {n: (F.col("x"), q) for n, q in shares.items()}).collect()}
    assert set(got) == set(groups) | {None}
    for k, v in {**groups, None: np.arange(10.0)}.items():
        v = np.sort(v)
        for n, q in shares.items():
            at = q * (len(v) - 1)
            i, j = int(np.floor(at)), int(np.ceil(at))
            want = v[i] if i == j or v[i] == v[j] else v[i] + (at - i) * (v[j] - v[i])
            assert got[k][n] == pytest.approx(want, rel=1e-12), (k, n)


def test_quantiles_with_nan_last(spark):
    df = spark.createDataFrame([(1, x) for x in (3.0, float("nan"), 1.0, 2.0, float("nan"))], "g int, x double")
    r = quantiles.quantiles(df, ["g"], {"median": (F.col("x"), 0.5), "hi": (F.col("x"), 1.0)}).first()
    assert r.median == 3.0 and np.isnan(r.hi)
    assert quantiles.quantiles(df.limit(0), ["g"], {"median": (F.col("x"), 0.5)}).count() == 0


def test_fit_quality_of_one_model(spark):
    df = spark.range(20_000).select(F.lit("m").alias("model"), (F.pow(F.col("id") % 997, 3) / 1e6).alias("t"), (F.col("id") % 13).cast("double").alias("mean"))
    e = np.array([(i % 997) ** 3 / 1e6 - i % 13 for i in range(20_000)])
    q, m = regression.fit_quality(df, ["model"], "t", "mean").first(), regression.regression_metrics(df, ["model"], "t", "mean").first()
    assert q.n == 20_000 and q.median2 == pytest.approx(np.median(e) ** 2) and m.median_ae == pytest.approx(np.median(np.abs(e))) and q.mse == pytest.approx((e * e).mean())


# --- nearness ---


def cloud(spark, n_points, n_atoms, seed=3):
    rng = np.random.default_rng(seed)
    cell = np.array([[9.0, 0.0, 0.0], [1.0, 8.0, 0.0], [0.0, 2.0, 7.0]])
    p, a = rng.random((n_points, 3)), rng.random((n_atoms, 3)) ** 2  # atoms crowd in a corner
    points = spark.createDataFrame([(1, k, *map(float, x)) for k, x in enumerate(p)], "structure_id long, point_id long, u double, v double, w double")
    atoms = spark.createDataFrame([(1, k, "A", *map(float, x)) for k, x in enumerate(a)], "structure_id long, atom_index long, species string, u double, v double, w double")
    cells = spark.createDataFrame([(1, *map(float, cell.ravel()))], "structure_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    return points, atoms, cells, p @ cell, a @ cell


def test_nearness_by_bins(spark):
    points, atoms, cells, p, a = cloud(spark, 3000, 200)
    d = np.sqrt(((a[:, None] - p) ** 2).sum(2))
    ids = lambda df: {r.point_id for r in df.collect()}
    for r in (0.05, 0.7, 30.0):
        assert ids(sampling.near_atoms(points, atoms, cells, r)) == set(np.flatnonzero((d <= r).any(0)))
    for n in (1, 4, 2999, 5000):
        some = atoms.where("atom_index < 5") if n > 100 else atoms
        dist = d[:5] if n > 100 else d
        assert ids(sampling.nearest_of_atoms(points, some, cells, n)) == set(np.argsort(dist, axis=1)[:, :n].ravel())


def test_nearest_with_ties_and_far_points(spark):
    cells = spark.createDataFrame([(k, 10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0) for k in (1, 2, 3)], "structure_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    points = [(1, 1, 0.1, 0.0, 0.0), (1, 2, 0.0, 0.1, 0.0), (1, 3, 0.0, 0.0, 0.1), (1, 4, 0.2, 0.0, 0.0), (2, 5, 0.99, 0.99, 0.99), (2, 6, 0.98, 0.99, 0.99), (3, 7, -0.4, 1.3, 0.5)]
    points = spark.createDataFrame(points, "structure_id long, point_id long, u double, v double, w double")
    atoms = spark.createDataFrame([(1, 0, "A", 0.0, 0.0, 0.0), (2, 0, "A", 0.0, 0.0, 0.0), (3, 0, "A", 0.9, 0.1, 0.0), (4, 0, "A", 0.0, 0.0, 0.0)], "structure_id long, atom_index long, species string, u double, v double, w double")
    assert sorted(r.point_id for r in sampling.nearest_of_atoms(points, atoms, cells, 1, ties=True).collect()) == [1, 2, 3, 6, 7]
    assert sorted(r.point_id for r in sampling.nearest_of_atoms(points, atoms, cells, 2).collect()) == [1, 2, 5, 6, 7]


def test_a_large_structure(spark):
    """10^5 points and 10^4 atoms: no pair of all with all is made."""
    rng = np.random.default_rng(1)
    make = lambda n, key: spark.range(n).select(F.lit(1).cast("long").alias("structure_id"), F.col("id").alias(key), *(F.rand(int(rng.integers(99))).alias(x) for x in "uvw"))
    points, atoms = make(100_000, "point_id"), make(10_000, "atom_index")
    cells = spark.createDataFrame([(1, 40.0, 0.0, 0.0, 0.0, 40.0, 0.0, 0.0, 0.0, 40.0)], "structure_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    start = time.time()
    met = sampling.within_reach(points, atoms, cells.withColumn("reach", F.lit(0.5)))
    assert 4_000 < met.count() < 20_000  # of 10^9 pairs
    assert sampling.nearest_of_atoms(points, atoms, cells, 2).count() > 15_000
    assert time.time() - start < 90


# --- samples ---


def test_samples_of_one_large_structure(spark):
    """The rows that one window over the whole structure gives, from windows over shares of it."""
    n = 150_000
    points = spark.range(n).select(F.lit(5).cast("long").alias("structure_id"), (F.col("id") * 3).alias("point_id"), (F.col("id") * 7919 % 1009 / 10.0).alias("density"))
    whole = Window.partitionBy("structure_id")
    random = sampling.with_replacement(points, "structure_id", "point_id", 40)
    got = {(r.draw, r.point_id) for r in random.collect()}
    assert got == {(d, 3 * int(((((d * 31 + 5) * 7919 + 104729) % 1000003) + 0.5) / 1000003 * n)) for d in range(40)}
    weighed = sampling.by_importance(points, "structure_id", "point_id", "density", 1500)
    score = F.when(F.col("gain") > 0, F.round(-F.log(sampling.uniform(F.col("point_id"))) / F.col("gain"), 9)).otherwise(F.lit(float("inf")))
    plain = points.withColumn("gain", F.col("density") - F.min("density").over(whole)).withColumn("r", F.row_number().over(whole.orderBy(score, "point_id"))).where("r <= 1500")
    assert {r.point_id for r in weighed.collect()} == {r.point_id for r in plain.collect()}
    few = sampling.subsample(points, "structure_id", "point_id", 1200, 9)
    plain = points.withColumn("r", F.row_number().over(whole.orderBy((F.col("point_id") * 7919 + 9) % 1000003, "point_id"))).where("r <= 1200")
    assert {r.point_id for r in few.collect()} == {r.point_id for r in plain.collect()}
    assert any("_range" in x for x in specs(random)) and all("_share" in specs(x)[-1] or "_share" in specs(x)[0] for x in (weighed, few))
    # a share of the structure, not all of it, meets in a task
    dealt = points.withColumn("s", F.pmod(F.xxhash64(*points.columns), F.lit(sampling.SHARES))).groupBy("s").count().agg(F.max("count")).first()[0]
    assert dealt < 1.2 * n / sampling.SHARES


# --- forms ---


def test_forms_of_a_thousand_columns(spark):
    m = 1000
    rng = np.random.default_rng(0)
    a = rng.standard_normal((m, m))
    a = a @ a.T / m
    b = rng.standard_normal(m)
    x = rng.standard_normal((6, m))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(6, None), (7, [])], "id long, phi array<double>").withColumn("mean", F.lit("old"))
    start = time.time()
    made = regression.predict(df, b, a, 4.0)
    made._jdf.queryExecution().executedPlan()
    assert time.time() - start < 5
    got = {r.id: r for r in made.collect()}
    for k, r in enumerate(x):
        assert got[k]["mean"] == pytest.approx(b @ r) and got[k]["std"] == pytest.approx(np.sqrt(r @ a @ r + 0.25))
    assert got[6]["mean"] is None and got[7]["std"] is None
    moments = regression.Moments(a, b, 3.0, 0.0, 10.0)
    names = [f"w{k}" for k in range(40)]
    small = regression.Moments(a[:40, :40], b[:40], 3.0, 0.0, 10.0)
    c = spark.createDataFrame([tuple(map(float, r[:40])) for r in x], ", ".join(f"{n} double" for n in names))
    both = eam.score(c, names, small, small, lambda e, f, w: e + 2 * f + w, "total").collect()
    for r, w in zip(sorted(both, key=lambda r: r["w0"]), sorted(x[:, :40].tolist()), strict=True):
        assert r["total"] == pytest.approx(3 * small.sse(np.array(w)) + np.dot(w, w))
    assert "_x" not in both[0].asDict() and moments.n == 10
