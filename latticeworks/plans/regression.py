"""Queries: sufficient statistics, fits, predictions and their quality."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from latticeworks.operators import regression as rg
from latticeworks.sources.store import shared_folder
from latticeworks.streaming import moments as stream

from . import views as v
from .registry import query
from .views import r6, with_views

DIM = 64
#: Fixed weights of the queries that predict and score.
W = [((c * 29 + 7) % 23 - 11) / 40 for c in range(DIM)]


def moments(spark, sf_dir) -> rg.Moments:
    return rg.Moments.of(rg.gram_rows(v.vectors(spark, sf_dir)))


GRAM_SQL = with_views("vectors", """, full_ AS (SELECT obs_id, list_concat(phi, [t, 1.0]) AS x FROM vectors), e AS (SELECT obs_id, unnest(x) AS x, unnest(range(66)) AS i FROM full_)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.x * b.x), 5) + 0.0 AS g FROM e a JOIN e b ON a.obs_id = b.obs_id AND a.i <= b.i GROUP BY a.i, b.i""")


@query(GRAM_SQL)
def gram_matrix(spark, sf_dir):
    """Gram matrix of all columns, the target (64) and ones (65)."""
    return rg.gram_rows(v.vectors(spark, sf_dir)).select("i", "j", (F.round("g", 5) + 0.0).alias("g"))


@query(GRAM_SQL)
def gram_incremental(spark, sf_dir):
    """The same from a stream of the table's rows: batches are appended as they come and summed when asked."""
    folder, rows = f"{shared_folder(spark)}/gram-{uuid.uuid4().hex}", v.vectors(spark, sf_dir)
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema).parquet(f"{sf_dir}/embeddings.parquet*")
    design = source.select(*(F.col(c).cast(rows.schema[n].dataType).alias(n) for c, n in (("vec_id", "obs_id"), ("embedding", "phi"), ("label", "t"))))
    stream.stream_gram(design, f"{folder}/rows", f"{folder}/log").awaitTermination()
    return stream.stored_gram(spark, f"{folder}/rows").select("i", "j", (F.round("g", 5) + 0.0).alias("g"))


@query(with_views("vectors", "SELECT round(var_pop(t), 6) + 0.0 AS variance, round(1 / var_pop(t), 6) + 0.0 AS beta, count(*) AS n FROM vectors"))
def target_variance(spark, sf_dir):
    t = v.vectors(spark, sf_dir).agg(F.var_pop("t").alias("variance"), F.count("*").alias("n"))
    return t.withColumn("beta", 1 / F.col("variance")).select("n", *r6("variance", "beta"))


def inverse_sql(name: str, a: str) -> str:
    """, <name>_s AS .., <name>(i, j, v): the inverse of a symmetric positive matrix a(i, j, v) by elimination, in a WITH RECURSIVE."""
    return f""", {name}_o AS (SELECT i, row_number() OVER (ORDER BY i) AS n FROM (SELECT DISTINCT i FROM {a})),
{name}_m AS (SELECT list(r ORDER BY n) AS m FROM (SELECT x.n, list_concat(list(a.v ORDER BY y.n), list(CASE WHEN x.n = y.n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY y.n)) AS r FROM {a} a JOIN {name}_o x ON x.i = a.i JOIN {name}_o y ON y.i = a.j GROUP BY x.n)),
{name}_s(k, m) AS (SELECT 1, m FROM {name}_m UNION ALL SELECT k + 1, list_transform(m, lambda r, n: CASE WHEN n = k THEN list_transform(m[k], lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, c: v - r[k] * m[k][c] / m[k][k]) END) FROM {name}_s WHERE k <= len(m)),
{name} AS (SELECT x.i, y.i AS j, m[x.n][len(m) + y.n] AS v FROM {name}_s, {name}_o x, {name}_o y WHERE k = len(m) + 1)
"""


def solution_sql(name: str, a: str, b: str) -> str:
    """.., <name>(i, w): the solution of a w = b(i, v)."""
    return inverse_sql(f"{name}_inv", a) + f", {name} AS (SELECT x.i, sum(x.v * b.v) AS w FROM {name}_inv x JOIN {b} b ON b.i = x.j GROUP BY x.i) "


FULL_SQL = GRAM_SQL.replace("SELECT CAST(a.i AS INTEGER)", ", half AS (SELECT CAST(a.i AS INTEGER)", 1).replace("round(sum(a.x * b.x), 5) + 0.0 AS g", "sum(a.x * b.x) AS g").replace("WITH ", "WITH RECURSIVE ", 1) + f"""),
full_g AS (SELECT i, j, g FROM half WHERE j < {DIM} UNION ALL SELECT j, i, g FROM half WHERE j < {DIM} AND i < j), b0 AS (SELECT i, g AS v FROM half WHERE i < {DIM} AND j = {DIM}),
one AS (SELECT max(g) FILTER (i = {DIM} AND j = {DIM}) AS tt, max(g) FILTER (i = {DIM + 1} AND j = {DIM + 1}) AS n FROM half)"""


def _ridge_sql(alpha: float) -> str:
    return FULL_SQL + f", a0 AS (SELECT i, j, g + CASE WHEN i = j THEN {alpha} ELSE 0 END AS v FROM full_g)" + solution_sql("fit", "a0", "b0")


def _fitted(spark, *columns, names=("w",)):
    return spark.createDataFrame([(i, *(round(float(x), 6) + 0.0 for x in row)) for i, row in enumerate(zip(*columns, strict=True))], "i int, " + ", ".join(f"{n} double" for n in names))


@query(_ridge_sql(0.0) + "SELECT CAST(i AS INTEGER) AS i, round(w, 6) + 0.0 AS w FROM fit")
def linear_ols(spark, sf_dir):
    """Ordinary least squares from the moments."""
    return _fitted(spark, rg.ridge(moments(spark, sf_dir), 0.0))


@query(_ridge_sql(1.5) + "SELECT CAST(i AS INTEGER) AS i, round(w, 6) + 0.0 AS w FROM fit")
def linear_ridge(spark, sf_dir):
    return _fitted(spark, rg.ridge(moments(spark, sf_dir), 1.5))


@query(FULL_SQL + ", a0 AS (SELECT i, j, 1.2 * g + CASE WHEN i = j THEN 2.0 ELSE 0 END AS v FROM full_g)" + inverse_sql("c0", "a0") + """, w0 AS (SELECT x.i, 1.2 * sum(x.v * b.v) AS w FROM c0 x JOIN b0 b ON b.i = x.j GROUP BY x.i),
gamma AS (SELECT w0.i, 1 - 2.0 * c0.v AS g, w FROM w0 JOIN c0 ON c0.i = w0.i AND c0.j = w0.i), sse AS (SELECT (SELECT tt FROM one) - 2 * (SELECT sum(w * v) FROM w0 JOIN b0 USING (i)) + (SELECT sum(x.w * y.w * g) FROM full_g f JOIN w0 x ON x.i = f.i JOIN w0 y ON y.i = f.j) AS s),
beta AS (SELECT ((SELECT n FROM one) - (SELECT sum(g) FROM gamma)) / s AS b FROM sse), a1 AS (SELECT f.i, f.j, (SELECT b FROM beta) * f.g + CASE WHEN f.i = f.j THEN gamma.g / greatest(gamma.w * gamma.w, 1e-300) ELSE 0 END AS v FROM full_g f JOIN gamma ON gamma.i = f.i)""" + inverse_sql("c1", "a1") + """
SELECT CAST(w0.i AS INTEGER) AS i, round(any_value(w0.w), 6) + 0.0 AS w, round((SELECT b FROM beta) * sum(c1.v * b0.v), 6) + 0.0 AS w_updated, round(sqrt(any_value(d.v)), 6) + 0.0 AS std_updated FROM w0 JOIN c1 ON c1.i = w0.i JOIN b0 ON b0.i = c1.j JOIN c1 d ON d.i = w0.i AND d.j = w0.i GROUP BY w0.i""")
def ridge_posterior(spark, sf_dir):
    """Posterior mean at given hyper-parameters, and mean and deviation after one classic update of them."""
    m = moments(spark, sf_dir)
    first, _ = rg.posterior(m, np.full(DIM, 2.0), 1.2)
    w, cov = rg.posterior(m, *rg.mackay_update(m, np.full(DIM, 2.0), 1.2))
    return _fitted(spark, first, w, np.sqrt(np.diag(cov)), names=("w", "w_updated", "std_updated"))


def _rvm(spark, sf_dir, **options):
    fit = rg.Rvm(rounds=150, **options).fit(moments(spark, sf_dir))
    return spark.createDataFrame([(int(c), float(fit.weights[c]), float(fit.alpha_[c])) for c in fit.active], "col int, w double, alpha double")


@query()
def rvm_fit(spark, sf_dir):
    return _rvm(spark, sf_dir)


@query()
def rvm_fit_v1(spark, sf_dir):
    return _rvm(spark, sf_dir, beta_rule="all_columns", beta_every=2)


@query()
def rvm_fit_sequential(spark, sf_dir):
    return _rvm(spark, sf_dir, sequential=True)


PRED = "list_sum(list_transform(range(1, 65), lambda c: phi[c] * ((((c - 1) * 29 + 7) % 23 - 11) / 40::DOUBLE)))"


@query(with_views("vectors", f"SELECT obs_id, round({PRED}, 6) + 0.0 AS mean, round(sqrt(0.01 * list_sum(list_transform(phi, lambda x: x * x)) + 0.005 * list_sum(phi) ** 2 + 0.5), 6) + 0.0 AS std FROM vectors"))
def predict_mean_std(spark, sf_dir):
    cov = 0.01 * np.eye(DIM) + 0.005 * np.ones((DIM, DIM))
    return rg.predict(v.vectors(spark, sf_dir), np.array(W), cov, 2.0).select("obs_id", *r6("mean", "std"))


@query(with_views("vectors", f"SELECT count(*) AS n, round(0.5 * count(*) * ln(1.3 / (2 * pi())) - 0.65 * sum(pow(t - {PRED}, 2)), 4) + 0.0 AS log_likelihood FROM vectors"))
def weights_log_likelihood(spark, sf_dir):
    m = moments(spark, sf_dir)
    return spark.createDataFrame([(int(m.n), round(float(m.log_likelihood(np.array(W), 1.3)), 4) + 0.0)], "n long, log_likelihood double")


@query()
def comparison_fits(spark, sf_dir):
    """Lasso, elastic net and Huber regression."""
    return rg.comparison_fits(v.vectors(spark, sf_dir)).select("model", "col", *r6("w"))


def predicted(spark, sf_dir):
    out = rg.predict(v.vectors(spark, sf_dir), np.array(W)).withColumn("model", F.lit("full"))
    return out.unionByName(out.withColumn("mean", F.col("mean") * 0.5 + F.col("t") * 0.3).withColumn("model", F.lit("mixed")))


P_SQL = with_views("vectors", f", p AS (SELECT obs_id, t, {PRED} AS mean, 'full' AS model FROM vectors UNION ALL SELECT obs_id, t, {PRED} * 0.5 + t * 0.3, 'mixed' FROM vectors), e AS (SELECT *, t - mean AS e FROM p)\n")


@query(P_SQL + """SELECT model, count(*) AS n, round(sum(e * e), 5) + 0.0 AS tse, round(avg(e * e), 6) + 0.0 AS mse, round(quantile_cont(e, 0.5) ** 2, 6) + 0.0 AS median2, round(min(e), 6) + 0.0 AS e_min, round(max(e), 6) + 0.0 AS e_max,
round(avg(e), 6) + 0.0 AS e_mean, round(stddev_samp(e), 6) + 0.0 AS e_std FROM e GROUP BY model""")
def fit_quality(spark, sf_dir):
    q = rg.fit_quality(predicted(spark, sf_dir), ["model"], "t", "mean")
    return q.select("model", "n", (F.round("tse", 5) + 0.0).alias("tse"), *r6("mse", "median2", "e_min", "e_max", "e_mean", "e_std"))


@query(P_SQL + """SELECT model, round(avg(e) - 1.96 * stddev_samp(e) / sqrt(count(*)), 6) + 0.0 AS mean_lo, round(avg(e) + 1.96 * stddev_samp(e) / sqrt(count(*)), 6) + 0.0 AS mean_hi,
round(var_samp(e) * (1 - 1.96 * sqrt(2 / (count(*) - 1))), 6) + 0.0 AS var_lo, round(var_samp(e) * (1 + 1.96 * sqrt(2 / (count(*) - 1))), 6) + 0.0 AS var_hi FROM e GROUP BY model""")
def residual_intervals(spark, sf_dir):
    """95 % intervals of the residual's mean and variance, for many rows."""
    e = F.col("t") - F.col("mean")
    a = predicted(spark, sf_dir).groupBy("model").agg(F.avg(e).alias("m"), F.stddev_samp(e).alias("s"), F.var_samp(e).alias("v"), F.count("*").alias("n"))
    half, wide = 1.96 * F.col("s") / F.sqrt("n"), 1.96 * F.sqrt(2 / (F.col("n") - 1))
    return a.select("model", (F.col("m") - half).alias("mean_lo"), (F.col("m") + half).alias("mean_hi"), (F.col("v") * (1 - wide)).alias("var_lo"), (F.col("v") * (1 + wide)).alias("var_hi")).select("model", *r6("mean_lo", "mean_hi", "var_lo", "var_hi"))


@query(P_SQL + """SELECT model, round(avg(e * e), 6) + 0.0 AS mse, round(avg(abs(e)), 6) + 0.0 AS mae, round(quantile_cont(abs(e), 0.5), 6) + 0.0 AS median_ae, round(1 - avg(e * e) / var_pop(t), 6) + 0.0 AS r2,
round(1 - var_pop(e) / var_pop(t), 6) + 0.0 AS explained_variance FROM e GROUP BY model""")
def regression_metrics(spark, sf_dir):
    m = rg.regression_metrics(predicted(spark, sf_dir), ["model"], "t", "mean")
    return m.select("model", *r6("mse", "mae", "median_ae", "r2", "explained_variance"))


@query(P_SQL + """, s AS (SELECT model, 'mse' AS metric, avg(e * e) AS score FROM e GROUP BY model UNION ALL SELECT model, 'r2', 1 - avg(e * e) / var_pop(t) FROM e GROUP BY model)
SELECT metric, model, CAST(rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'r2' THEN -score ELSE score END) AS INTEGER) AS place FROM s""")
def rank_models(spark, sf_dir):
    m = rg.regression_metrics(predicted(spark, sf_dir), ["model"], "t", "mean")
    long = m.select("model", F.explode(F.map_from_arrays(F.array(F.lit("mse"), F.lit("r2")), F.array("mse", "r2"))).alias("metric", "score"))
    return rg.rank_models(long).select("metric", "model", "place")


@query("""SELECT user_id, CAST(arg_min(event_id, (value, event_id)) AS BIGINT) AS step, min(value) AS mse FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def best_iteration(spark, sf_dir):
    """Per run the step with the least score; scores of failed steps are NaN."""
    log = v.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("mse"))
    return rg.best_iteration(log, ["user_id"], "mse").select("user_id", "step", "mse")


@query("SELECT o_orderkey AS col, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 ELSE 0 END AS w FROM orders")
def weights_scatter(spark, sf_dir):
    """Full weight vector: fitted columns keep their weight, pruned ones are 0."""
    o = v.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "col")
    return rg.scatter(o.select("col"), o.where("o_orderstatus = 'F'").select("col", (F.col("o_totalprice") / 1000).alias("w")))


@query("""SELECT coalesce(a.k, b.k, c.k) AS col, coalesce(a.w, b.w, c.w) AS w FROM (SELECT o_orderkey AS k, o_totalprice AS w FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT o_orderkey AS k, o_custkey * 1.0::DOUBLE AS w FROM orders WHERE o_orderkey % 3 = 0) b ON a.k = b.k
FULL JOIN (SELECT o_orderkey AS k, 0.0::DOUBLE AS w FROM orders WHERE o_orderkey % 5 <> 1) c ON coalesce(a.k, b.k) = c.k""")
def weights_assemble(spark, sf_dir):
    """One weight per column from pure and mixed fits and defaults, in that order."""
    o = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("col"), "o_totalprice", "o_custkey")
    pure, mixed, default = o.where("col % 2 = 0").select("col", F.col("o_totalprice").alias("w0")), o.where("col % 3 = 0").select("col", F.col("o_custkey").cast("double").alias("w1")), o.where("col % 5 <> 1").select("col", F.lit(0.0).alias("w2"))
    return pure.join(mixed, "col", "full").join(default, "col", "full").select("col", F.coalesce("w0", "w1", "w2").alias("w"))


@query(with_views("vectors", """, runs AS (SELECT unnest(range(4)) AS run), d AS (SELECT run, phi[1] AS x, t + ((obs_id * 7919 + run * 104729) % 1009) / 1009::DOUBLE - 0.5 AS y FROM vectors, runs),
f AS (SELECT run, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM d GROUP BY run)
SELECT round(avg(slope), 5) + 0.0 AS slope, round(2 * stddev_samp(slope), 5) + 0.0 AS slope_2s, round(avg(intercept), 5) + 0.0 AS intercept, round(2 * stddev_samp(intercept), 5) + 0.0 AS intercept_2s FROM f"""))
def replicate_fits(spark, sf_dir):
    """Four fits of one column and an intercept to the target with fresh noise: mean of the weights and twice their deviation."""
    runs = spark.range(4).select(F.col("id").cast("int").alias("run"))
    noise = ((F.col("obs_id") * 7919 + F.col("run") * 104729) % 1009) / 1009.0 - 0.5
    design = v.vectors(spark, sf_dir).join(F.broadcast(runs)).select("run", F.array(F.element_at("phi", 1), F.lit(1.0)).alias("phi"), (F.col("t") + noise).alias("t"))

    def solve(pdf):
        g = pdf.pivot_table(index="i", columns="j", values="g").to_numpy()
        w = np.linalg.solve(np.triu(g[:2, :2]) + np.triu(g[:2, :2], 1).T if not np.isnan(g[:2, :2]).any() else np.array([[g[0, 0], g[0, 1]], [g[0, 1], g[1, 1]]]), g[:2, 2])
        return pdf.iloc[:1][["run"]].assign(slope=w[0], intercept=w[1])

    fits = rg.gram_rows(design, ["run"]).groupBy("run").applyInPandas(solve, "run int, slope double, intercept double")  # a group is one small matrix
    r5 = lambda c, a: (F.round(c, 5) + 0.0).alias(a)
    return fits.agg(r5(F.avg("slope"), "slope"), r5(2 * F.stddev_samp("slope"), "slope_2s"), r5(F.avg("intercept"), "intercept"), r5(2 * F.stddev_samp("intercept"), "intercept_2s"))


@query(FULL_SQL + ", a0 AS (SELECT i, j, g + CASE WHEN i = j THEN 0.5 ELSE 0 END AS v FROM full_g)" + inverse_sql("inv", "a0") + f""", runs AS (SELECT unnest(range(5)) AS run),
noisy AS (SELECT obs_id, run, t + ((obs_id * 7919 + run * 104729) % 1009) / 1009::DOUBLE - 0.5 AS y FROM vectors, runs),
br AS (SELECT run, e.i, sum(e.x * y) AS v FROM e JOIN noisy USING (obs_id) WHERE e.i < {DIM} GROUP BY run, e.i), fr AS (SELECT run, x.i, sum(x.v * br.v) AS w FROM inv x JOIN br ON br.i = x.j GROUP BY run, x.i)
SELECT CAST(i AS INTEGER) AS i, count(*) AS runs, round(avg(w), 5) + 0.0 AS mean, round(2 * stddev_samp(w), 5) + 0.0 AS spread FROM fr GROUP BY i""")
def replicate_fits_columns(spark, sf_dir):
    """Five ridge fits of all columns to the target with fresh noise: mean of each weight and twice its deviation."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run")
    noise = ((F.col("obs_id") * 7919 + F.col("run") * 104729) % 1009) / 1009.0 - 0.5
    design = v.vectors(spark, sf_dir).select("*", runs).withColumn("t", F.col("t") + noise)
    made = rg.replicate_summary(rg.replicated(design, 0.5))
    return made.select("i", "runs", *((F.round(c, 5) + 0.0).alias(c) for c in ("mean", "spread")))
