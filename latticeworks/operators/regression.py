"""Linear models on sufficient statistics: Gram matrices on the cluster, small dense solves on the driver.

Gram matrices add, so a fit never reads the data twice, and batches can be appended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .quantiles import quantiles

GRAM_DDL = "i int, j int, g double"


def triangle(x: np.ndarray) -> pa.RecordBatch:
    """(i, j, g): entries i <= j of x'x."""
    i, j = np.triu_indices(x.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array((x.T @ x)[i, j])], ["i", "j", "g"])


def gram_rows(design: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, g) of design (phi array<double>, t double): entries i <= j of the Gram matrix of [phi, t, 1].

    Each task reduces its rows to one matrix per batch; the shuffle carries matrices, not rows.
    """
    by = by or []
    kinds = design.select(*by).schema

    def reduce(batches):
        for b in batches:
            if not len(b):
                continue
            phi = b.column(len(by))
            x = np.array(phi.values.to_numpy(zero_copy_only=False)[phi.offsets[0].as_py() : phi.offsets[-1].as_py()]).reshape(len(b), -1)
            x = np.column_stack([x, b.column(len(by) + 1).to_numpy(zero_copy_only=False), np.ones(len(b))])
            groups = list(zip(*(b.column(k).to_pylist() for k in range(len(by))), strict=True)) if by else [()] * len(b)
            names, at = (list(dict.fromkeys(groups)), None) if by else ([()], None)
            at = np.array([names.index(g) for g in groups]) if len(names) > 1 else np.zeros(len(b), int)
            i, j = np.triu_indices(x.shape[1])
            for k, name in enumerate(names):
                own = x[at == k]
                g = (own.T @ own)[i, j]
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(i), b.schema.field(n).type) for n, v in enumerate(name)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g)], [*by, "i", "j", "g"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields] + [GRAM_DDL])
    return design.select(*by, "phi", "t").mapInArrow(reduce, schema).groupBy(*by, "i", "j").agg(F.sum("g").alias("g"))


@dataclass
class Moments:
    """gram = phi' phi, xty = phi' t, tt = t' t, st = sum of t, n rows, sums of the columns."""

    gram: np.ndarray
    xty: np.ndarray
    tt: float
    st: float
    n: float
    sums: np.ndarray | None = None

    @classmethod
    def of(cls, rows: DataFrame) -> Moments:
        """From gram_rows: a matrix of the number of columns, whatever the number of rows."""
        return cls.of_table(rows.select("i", "j", "g").toArrow())

    @classmethod
    def of_table(cls, t: pa.Table) -> Moments:
        i, j, g = (t.column(k).combine_chunks().to_numpy() for k in ("i", "j", "g"))
        full = np.zeros((int(j.max()) + 1,) * 2)
        full[i, j] = full[j, i] = g
        return cls(full[:-2, :-2], full[:-2, -2], full[-2, -2], full[-2, -1], full[-1, -1], full[:-2, -1])

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.gram + other.gram, self.xty + other.xty, self.tt + other.tt, self.st + other.st, self.n + other.n, self.sums + other.sums if self.sums is not None and other.sums is not None else None)

    def sse(self, w: np.ndarray) -> float:
        return float(self.tt - 2 * w @ self.xty + w @ self.gram @ w)

    def variance(self) -> float:
        return self.tt / self.n - (self.st / self.n) ** 2

    def log_likelihood(self, w: np.ndarray, beta: float) -> float:
        """Of weights under Gaussian noise of precision beta."""
        return 0.5 * self.n * np.log(beta / (2 * np.pi)) - 0.5 * beta * self.sse(w)

    def centred(self, normalise: bool = False) -> tuple[Moments, np.ndarray]:
        """Moments of columns and target less their means, and the columns' scales: their norms with normalise, else 1."""
        g = self.gram - np.outer(self.sums, self.sums) / self.n
        scale = np.sqrt(np.maximum(np.diag(g), 1e-300)) if normalise else np.ones(len(g))
        return Moments(g / np.outer(scale, scale), (self.xty - self.sums * self.st / self.n) / scale, self.tt - self.st**2 / self.n, 0.0, self.n, np.zeros(len(g))), scale


def ridge(m: Moments, alpha: float | np.ndarray) -> np.ndarray:
    return np.linalg.solve(m.gram + np.diag(np.broadcast_to(alpha, len(m.xty))), m.xty)


def replicated(design: DataFrame, alpha: float = 0.0) -> DataFrame:
    """(run, i, w): the ridge weights of every run of design (run, phi, t), whose rows are the same observations with fresh noise or others.

    Runs are reduced to matrices in one pass over all rows; each is then solved by itself, so a task holds one matrix of the columns.
    """

    def solve(t: pa.Table) -> pa.Table:
        w = ridge(Moments.of_table(t), alpha)
        return pa.table({"run": pa.array([t.column("run")[0].as_py()] * len(w), t.schema.field("run").type), "i": pa.array(np.arange(len(w)), pa.int32()), "w": pa.array(w)})

    return gram_rows(design, ["run"]).groupBy("run").applyInArrow(solve, f"run {design.schema['run'].dataType.simpleString()}, i int, w double")


def replicate_summary(fits: DataFrame) -> DataFrame:
    """(i, runs, mean, spread) of each column over the runs of replicated: mean and twice the sample deviation, which one run has not."""
    return fits.groupBy("i").agg(F.count("*").alias("runs"), F.avg("w").alias("mean"), (2 * F.stddev_samp("w")).alias("spread"))


def posterior(m: Moments, alpha: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the weights."""
    cov = np.linalg.inv(beta * m.gram + np.diag(alpha))
    return beta * cov @ m.xty, cov


def mackay_update(m: Moments, alpha: np.ndarray, beta: float) -> tuple[np.ndarray, float]:
    w, cov = posterior(m, alpha, beta)
    gamma = 1 - alpha * np.diag(cov)
    return gamma / np.maximum(w * w, 1e-300), (m.n - gamma.sum()) / max(m.sse(w), 1e-300)


@dataclass
class Rvm:
    """Sparse Bayesian regression on moments. alpha of infinity means that a column is out.

    beta_rule: `active` divides N - |active| + sum alpha A by the squared error, `all_columns` N - M + sum alpha A. sequential updates
    one alpha a step, that with the largest gain of evidence. converged is called with (new weights, old weights, self). update_pct is
    the share of columns, drawn anew each round, whose alpha may change. intercept fits on centred columns (with normalise of norm 1)
    and gives the weights of the columns as they are, and the intercept.
    """

    tol: float = 1e-6
    rounds: int = 300
    beta_rule: str = "active"
    beta_every: int = 1
    fixed_beta: float | None = None
    sequential: bool = False
    converged: Callable[[np.ndarray, np.ndarray, Rvm], bool] | None = None
    alpha: np.ndarray | Callable[[int], np.ndarray] | None = None
    beta: float | Callable[[Moments], float] | None = None
    update_pct: float = 1.0
    seed: int = 0
    intercept: bool = False
    normalise: bool = False
    log: list[dict] = field(default_factory=list)

    def fit(self, m: Moments) -> Rvm:
        if not 0 <= self.update_pct <= 1:
            raise ValueError("update_pct must lie in [0, 1]")
        whole, rng = m, np.random.default_rng(self.seed)
        if self.intercept:
            m, norms = m.centred(self.normalise)
        size = len(m.xty)
        a = self.alpha(size) if callable(self.alpha) else self.alpha
        a = np.where(np.arange(size) == 0, 1.0, np.inf) if a is None else np.array(a, float)
        b = self.fixed_beta or (self.beta(m) if callable(self.beta) else self.beta) or 1 / max(m.variance(), 1e-300)
        w, best, self.log = np.zeros(size), None, []
        for step in range(self.rounds):
            on = np.isfinite(a)
            cov = np.linalg.inv(b * m.gram[np.ix_(on, on)] + np.diag(a[on]))
            new = np.zeros(size)
            new[on] = b * cov @ m.xty[on]
            sse = max(m.sse(new), 1e-300)
            self.log.append({"step": step, "beta": b, "n_active": int(on.sum()), "mse": sse / m.n})
            if best is None or sse < best[0]:
                best = (sse, new, a.copy(), b, cov)
            if step and (self.converged(new, w, self) if self.converged else not self.sequential and np.abs(new - w).sum() < self.tol):
                break
            w = new
            ga = m.gram[:, on] @ cov
            q = b * m.xty - b * b * ga @ m.xty[on]
            s = b * np.diag(m.gram) - b * b * (ga * m.gram[:, on]).sum(1)
            with np.errstate(all="ignore"):
                scale = np.where(on, a / (a - s), 1.0)
            sq, ss = q * scale, s * scale
            keep = sq * sq > ss
            with np.errstate(all="ignore"):
                after = np.where(keep, ss * ss / np.maximum(sq * sq - ss, 1e-300), np.inf)
            if self.sequential:
                k, gain = self._best_step(a, after, q, s)
                if gain <= self.tol:
                    break
                a[k] = after[k]
            else:
                if self.update_pct < 1:
                    still = rng.permutation(size)[int(size * self.update_pct) :]
                    after[still] = a[still]
                if not np.isfinite(after).any():
                    after[int(np.argmax(sq * sq / np.maximum(ss, 1e-300)))] = 1.0
                a = after
            if self.fixed_beta is None and step % self.beta_every == 0:
                still = on & np.isfinite(a)
                inner = np.zeros(size)
                inner[on] = np.diag(cov)
                n_out = on.sum() if self.beta_rule == "active" else size
                b = max(m.n - n_out + (a[still] * inner[still]).sum(), 1e-3) / sse
        self.sse, self.weights, self.alpha_, self.beta_, self.cov = best
        self.active = np.flatnonzero(np.isfinite(self.alpha_))
        self.offset = 0.0
        if self.intercept:
            self.weights = self.weights / norms
            self.offset = float((whole.st - whole.sums @ self.weights) / whole.n)
        return self

    @staticmethod
    def _best_step(a: np.ndarray, after: np.ndarray, q: np.ndarray, s: np.ndarray) -> tuple[int, float]:
        """The column whose alpha gains most evidence when it alone is set to its best value, and twice that gain."""
        on, keep = np.isfinite(a), np.isfinite(after)
        with np.errstate(all="ignore"):
            add = (q * q - s) / s + np.log(s / (q * q))
            d = 1 / after - 1 / a
            change = np.where(d == 0, 0.0, q * q / (s + 1 / d) - np.log1p(s * d))
            drop = q * q / (s - a) - np.log(1 - s / a) if on.sum() > 1 else np.full(len(a), -np.inf)
        gain = np.where(keep & ~on, add, np.where(keep & on, change, np.where(on, drop, -np.inf)))
        gain = np.where(np.isnan(gain), -np.inf, gain)
        k = int(gain.argmax())
        return k, float(gain[k])


def orthogonal_matching_pursuit(m: Moments, n_columns: int) -> np.ndarray:
    """Weights with at most n_columns non-zero, on moments alone."""
    chosen: list[int] = []
    w = np.zeros(len(m.xty))
    for _ in range(n_columns):
        left = np.abs(m.xty - m.gram @ w) / np.sqrt(np.maximum(np.diag(m.gram), 1e-300))
        left[chosen] = -1
        chosen.append(int(left.argmax()))
        w = np.zeros(len(m.xty))
        w[chosen] = np.linalg.lstsq(m.gram[np.ix_(chosen, chosen)], m.xty[chosen], rcond=None)[0]
    return w


def bayesian_ridge(m: Moments, rounds: int = 100) -> tuple[np.ndarray, float, float]:
    """(weights, alpha, beta) with one alpha for all columns."""
    alpha, beta = 1.0, 1 / max(m.variance(), 1e-300)
    for _ in range(rounds):
        w, cov = posterior(m, np.full(len(m.xty), alpha), beta)
        gamma = len(w) - alpha * np.trace(cov)
        alpha, beta = gamma / max(w @ w, 1e-300), (m.n - gamma) / max(m.sse(w), 1e-300)
    return w, alpha, beta


def comparison_fits(design: DataFrame, reg: float = 0.01, mix: float = 0.5, epsilon: float = 1.35, rounds: int = 200) -> DataFrame:
    """(model, col, w) of lasso, elastic net and Huber regression of design (phi, t) by the cluster's own solvers, without an intercept.

    Lasso and elastic net minimise sse / 2n + reg (mix |w|_1 + (1 - mix) |w|^2 / 2), with mix 1 for the lasso; Huber has no penalty.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    spark, rows = design.sparkSession, design.select(array_to_vector("phi").alias("features"), F.col("t").alias("label"))
    spread = design.agg(F.stddev_samp("t")).first()[0]  # the solver divides the squared part of the penalty by it
    both = reg * (mix + (1 - mix) * spread)
    base = {"solver": "l-bfgs", "fitIntercept": False, "standardization": False, "maxIter": rounds, "tol": 1e-10}
    models = {"lasso": {"regParam": reg, "elasticNetParam": 1.0}, "elastic_net": {"regParam": both, "elasticNetParam": mix * reg / both}, "huber": {"loss": "huber", "epsilon": epsilon}}
    found = [(name, c, float(w)) for name, options in models.items() for c, w in enumerate(LinearRegression(**base, **options).fit(rows).coefficients)]
    return spark.createDataFrame(found, "model string, col int, w double")


def quadratic(rows: DataFrame, column: str, forms: dict[str, tuple[np.ndarray | None, np.ndarray | None, float]]) -> DataFrame:
    """rows with, for each name, x'Ax + b'x + c of an array column x; forms has A, b (None: zero) and c.

    The matrices are of the model's size; they are broadcast once, and a task multiplies a batch at a time. The plan does not grow with them.
    """
    kept = [f for f in rows.schema.fields if f.name not in forms]
    shared = rows.sparkSession.sparkContext.broadcast(forms)
    at = [f.name for f in kept].index(column)

    def make(batches):
        for b in batches:
            x = b.column(at)
            flat = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float)
            full = np.diff(np.asarray(x.offsets)) > 0 if len(b) else np.zeros(0, bool)
            full &= ~np.asarray(x.is_null()) if len(b) else full
            x = flat.reshape(int(full.sum()), -1) if full.any() else np.zeros((0, 0))
            out = []
            for a, v, c in shared.value.values():
                y = np.full(len(b), np.nan)
                if full.any():
                    y[full] = c + (((x @ a) * x).sum(1) if a is not None else 0.0) + (x @ v if v is not None else 0.0)
                out.append(pa.array(y, mask=~full))
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *shared.value])

    own = rows.select(*(f.name for f in kept))
    return own.mapInArrow(make, StructType([*kept, *(StructField(n, DoubleType()) for n in forms)]))


def predict(design: DataFrame, weights: np.ndarray, cov: np.ndarray | None = None, beta: float | None = None) -> DataFrame:
    """design with mean and, given the covariance, std = sqrt(phi' cov phi + 1 / beta). A null or empty phi has null for both."""
    forms = {"mean": (None, np.asarray(weights, float), 0.0)}
    if cov is not None:
        forms["std"] = (np.asarray(cov, float), None, 1 / beta)
    out = quadratic(design, "phi", forms)
    return out if cov is None else out.withColumn("std", F.sqrt("std"))


def scatter(columns: DataFrame, weights: DataFrame) -> DataFrame:
    """Every column's weight, 0 where a fit left it out."""
    return columns.join(weights, "col", "left").select("col", F.coalesce("w", F.lit(0.0)).alias("w"))


def fit_quality(df: DataFrame, by: list[str], t: str, mean: str) -> DataFrame:
    """Counts and moments of residuals by group; the median is exact and found by counting (see quantiles)."""
    e = F.col(t) - F.col(mean)
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(e * e).alias("tse"), F.avg(e * e).alias("mse"), F.min(e).alias("e_min"), F.max(e).alias("e_max"), F.avg(e).alias("e_mean"), F.stddev_samp(e).alias("e_std")
    )
    return sums.join(quantiles(df, by, {"median": (e, 0.5)}), by, "left").withColumn("median2", F.pow("median", 2)).drop("median")


def regression_metrics(df: DataFrame, by: list[str], t: str, mean: str) -> DataFrame:
    e, y = F.col(t) - F.col(mean), F.col(t)
    sums = df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(e).alias("ve"), F.var_pop(y).alias("vy"))
    sums = sums.join(quantiles(df, by, {"median_ae": (F.abs(e), 0.5)}), by, "left")
    return sums.select(*by, "mse", "mae", "median_ae", (1 - F.col("mse") / F.col("vy")).alias("r2"), (1 - F.col("ve") / F.col("vy")).alias("explained_variance"))


def best_iteration(log: DataFrame, by: list[str], score: str) -> DataFrame:
    """The row with the least score, NaN and null left out, the first of equals."""
    rows = log.where(F.col(score).isNotNull() & ~F.isnan(score))
    others = [c for c in log.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct(score, "step")).alias("best")).select(*by, "best.*")


def rank_models(scores: DataFrame, metric: str = "metric", score: str = "score", descending: tuple[str, ...] = ("r2", "explained_variance")) -> DataFrame:
    key = F.when(F.col(metric).isin(*descending), -F.col(score)).otherwise(F.col(score))
    return scores.withColumn("place", F.rank().over(Window.partitionBy(metric).orderBy(key)))
