"""Loss-surface geometry of the linear Bradley-Terry loss (LND-*).

For pairs with feature difference d and weights w, margin m = w.d and
p = sigmoid(m); the Hessian of the mean loss is H = mean[p(1-p) d d^T].
Every operator is a distributed pass over the (cached) pairs:

* Gramian (full H, d <= 2048): one pass, d x d partial sums.
* Hessian-vector products: one pass per product (matrix-free, any d).
* Hutchinson trace: ONE pass for all probes.
* Loss surface: one pass, numpy batch x grid losses summed per partition.

Tabular operators (spectrum summary, explained variance, history) work on a
long spectrum table (run, idx, eigenvalue).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefsight.functions import dot, lit_vector
from prefsight.operators.linalg import MAX_RESULT_ENTRIES, partial_sums, sigmoid_np

MAX_DIM_FULL = 2048


class _Lanczos:
    """One block Lanczos run that is fed the images of its ``fresh`` vectors."""

    def __init__(self, dim: int, k: int, block: int | None, tol: float, seed: int):
        b = min(dim, block or k + 3)
        self.dim, self.k, self.tol = dim, k, tol
        self.fresh, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, b)))
        self.basis, self.image = np.empty((dim, 0)), np.empty((dim, 0))
        self.values: np.ndarray | None = None
        self.done = False

    def take(self, image: np.ndarray) -> None:
        """Add the images of the fresh vectors; settle, or find the next ones."""
        self.basis, self.image = np.hstack([self.basis, self.fresh]), np.hstack([self.image, image])
        small = self.basis.T @ self.image
        values, self._ritz = np.linalg.eigh((small + small.T) / 2)
        top, last = values[::-1][:self.k], self.values
        scale = max(abs(top[0]), 1e-300)
        settled = last is not None and len(last) == len(top) == self.k and np.all(np.abs(top - last) <= self.tol * scale)
        self.values = top
        if settled or self.basis.shape[1] >= self.dim:
            self.done = True
            return
        rest = image
        for _twice in range(2):
            rest = rest - self.basis @ (self.basis.T @ rest)
        q, r = np.linalg.qr(rest)
        self.fresh = q[:, np.abs(np.diag(r)) > 1e-12 * scale][:, :self.dim - self.basis.shape[1]]
        self.done = not self.fresh.shape[1]

    def vectors(self) -> np.ndarray:
        return self.basis @ self._ritz[:, ::-1][:, :self.k]


class Curvature:
    """Curvature passes of the Bradley-Terry loss at weights ``w``.

    The feature-difference column is cached once per analysis; an optional
    seeded ``sample_fraction`` plays the role of the reference's batch cap."""

    def __init__(self, pairs: DataFrame, w, diff_col: str = "d",
                 sample_fraction: float | None = None, seed: int = 0):
        df = pairs.select(F.col(diff_col).alias("d"))
        if sample_fraction:
            df = df.sample(fraction=sample_fraction, seed=seed)
        self.df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.n = self.df.count()
        self.w = np.asarray(w, dtype=np.float64)
        self.dim = self.w.size
        self.passes = 0

    def unpersist(self):
        self.df.unpersist()

    def gramian(self) -> np.ndarray:
        """LND-1: the full Hessian, one pass (refuses d > 2048)."""
        if self.dim > MAX_DIM_FULL:
            raise ValueError(f"d={self.dim} > {MAX_DIM_FULL}: use the matrix-free methods")
        w = self.w

        def fn(X, _):
            p = sigmoid_np(X @ w)
            s = p * (1.0 - p)
            return X.T @ (s[:, None] * X)
        self.passes += 1
        return partial_sums(self.df, "d", (self.dim, self.dim), fn) / max(self.n, 1)

    def hvp(self, V: np.ndarray) -> np.ndarray:
        """LND-2: H @ V for a (d,) vector or (d, k) block, one pass."""
        V = np.asarray(V, dtype=np.float64)
        w = self.w

        def fn(X, _):
            p = sigmoid_np(X @ w)
            s = p * (1.0 - p)
            XV = X @ V
            return X.T @ (s[:, None] * XV) if XV.ndim == 2 else X.T @ (s * XV)
        self.passes += 1
        return partial_sums(self.df, "d", V.shape, fn) / max(self.n, 1)

    def eigenvalues_full(self) -> np.ndarray:
        return np.sort(np.linalg.eigvalsh(self.gramian()))[::-1]

    def krylov(self, k: int, block: int | None = None, max_passes: int = 60, tol: float = 1e-10,
               seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Top-k eigenpairs (values descending, d x k vectors) by block Lanczos.

        All vectors of a block share one ``hvp`` pass; the basis is kept
        orthogonal on the driver (d x passes*block doubles).  Stops when the k
        Ritz values have settled to ``tol`` or the basis spans the space."""
        state = _Lanczos(self.dim, k, block, tol, seed)
        for _ in range(max_passes):
            state.take(self.hvp(state.fresh))
            if state.done:
                break
        return state.values, state.vectors()

    def top_eigenvalues(self, k: int, seed: int = 0) -> list[float]:
        """LND-3: top-k eigenvalues from Hessian-vector products."""
        return self.krylov(k, seed=seed)[0].tolist()

    def top_eigenvalues_svd(self, k: int) -> list[float]:
        """LND-4: squared singular values of the rows sqrt(p(1-p)/n) d.

        Their Gramian is H, so single-vector Lanczos on ``hvp`` bidiagonalises
        the row matrix without forming it."""
        return self.krylov(k, block=1, max_passes=4 * k + 40)[0].tolist()

    def trace_hutchinson(self, probes: int = 100, seed: int = 0,
                         distribution: str = "gaussian") -> float:
        """LND-5: mean over probes z of z^T H z, all probes in ONE pass."""
        rng = np.random.default_rng(seed)
        if distribution == "rademacher":
            Z = rng.choice([-1.0, 1.0], size=(probes, self.dim))
        else:
            Z = rng.standard_normal((probes, self.dim))
        w = self.w

        def fn(X, _):
            p = sigmoid_np(X @ w)
            s = p * (1.0 - p)
            return (s[:, None] * (X @ Z.T) ** 2).sum(axis=0)
        self.passes += 1
        per_probe = partial_sums(self.df, "d", (probes,), fn) / max(self.n, 1)
        return float(per_probe.mean())


class ManyCurvature:
    """Curvature of the Bradley-Terry loss at many weight vectors (M x d).

    A pass over the pairs serves all models: their Gramians, or their products with
    one block of vectors each.  A pass whose sums would not fit the driver's bound is
    split by models, so any number of models is served.  Pairs are cached as in
    ``Curvature``."""

    def __init__(self, pairs: DataFrame, weights, diff_col: str = "d"):
        self.weights = np.atleast_2d(np.asarray(weights, dtype=np.float64))
        self.df = pairs.select(F.col(diff_col).alias("d")).persist(StorageLevel.MEMORY_AND_DISK)
        self.n = self.df.count()
        self.passes = 0

    def unpersist(self):
        self.df.unpersist()

    def _sums(self, which: np.ndarray, shape: tuple[int, ...], per_model) -> np.ndarray:
        """Means over the pairs of ``per_model(X, s, model)`` for the listed models."""
        step = max(1, MAX_RESULT_ENTRIES // max(1, math.prod(shape)))
        parts = [np.empty((0, *shape))]
        for first in range(0, len(which), step):
            models = which[first:first + step]
            W = self.weights[models]

            def fn(X, _, models=models, W=W):
                p = sigmoid_np(X @ W.T)
                s = p * (1.0 - p)
                return np.stack([per_model(X, s[:, i], m) for i, m in enumerate(models)])
            self.passes += 1
            parts.append(partial_sums(self.df, "d", (len(models), *shape), fn) / max(self.n, 1))
        return np.concatenate(parts)

    def gramians(self) -> np.ndarray:
        """The Hessians of all models (M x d x d)."""
        dim = self.weights.shape[1]
        return self._sums(np.arange(len(self.weights)), (dim, dim), lambda X, s, _: X.T @ (s[:, None] * X))

    def spectra(self) -> np.ndarray:
        """All eigenvalues of every model's Hessian, descending (M x d)."""
        return np.linalg.eigvalsh(self.gramians())[:, ::-1]

    def hvp(self, V: np.ndarray, which: np.ndarray) -> np.ndarray:
        """H_m @ V[i] for the listed models and their blocks (len(which) x d x b)."""
        place = {int(m): i for i, m in enumerate(which)}
        return self._sums(which, V.shape[1:], lambda X, s, m: X.T @ (s[:, None] * (X @ V[place[int(m)]])))

    def top_eigenvalues(self, k: int, max_passes: int = 60, tol: float = 1e-10, seed: int = 0) -> np.ndarray:
        """Top-k eigenvalues of every model (M x k), block Lanczos runs in step.

        Each pass multiplies the blocks of all models that have not settled."""
        runs = [_Lanczos(self.weights.shape[1], k, None, tol, seed) for _ in self.weights]
        for _ in range(max_passes):
            which = np.array([m for m, r in enumerate(runs) if not r.done], dtype=np.int64)
            if not len(which):
                break
            width = max(runs[m].fresh.shape[1] for m in which)
            V = np.zeros((len(which), self.weights.shape[1], width))
            for i, m in enumerate(which):
                V[i, :, :runs[m].fresh.shape[1]] = runs[m].fresh
            for m, image in zip(which, self.hvp(V, which)):
                runs[m].take(image[:, :runs[m].fresh.shape[1]])
        return np.array([r.values for r in runs])


def trace_exact(pairs: DataFrame, w, diff_col: str = "d") -> DataFrame:
    """Exact trace mean[p(1-p) |d|^2] as one aggregate (oracle-checkable)."""
    m = dot(lit_vector(w), diff_col)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-m))
    sq = F.aggregate(F.col(diff_col), F.lit(0.0), lambda acc, x: acc + x * x)
    return pairs.agg(F.avg(p * (1 - p) * sq).alias("trace"), F.count(F.lit(1)).alias("n"))


def gram_entries(pairs: DataFrame, w, dim: int, diff_col: str = "d") -> DataFrame:
    """H_ij (i <= j) as a long table, computed in one distributed pass."""
    cur = Curvature(pairs, w, diff_col)
    try:
        H = cur.gramian()
    finally:
        cur.unpersist()
    spark = pairs.sparkSession
    iu = np.triu_indices(dim)
    rows = [(int(i), int(j), float(H[i, j])) for i, j in zip(*iu)]
    return spark.createDataFrame(rows, "i int, j int, value double")


def spectrum_frame(spark, eigenvalues, run_id="run") -> DataFrame:
    vals = sorted((float(x) for x in eigenvalues), reverse=True)
    return spark.createDataFrame([(run_id, i, v) for i, v in enumerate(vals)],
                                 "run_id string, idx int, eigenvalue double")


def spectrum_summary(spectrum: DataFrame, run_cols=("run_id",), value_col="eigenvalue",
                     trace: DataFrame | None = None, sigma2: float = 0.01,
                     n_train: int = 100_000, dim: int | None = None) -> DataFrame:
    """LND-6: condition number, effective rank, sharpness and flatness per run.

    condition = lambda_0 / |lambda_last| (the last of the k COMPUTED values,
    1e-10 when it is 0); effective rank = (sum)^2 / sum of squares (1.0 when
    that is 0); sharpness = lambda_0 / trace (0 when trace <= 0); flatness =
    1 / lambda_0 (inf when lambda_0 <= 0).  trace defaults to the sum of the
    listed eigenvalues.  Two doc quantities are added: the expected loss rise
    under weight noise (sigma^2 / 2) tr(H) and the PAC-Bayes term
    sqrt(tr(H) / n).  ``is_full`` says whether all ``dim`` eigenvalues were
    computed, i.e. whether the condition number uses the true lambda_min
    (NULL when the dimension is not given)."""
    run_cols = list(run_cols)
    v = F.col(value_col)
    agg = spectrum.groupBy(*run_cols).agg(
        F.count(F.lit(1)).alias("n_eigenvalues"), F.max(v).alias("top_eigenvalue"),
        F.min(v).alias("_last"), F.sum(v).alias("_sum"), F.sum(v * v).alias("_sq"))
    if trace is not None:
        agg = agg.join(trace, run_cols)
    else:
        agg = agg.withColumn("trace", F.col("_sum"))
    lam0, last, tr = F.col("top_eigenvalue"), F.col("_last"), F.col("trace")
    denom = F.abs(F.when(last == 0, F.lit(1e-10)).otherwise(last))
    return agg.select(
        *run_cols, "n_eigenvalues", "top_eigenvalue", "trace",
        (lam0 / denom).alias("condition_number"),
        F.when(F.col("_sq") > 0, F.col("_sum") * F.col("_sum") / F.col("_sq"))
        .otherwise(F.lit(1.0)).alias("effective_rank"),
        F.when(tr > 0, lam0 / tr).otherwise(F.lit(0.0)).alias("sharpness_score"),
        F.when(lam0 > 0, F.lit(1.0) / lam0).otherwise(F.lit(float("inf"))).alias("flatness_index"),
        (F.lit(sigma2 / 2.0) * tr).alias("noise_sensitivity"),
        F.sqrt(F.greatest(tr, F.lit(0.0)) / F.lit(float(n_train))).alias("pac_bayes_term"),
        ((F.col("n_eigenvalues") >= F.lit(dim)) if dim is not None
         else F.lit(None).cast("boolean")).alias("is_full"))


def explained_variance(spectrum: DataFrame, run_col="run_id", idx_col="idx",
                       value_col="eigenvalue", level: float = 0.9) -> DataFrame:
    """LND-7: cumulative share of the eigenvalue sum per run (descending
    order) and the count needed to reach ``level``.  The window spans one
    run's spectrum (k values), not the data."""
    w = Window.partitionBy(run_col).orderBy(idx_col).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(run_col)
    cum = spectrum.select(run_col, idx_col, value_col,
                          (F.sum(value_col).over(w) / F.sum(value_col).over(tot)).alias("cumulative"))
    need = cum.groupBy(run_col).agg(
        F.min(F.when(F.col("cumulative") >= level, F.col(idx_col) + 1)).alias("n_for_level"))
    return cum.join(need, run_col)


def spectrum_history(values: DataFrame, run_col="run_id", epoch_col="epoch",
                     value_col="value", top: int = 10, every_n_epochs: int = 1) -> DataFrame:
    """LND-9: per (run, epoch) spectrum summary of the top-``top`` values,
    every N epochs ((epoch + 1) % N == 0).  WindowGroupLimit keeps <= top rows
    per group in each partition before the shuffle."""
    w = Window.partitionBy(run_col, epoch_col).orderBy(F.col(value_col).desc())
    top_vals = (values.filter(((F.col(epoch_col) + 1) % every_n_epochs) == 0)
                .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
                .select(run_col, epoch_col, F.col(value_col).alias("eigenvalue")))
    return spectrum_summary(top_vals, [run_col, epoch_col])


def surface_grid(span: float = 1.0, points: int = 21):
    return [float(x) for x in np.linspace(-span, span, points)]


def loss_surface(pairs: DataFrame, w, u1, u2, diff_col: str = "d", span: float = 1.0,
                 points: int = 21) -> DataFrame:
    """LND-8: mean loss at w + alpha u1 + beta u2 over a points x points grid.

    One distributed pass: every Arrow batch computes (m0, a, b) = (w.d, u1.d,
    u2.d) and the whole batch x grid loss matrix with numpy, keeping one
    running sum per grid point; partitions are added by ``partial_sums``.
    Only points^2 sums leave the tasks."""
    from prefsight.operators.linalg import softplus_neg_np

    g = np.asarray(surface_grid(span, points))
    alpha = np.repeat(g, points)
    beta = np.tile(g, points)
    w, u1, u2 = (np.asarray(v, dtype=np.float64) for v in (w, u1, u2))

    def fn(X, _):
        m0, a, b = X @ w, X @ u1, X @ u2
        M = m0[:, None] + alpha[None, :] * a[:, None] + beta[None, :] * b[:, None]
        out = np.empty(alpha.size + 1)
        out[:-1] = softplus_neg_np(M).sum(axis=0)
        out[-1] = X.shape[0]
        return out
    sums = partial_sums(pairs.select(diff_col), diff_col, (alpha.size + 1,), fn)
    n = max(sums[-1], 1.0)
    rows = [(float(x), float(y), float(v / n)) for x, y, v in zip(alpha, beta, sums[:-1])]
    return pairs.sparkSession.createDataFrame(rows, "alpha double, beta double, loss double")


def surface_directions(w, seed_vector=None):
    """u1 = w / |w|; u2 = Gram-Schmidt of ``seed_vector`` (default e_0) against
    u1, then unit length."""
    w = np.asarray(w, dtype=np.float64)
    u1 = w / max(np.linalg.norm(w), 1e-10)
    e = np.zeros_like(w)
    e[0] = 1.0
    s = np.asarray(seed_vector, dtype=np.float64) if seed_vector is not None else e
    u2 = s - (s @ u1) * u1
    u2 = u2 / max(np.linalg.norm(u2), 1e-10)
    return u1, u2
