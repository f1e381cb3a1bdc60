"""Fitting linear Bradley-Terry reward models (TRN-1..3, CMP-1/2).

Gradient fitting keeps the pairs cached and runs one distributed pass per
step; the pass computes the gradients of EVERY run being trained (optimizer x
seed grid) at once, so a comparison of M runs costs the same number of scans
as one run.  Updates are tiny numpy operations on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefsight.operators.linalg import partial_sums, sigmoid_np, softplus_neg_np

# Optimizer defaults of the reference's configuration files.
OPTIMIZER_DEFAULTS = {
    "adam": {"betas": (0.9, 0.999), "eps": 1e-8, "weight_decay": 0.0},
    "adamw": {"betas": (0.9, 0.999), "eps": 1e-8, "weight_decay": 0.01},
    "sgd": {"momentum": 0.9, "weight_decay": 0.01, "nesterov": True},
    "muon": {"momentum": 0.95, "nesterov": True},
    "lion": {"betas": (0.9, 0.99), "weight_decay": 0.1, "lr_scale": 0.1},
}
GRAD_CLIP = 1.0


def lr_at(step: int, lr: float, warmup: int, max_steps: int) -> float:
    """Linear warm-up from 0.01 lr to lr, then cosine decay to 0.1 lr over
    max(1, max_steps - warmup) steps (eta_min is 0.1 of the module's lr)."""
    if warmup > 0 and step < warmup:
        return lr * (0.01 + 0.99 * step / warmup)
    t = step - warmup
    T = max(1, max_steps - warmup)
    eta_min = 0.1 * lr
    return eta_min + (lr - eta_min) * (1 + math.cos(math.pi * min(t, T) / T)) / 2


@dataclass
class RunState:
    optimizer: str
    seed: int
    w: np.ndarray
    t: int = 0
    m: np.ndarray | None = None
    v: np.ndarray | None = None
    log: list = field(default_factory=list)
    failed: bool = False
    final_loss: float | None = None
    final_accuracy: float | None = None


def update(st: RunState, g: np.ndarray, lr: float) -> None:
    """One step of the named built-in update rule (in place)."""
    name = st.optimizer
    cfg = OPTIMIZER_DEFAULTS[name]
    st.t += 1
    if st.m is None:
        st.m = np.zeros_like(st.w)
        st.v = np.zeros_like(st.w)
    if name in ("adam", "adamw"):
        b1, b2 = cfg["betas"]
        if name == "adamw":
            st.w = st.w - lr * cfg["weight_decay"] * st.w
        st.m = b1 * st.m + (1 - b1) * g
        st.v = b2 * st.v + (1 - b2) * g * g
        mh = st.m / (1 - b1 ** st.t)
        vh = st.v / (1 - b2 ** st.t)
        st.w = st.w - lr * mh / (np.sqrt(vh) + cfg["eps"])
    elif name == "sgd":
        g = g + cfg["weight_decay"] * st.w
        st.m = cfg["momentum"] * st.m + g if st.t > 1 else g.copy()
        step = g + cfg["momentum"] * st.m if cfg["nesterov"] else st.m
        st.w = st.w - lr * step
    elif name == "muon":
        # momentum, then the orthogonal polar factor of the 1 x d update,
        # which for a single row is the unit vector
        st.m = cfg["momentum"] * st.m + g
        u = g + cfg["momentum"] * st.m if cfg["nesterov"] else st.m
        st.w = st.w - lr * u / max(np.linalg.norm(u), 1e-12)
    elif name == "lion":
        b1, b2 = cfg["betas"]
        lr_l = lr * cfg["lr_scale"]
        c = b1 * st.m + (1 - b1) * g
        st.w = st.w - lr_l * (np.sign(c) + cfg["weight_decay"] * st.w)
        st.m = b2 * st.m + (1 - b2) * g
    else:
        raise ValueError(f"Unknown optimizer: {name}")


def _clip(g: np.ndarray, max_norm: float = GRAD_CLIP) -> np.ndarray:
    nrm = float(np.linalg.norm(g))
    return g * (max_norm / nrm) if nrm > max_norm else g


def fit_many(pairs: DataFrame, runs, dim: int, diff_col: str = "d", steps: int = 50,
             lr: float = 0.05, warmup: int = 5, batch_fraction: float | None = None,
             init_scale: float = 0.01, rules: dict | None = None, start=None) -> list[RunState]:
    """Train every (optimizer, seed) in ``runs`` with shared passes.

    Each step: weights of all M runs go to the tasks inside the closure (M x d,
    bounded), each batch yields the M loss sums, correct counts and gradients
    -(1 - sigmoid(m)) d, and the partitions are added by ``partial_sums``.

    ``start`` has the weights that each run starts from (a warm start); without it
    they are drawn by the run's seed.

    ``rules`` adds update rules by name: ``rule(state, gradient, rate)`` changes
    ``state.w`` in place (``state.m``, ``state.v`` and ``state.t`` are its memory).
    The log has the loss, accuracy and gradient norm (before clipping) at the
    weights a step starts from; ``final_loss`` and ``final_accuracy`` are those of
    the returned weights, from one more pass."""
    rules = {**dict.fromkeys(OPTIMIZER_DEFAULTS, update), **(rules or {})}
    for opt, _ in runs:
        if opt not in rules:
            raise ValueError(f"Unknown optimizer: {opt}")
    df = pairs.select(F.col(diff_col).alias("d")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        states = []
        for i, (opt, seed) in enumerate(runs):
            drawn = np.random.default_rng(seed).standard_normal(dim) * init_scale
            states.append(RunState(opt, seed, drawn if start is None else np.array(start[i], dtype=np.float64)))
        M = len(states)
        for step in range(steps + 1):
            W = np.stack([s.w for s in states])
            batch = df.sample(fraction=batch_fraction, seed=step) if batch_fraction and step < steps else df

            def fn(X, _pdf, W=W):
                m = X @ W.T                                  # n x M
                coef = -(1.0 - sigmoid_np(m))                # dLoss/dm
                out = np.zeros((M, dim + 3))
                out[:, :dim] = coef.T @ X
                out[:, dim] = softplus_neg_np(m).sum(axis=0)
                out[:, dim + 1] = (m > 0).sum(axis=0)
                out[:, dim + 2] = X.shape[0]
                return out
            sums = partial_sums(batch, "d", (M, dim + 3), fn)
            for i, st in enumerate(states):
                if st.failed:
                    continue
                n = max(sums[i, dim + 2], 1.0)
                loss, accuracy = float(sums[i, dim] / n), float(sums[i, dim + 1] / n)
                if step == steps:
                    st.final_loss, st.final_accuracy = loss, accuracy
                    continue
                g = sums[i, :dim] / n
                rate = lr_at(step, lr, warmup, steps)
                st.log.append((step, loss, accuracy, rate, float(np.linalg.norm(g))))
                rules[st.optimizer](st, _clip(g), rate)
                if not np.all(np.isfinite(st.w)):
                    st.failed = True  # a diverged run is skipped, the others go on
        return states
    finally:
        df.unpersist()


def fit_bradley_terry(pairs: DataFrame, dim: int, optimizer: str = "adamw", seed: int = 42,
                      **kw) -> RunState:
    """TRN-1: fit one linear reward model with the named update rule."""
    return fit_many(pairs, [(optimizer, seed)], dim, **kw)[0]


def step_log_frame(spark: SparkSession, states) -> DataFrame:
    rows = [(s.optimizer, s.seed, *rec) for s in states for rec in s.log]
    return spark.createDataFrame(rows, "optimizer string, seed int, step int, loss double, "
                                       "accuracy double, lr double, grad_norm double")


def fit_exact(pairs: DataFrame, diff_col: str = "d", reg: float = 1e-4, max_iter: int = 100):
    """TRN-2: the optimum of the Bradley-Terry loss as a logistic regression
    without intercept on mirrored rows (+d, 1) and (-d, 0); a single class
    would be degenerate.  Returns (weights, model)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    pos = pairs.select(array_to_vector(F.col(diff_col)).alias("features"), F.lit(1.0).alias("label"))
    neg = pairs.select(array_to_vector(F.transform(F.col(diff_col), lambda x: -x)).alias("features"),
                       F.lit(0.0).alias("label"))
    lr = LogisticRegression(fitIntercept=False, standardization=False, regParam=reg,
                            elasticNetParam=0.0, maxIter=max_iter, tol=1e-9)
    model = lr.fit(pos.unionByName(neg))
    return np.asarray(model.coefficients.toArray()), model


def item_strengths(comparisons: DataFrame, winner_col="winner", loser_col="loser",
                   iterations: int = 30, tol: float = 1e-8, prior_wins: float = 1e-3):
    """TRN-3: Bradley-Terry item strengths by the MM iteration
    theta_i <- W_i / sum_j n_ij / (theta_i + theta_j), normalised so that the
    mean log strength is 0 (P(i beats j) = sigmoid(log theta_i - log theta_j)).

    Strengths stay a DataFrame joined to the pair counts every round (no
    collect of the item table).  Each round reads the strengths twice, so the
    (one row per item) strengths table is checkpointed every round: the plan
    stays constant in size and a lost executor recomputes one round only.
    Returns (strengths DataFrame(item, strength, log_strength, wins, games),
    rounds run).  ``prior_wins`` is the least number of wins an item counts with,
    so that an item that never wins has a finite strength."""
    from prefsight.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(comparisons.sparkSession)
    c = comparisons.select(F.col(winner_col).alias("wi"), F.col(loser_col).alias("lo"))
    # unordered pair counts n_ij (i < j) -- one row per compared pair of items
    pairs = (c.select(F.least("wi", "lo").alias("i"), F.greatest("wi", "lo").alias("j"))
             .groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))).checkpoint(eager=True)
    wins = c.groupBy(F.col("wi").alias("item")).agg(F.count(F.lit(1)).alias("wins"))
    items = (pairs.select(F.col("i").alias("item")).union(pairs.select(F.col("j").alias("item")))
             .distinct().join(wins, "item", "left")
             .select("item", F.coalesce("wins", F.lit(0)).alias("wins")))
    games = (pairs.select(F.col("i").alias("item"), "n").unionByName(pairs.select(F.col("j").alias("item"), "n"))
             .groupBy("item").agg(F.sum("n").alias("games")))
    items = items.join(games, "item").checkpoint(eager=True)
    theta = items.select("item", F.lit(1.0).alias("theta"))
    rounds = 0
    for r in range(iterations):
        ti = theta.select(F.col("item").alias("i"), F.col("theta").alias("ti"))
        tj = theta.select(F.col("item").alias("j"), F.col("theta").alias("tj"))
        jp = pairs.join(ti, "i").join(tj, "j").withColumn("q", F.col("n") / (F.col("ti") + F.col("tj")))
        den = (jp.select(F.col("i").alias("item"), "q").unionByName(jp.select(F.col("j").alias("item"), "q"))
               .groupBy("item").agg(F.sum("q").alias("den")))
        raw = items.join(den, "item").select(
            "item", (F.greatest(F.col("wins").cast("double"), F.lit(float(prior_wins))) / F.col("den")).alias("t"))
        mean_log = raw.agg(F.avg(F.log("t")).alias("ml")).withColumn("_k", F.lit(0))
        new = (raw.withColumn("_k", F.lit(0)).join(F.broadcast(mean_log), "_k")
               .select("item", F.exp(F.log("t") - F.col("ml")).alias("theta")))
        new = new.checkpoint(eager=True)
        old, theta, rounds = theta, new, r + 1
        if tol > 0:  # without a tolerance no round can stop the loop
            delta = (new.join(old.withColumnRenamed("theta", "old"), "item")
                     .agg(F.max(F.abs(F.log("theta") - F.log("old"))).alias("d")).first()["d"])
            if delta is not None and delta < tol:
                break
    out = theta.join(items, "item").select("item", F.col("theta").alias("strength"),
                                           F.log("theta").alias("log_strength"), "wins", "games")
    return out, rounds
