"""Active learning: acquisition scores, selection, labelling, rounds (ACT-*).

Acquisition functions are DataFrame -> DataFrame(key, score); selection is an
``orderBy(desc score, key).limit(k)`` that Spark plans as TakeOrderedAndProject
(each task keeps its k best, the driver merges k rows per task).
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefsight.functions import dot, sigmoid, sq_norm

DEFAULT_BATCH = 100


def uncertainty_scores(margins: DataFrame, key_cols, margin_col="margin") -> DataFrame:
    """ACT-1: variance (ddof 0) of the pair's margin across ensemble models."""
    return margins.groupBy(*key_cols).agg(F.var_pop(margin_col).alias("score"))


def committee_scores(margins: DataFrame, key_cols, margin_col="margin") -> DataFrame:
    """ACT-2: vote entropy in bits; a zero margin votes for B; p in {0,1} -> 0."""
    votes = margins.groupBy(*key_cols).agg(
        F.avg(F.when(F.col(margin_col) > 0, 1.0).otherwise(0.0)).alias("p_a"))
    p = F.col("p_a")
    q = F.lit(1.0) - p
    h = F.when((p == 0) | (q == 0), F.lit(0.0)).otherwise(-(p * F.log2(p) + q * F.log2(q)))
    return votes.select(*key_cols, "p_a", h.alias("score"))


def model_change_scores(pairs: DataFrame, w, key_cols=("pair_id",), diff_col="d") -> DataFrame:
    """ACT-3: expected squared gradient norm over the two labels for a linear
    Bradley-Terry model: p(1-p)^2|d|^2 + (1-p)p^2|d|^2 = p(1-p)|d|^2."""
    from prefsight.functions import lit_vector
    m = dot(lit_vector(w), diff_col)
    p = sigmoid(m)
    return pairs.select(*key_cols, (p * (1 - p) * sq_norm(diff_col)).alias("score"))


def entropy_scores(df: DataFrame, key_cols, margin_col="margin", base: float = math.e):
    """ACT-4: prediction entropy -(p ln p + (1-p) ln(1-p)), in the given base."""
    p = sigmoid(F.col(margin_col))
    q = F.lit(1.0) - p
    nats = F.when((p <= 0) | (q <= 0), F.lit(0.0)).otherwise(-(p * F.log(p) + q * F.log(q)))
    return df.select(*key_cols, (nats / F.lit(math.log(base))).alias("score"))


def select_top_k(pool: DataFrame, scores: DataFrame, key_col="pair_id", k: int | None = None):
    """ACT-7: k highest-scoring pool rows, earlier key wins ties; k None/0 -> 100.

    The k best keys of the pool are found on slim rows (key, score), then the k
    rows are fetched; the score is written on them as ``acquisition_score``."""
    k = k or DEFAULT_BATCH
    best = (scores.select(key_col, F.col("score").alias("acquisition_score"))
            .join(pool.select(key_col), key_col, "left_semi")
            .orderBy(F.col("acquisition_score").desc(), F.col(key_col).asc()).limit(k))
    return (pool.join(F.broadcast(best), key_col)  # k rows
            .orderBy(F.col("acquisition_score").desc(), F.col(key_col).asc()))


def apply_labels(selected: DataFrame, labels: DataFrame, key_col="pair_id") -> DataFrame:
    """ACT-8: labelled pairs -> preference pairs; only label 1 means A preferred."""
    j = selected.join(labels, key_col)
    a_wins = F.col("label") == 1
    return j.select(key_col, "prompt",
                    F.when(a_wins, F.col("response_a")).otherwise(F.col("response_b")).alias("chosen"),
                    F.when(a_wins, F.col("response_b")).otherwise(F.col("response_a")).alias("rejected"))


def active_loop(pool: DataFrame, score_fn: Callable[[DataFrame], DataFrame],
                labels: DataFrame, rounds: int, k: int = DEFAULT_BATCH, key_col="pair_id",
                retrain_fn: Callable[[DataFrame], Callable[[DataFrame], DataFrame] | None] | None = None):
    """ACT-9: rounds of score -> top-k -> label -> remove from pool (left anti).

    Only pairs that get a label leave the pool; a selected pair without one stays
    and may be selected again.  ``retrain_fn`` gets all labelled pairs so far and
    may return the score function of the next rounds.  Each round's selection and
    new labels are checkpointed once and the remaining pool is reduced by them.
    Returns (labelled pairs, history of per-round sizes, selections (round, key))."""
    from functools import reduce

    from prefsight.session import ensure_checkpoint_dir
    spark = pool.sparkSession
    ensure_checkpoint_dir(spark)
    remaining, new, chosen, history, n_lab = pool, [], [], [], 0
    n_rem = pool.count()
    for r in range(rounds):
        sel = select_top_k(remaining, score_fn(remaining), key_col, k).checkpoint(eager=True)
        chosen.append(sel.select(F.lit(r).alias("round"), key_col, "acquisition_score"))
        got = apply_labels(sel.drop("acquisition_score"), labels, key_col).checkpoint(eager=True)
        new.append(got)
        done = got.select(key_col).distinct()
        remaining = remaining.join(F.broadcast(done), key_col, "left_anti").checkpoint(eager=True)  # at most k keys
        n_lab, n_rem = n_lab + got.count(), remaining.count()
        history.append((r, sel.count(), n_lab, n_rem))
        if retrain_fn is not None:
            score_fn = retrain_fn(reduce(DataFrame.unionByName, new)) or score_fn
    hist = spark.createDataFrame(history, "round int, selected long, labelled long, pool_remaining long")
    return reduce(DataFrame.unionByName, new), hist, reduce(DataFrame.unionByName, chosen)


class LinearLearner:
    """ACT-9: a linear reward model that learns from what a loop has labelled.

    ``scores`` is the score function of a round: expected model change (ACT-3) under the
    current weights, rounded so that float noise cannot reorder ties.  ``retrain`` refits
    on all labelled pairs, starting from the current weights, and the next round is
    scored by the result.  ``features`` has (key, d); a pair labelled 1 counts as d, any
    other label as -d (B preferred).  ``history`` has the weights after each round."""

    def __init__(self, features: DataFrame, labels: DataFrame, weights, key_col: str = "pair_id",
                 diff_col: str = "d", optimizer: str = "adamw", steps: int = 10, lr: float = 0.1, digits: int = 9):
        self.features = features.select(key_col, F.col(diff_col).alias("d"))
        self.labels, self.key_col = labels.select(key_col, "label"), key_col
        self.optimizer, self.steps, self.lr, self.digits = optimizer, steps, lr, digits
        self.weights = [float(x) for x in weights]
        self.history = [self.weights]

    def scores(self, pool: DataFrame) -> DataFrame:
        """(key, score) of the pairs of the pool."""
        rows = self.features.join(pool.select(self.key_col), self.key_col, "left_semi")
        found = model_change_scores(rows, self.weights, [self.key_col])
        return found.withColumn("score", F.round("score", self.digits))

    def retrain(self, labelled: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """Refit on the labelled pairs from the current weights."""
        from prefsight.operators.train import fit_many
        signed = (self.features.join(labelled.select(self.key_col), self.key_col).join(self.labels, self.key_col)
                  .select(F.when(F.col("label") == 1, F.col("d")).otherwise(F.transform("d", lambda x: -x)).alias("d")))
        state = fit_many(signed, [(self.optimizer, 0)], len(self.weights), steps=self.steps, lr=self.lr, warmup=0,
                         start=[self.weights])[0]
        if not state.failed:
            self.weights = [float(x) for x in state.w]
        self.history.append(self.weights)
        return self.scores


def nearest_distance(items: DataFrame, key_col: str, vec_col: str,
                     block_size: int = 2048) -> DataFrame:
    """ACT-5: exact Euclidean distance from every item to its nearest other item.

    The work is quadratic: for large sets use ``neighbours.nearest_distance_exact`` (pivot
    partitions) or ``nearest_distance_lsh``.  Items are
    hashed into B blocks of about ``block_size``; every block
    pair (a <= b) is one ``applyInPandas`` group holding at most two blocks,
    which computes its distance block with numpy and emits only per-item
    minima; a final partial-aggregated ``min`` per item combines the block
    pairs.  No pair rows are emitted and no group grows with the data."""
    import numpy as np
    import pandas as pd

    from prefsight.functions import hash_key

    n = items.count()
    B = max(1, math.ceil(n / block_size))
    blocked = items.select(F.col(key_col).alias("key"), F.col(vec_col).alias("vec"),
                           F.pmod(hash_key(7, key_col), F.lit(B)).cast("int").alias("blk"))
    rep = blocked.select("key", "vec", "blk", F.explode(F.sequence(F.lit(0), F.lit(B - 1))).alias("o"))
    rep = rep.select("key", "vec", "blk", F.least("blk", "o").alias("ga"), F.greatest("blk", "o").alias("gb"))

    def block_min(pdf: pd.DataFrame) -> pd.DataFrame:
        ga = int(pdf["ga"].iloc[0])
        gb = int(pdf["gb"].iloc[0])
        A = pdf[pdf["blk"] == ga]
        Bp = pdf[pdf["blk"] == gb] if gb != ga else A
        if len(A) == 0 or len(Bp) == 0:  # an empty block has no pairs
            return pd.DataFrame({"key": pd.Series([], dtype="int64"), "d2": pd.Series([], dtype="float64")})
        XA = np.stack([np.asarray(v, dtype=np.float64) for v in A["vec"].to_numpy()])
        XB = np.stack([np.asarray(v, dtype=np.float64) for v in Bp["vec"].to_numpy()])
        d2 = ((XA * XA).sum(1)[:, None] + (XB * XB).sum(1)[None, :] - 2.0 * XA @ XB.T)
        d2 = np.maximum(d2, 0.0)  # the expansion can dip below 0 by rounding
        ka, kb = A["key"].to_numpy(), Bp["key"].to_numpy()
        d2[ka[:, None] == kb[None, :]] = np.inf
        out = [pd.DataFrame({"key": ka, "d2": d2.min(axis=1)})]
        if gb != ga:
            out.append(pd.DataFrame({"key": kb, "d2": d2.min(axis=0)}))
        return pd.concat(out)

    mins = rep.groupBy("ga", "gb").applyInPandas(block_min, "key long, d2 double")
    best = mins.groupBy("key").agg(F.min("d2").alias("d2"))
    return best.select(F.col("key").alias(key_col),
                       F.when(F.col("d2") == float("inf"), F.lit(None))
                       .otherwise(F.sqrt("d2")).alias("nn_distance"))


def nearest_distance_lsh(items: DataFrame, key_col: str, vec_col: str, tables: int = 16,
                         bucket: int = 64, block_size: int = 2048, seed: int = 0) -> DataFrame:
    """ACT-5 for large sets: Euclidean distance to the nearest item found by hashing.

    Centred vectors get ``log2(n / bucket)`` signs of random projections in each of
    ``tables`` tables; items are compared within a bucket only, so the work grows
    with n * tables * bucket instead of n squared.  The distance is never below the
    exact one and equals it for items whose neighbour shares a bucket (recall
    0.9 or more on clustered data, see the tests; more tables raise it).  A bucket of
    over ``block_size`` items is dealt into blocks by the hash of the key and every
    pair of its blocks is compared, so the work in one dense bucket grows with the
    square of its items; an item alone in all its buckets has a null distance.  ``nearest_distance`` is exact."""
    import numpy as np
    import pandas as pd

    from prefsight.functions import hash_key

    n = items.count()
    bits = max(1, math.ceil(math.log2(max(2, n) / bucket))) if n > bucket else 0
    src = items.select(F.col(key_col).cast("long").alias("key"), F.col(vec_col).alias("vec"))
    first = src.first()
    dim = len(first["vec"]) if first else 0
    centre = np.array(src.agg(*[F.avg(F.col("vec")[i]) for i in range(dim)]).first()) if dim else np.zeros(0)
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))

    def hashed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"].to_numpy()]) - centre
            side = (x @ planes > 0).reshape(len(pdf), tables, bits)
            code = side @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(pdf), tables), np.int64)
            yield pdf.assign(codes=list(code))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        a = pdf[pdf["blk"] == lo]
        b = pdf[pdf["blk"] == hi] if hi != lo else a
        if not len(a) or not len(b):  # an empty block has no pairs
            return pd.DataFrame({"key": pd.Series([], dtype="int64"), "d2": pd.Series([], dtype="float64")})
        xa, xb = (np.stack([np.asarray(v, dtype=np.float64) for v in p["vec"].to_numpy()]) for p in (a, b))
        ka, kb = a["key"].to_numpy(), b["key"].to_numpy()
        d2 = np.maximum((xa * xa).sum(axis=1)[:, None] + (xb * xb).sum(axis=1)[None, :] - 2 * xa @ xb.T, 0.0)
        d2[ka[:, None] == kb[None, :]] = np.inf

        def least(keys, d2, x, y):
            at = d2.argmin(axis=1)
            exact = ((x - y[at]) ** 2).sum(axis=1)
            return pd.DataFrame({"key": keys, "d2": np.where(np.isinf(d2.min(axis=1)), np.inf, exact)})
        out = [least(ka, d2, xa, xb)]
        if hi != lo:
            out.append(least(kb, d2.T, xb, xa))
        return pd.concat(out)

    coded = src.mapInPandas(hashed, "key long, vec array<double>, codes array<long>")
    rows = coded.select("key", "vec", F.posexplode("codes").alias("tab", "code"))
    blocks = rows.groupBy("tab", "code").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("long").alias("nb"))
    dealt = (rows.join(blocks, ["tab", "code"]).withColumn("blk", F.pmod(hash_key(seed, "key"), F.col("nb")))
             .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))))
    pairs = dealt.select("tab", "code", "key", "vec", "blk", F.least("blk", "o").alias("lo"),
                         F.greatest("blk", "o").alias("hi"))
    best = (pairs.groupBy("tab", "code", "lo", "hi").applyInPandas(nearest, "key long, d2 double")
            .groupBy("key").agg(F.min("d2").alias("d2")))
    return best.select(F.col("key").alias(key_col),
                       F.when(F.col("d2") == float("inf"), F.lit(None)).otherwise(F.sqrt("d2")).alias("nn_distance"))


def greedy_diverse(items: DataFrame, key_col: str, vec_col: str, score_col: str, k: int):
    """ACT-6: greedy k-centre selection on score x distance-to-selected.

    Round 0 takes the highest score; every later round takes the item that
    maximises score * min distance to the selected set; equal products (such as
    0, when only repeats of chosen vectors are left) go by score, then key, so k
    items are returned if there are k.  Each round is one pass
    updating a ``min_dist`` column with the new centre (a literal vector);
    the table is checkpointed every 5 rounds.  Only the chosen row reaches the
    driver each round."""
    from prefsight.functions import lit_vector
    from prefsight.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(items.sparkSession)
    cur = items.select(F.col(key_col).alias("key"), F.col(vec_col).alias("vec"),
                       F.col(score_col).cast("double").alias("score"),
                       F.lit(float("inf")).alias("min_dist"))
    chosen = []
    for r in range(k):
        if r == 0:
            crit = F.col("score")
        else:
            crit = F.col("score") * F.col("min_dist")
        taken = [key for _, key, _, _ in chosen]
        pick = cur.filter(~F.col("key").isin(taken)).orderBy(crit.desc(), F.col("score").desc(), F.col("key")).select(
            "key", "vec", "score", "min_dist").first()
        if pick is None:
            break
        chosen.append((r, pick["key"], float(pick["score"]),
                       None if math.isinf(pick["min_dist"]) else float(pick["min_dist"])))
        c = lit_vector(pick["vec"])
        dist = F.sqrt(F.aggregate(F.zip_with(F.col("vec"), c, lambda a, b: (a - b) * (a - b)),
                                  F.lit(0.0), lambda acc, x: acc + x))
        cur = cur.withColumn("min_dist", F.least(F.col("min_dist"), dist))
        if (r + 1) % 5 == 0:
            cur = cur.checkpoint(eager=True)
    spark = items.sparkSession
    return spark.createDataFrame(chosen, f"round int, {key_col} long, score double, min_dist double")
