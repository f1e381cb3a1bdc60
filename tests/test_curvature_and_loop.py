"""Many-model curvature and the loop that retrains."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from prefsight.operators import active as ac
from prefsight.operators import landscape as ls


def pairs_frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "pair_id long, d array<double>")


@pytest.mark.parametrize("bound", [2048 * 2048, 100])
def test_many_models_equal_one_by_one(spark, monkeypatch, bound):
    rng = np.random.default_rng(0)
    x, W = rng.normal(size=(200, 7)), rng.normal(size=(5, 7))
    monkeypatch.setattr(ls, "MAX_RESULT_ENTRIES", bound)
    many = ls.ManyCurvature(pairs_frame(spark, x), W)
    p = 1 / (1 + np.exp(-x @ W.T))
    want = np.stack([(x * (p[:, m] * (1 - p[:, m]))[:, None]).T @ x / len(x) for m in range(5)])
    np.testing.assert_allclose(many.gramians(), want, rtol=1e-10, atol=1e-14)
    assert many.passes == (1 if bound > 1000 else 3)
    np.testing.assert_allclose(many.spectra(), np.linalg.eigvalsh(want)[:, ::-1], rtol=1e-9)
    np.testing.assert_allclose(many.top_eigenvalues(3), np.linalg.eigvalsh(want)[:, ::-1][:, :3], rtol=1e-9)
    one = ls.Curvature(pairs_frame(spark, x), W[2])
    np.testing.assert_allclose(one.top_eigenvalues(3), many.top_eigenvalues(3)[2], rtol=1e-9)
    values, vectors = one.krylov(2)
    np.testing.assert_allclose(want[2] @ vectors, vectors * values, atol=1e-6)
    many.unpersist()
    one.unpersist()


def test_retrained_loop_follows_its_model(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    truth, start = np.array([1.0, -2, 0.5, 0, 3]), np.array([-1.0, 1, 1, 1, -1])
    feats = pairs_frame(spark, x)
    labels = spark.createDataFrame([(i, int(row @ truth > 0)) for i, row in enumerate(x) if i % 11], "pair_id long, label int")
    pool = feats.select("pair_id", F.lit("p").alias("prompt"), F.lit("a").alias("response_a"), F.lit("b").alias("response_b"))
    learner = ac.LinearLearner(feats, labels, start, steps=20, lr=0.3)
    labelled, sizes, chosen = ac.active_loop(pool, learner.scores, labels, rounds=3, k=30, retrain_fn=learner.retrain)
    assert len(learner.history) == 4
    got = {}
    for r in chosen.collect():
        got.setdefault(r["round"], set()).add(r["pair_id"])
    left, taken = set(range(300)), set()
    for r in range(3):
        w = np.array(learner.history[r])
        p = 1 / (1 + np.exp(-x @ w))
        score = np.round(p * (1 - p) * (x * x).sum(axis=1), 9)
        best = set(sorted(left, key=lambda i: (-score[i], i))[:30])
        assert got[r] == best
        taken |= {i for i in best if i % 11}
        left -= taken
    assert {r["pair_id"] for r in labelled.collect()} == taken
    p = 1 / (1 + np.exp(-x @ start))
    static = np.round(p * (1 - p) * (x * x).sum(axis=1), 9)
    assert got[1] != set(sorted(set(range(300)) - {i for i in got[0] if i % 11}, key=lambda i: (-static[i], i))[:30])
    right = [np.mean((x @ np.array(w) > 0) == (x @ truth > 0)) for w in learner.history]
    assert right[-1] > 0.9 > right[0]
