"""Unit tests on tiny frames with hand-computed values (FIXTURES.md part 2)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefsight.functions import BIN_EDGES, calibration_bin, py_strip
from prefsight.operators import active as ac
from prefsight.operators import convert as cv
from prefsight.operators import evaluate as ev
from prefsight.operators import indexing as ix
from prefsight.operators import landscape as ls
from prefsight.operators import margins as mg
from prefsight.operators import readiness as rd
from prefsight.operators import train as tr
from prefsight.operators.indexing import global_index, index_within_group
from prefsight.sources import io

SAMPLE_MARGINS = [0.1 * i for i in range(1, 11)]
SAMPLE_EIGS = [float(k * k) for k in range(12, 0, -1)]  # the squares of 1 to 12


def margins_df(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "pair_id long, margin double")


def test_margin_statistics_sample(spark):
    r = mg.margin_statistics(margins_df(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])).first()
    assert r["mean"] == pytest.approx(0.55)
    assert r["std"] == pytest.approx(0.2872281323)
    assert (r["p25"], r["p50"], r["p75"]) == pytest.approx((0.325, 0.55, 0.775))
    assert r["easy_fraction"] == pytest.approx(0.3)
    assert r["medium_fraction"] == pytest.approx(0.6)
    assert r["hard_fraction"] == pytest.approx(0.1)


def test_margin_statistics_inline(spark):
    r = mg.margin_statistics(margins_df(spark, [0.1, 0.3, 0.5, 0.7, 0.9])).first()
    assert r["mean"] == pytest.approx(0.5) and r["min"] == pytest.approx(0.1) and r["max"] == pytest.approx(0.9)
    assert r["std"] == pytest.approx(0.2828427125)
    assert (r["p25"], r["p50"], r["p75"]) == pytest.approx((0.3, 0.5, 0.7))
    # 0.7 is medium: 1 easy, 3 medium, 1 hard
    assert (r["easy_fraction"], r["medium_fraction"], r["hard_fraction"]) == pytest.approx((0.2, 0.6, 0.2))


def test_difficulty_nan_in_no_bucket(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 0.7), (2, 0.2)], "pair_id long, margin double")
    got = {r["pair_id"]: r["difficulty"] for r in mg.with_difficulty(df).collect()}
    assert got == {0: None, 1: "medium", 2: "medium"}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=257)
    df = spark.createDataFrame([(i, float(v), i % 3) for i, v in enumerate(vals)], "pair_id long, margin double, g int")
    q = {r["g"]: r for r in mg.exact_quantiles(df, ["g"], "margin", "pair_id").collect()}
    for g in range(3):
        sub = vals[np.arange(len(vals)) % 3 == g]
        assert q[g]["p25"] == pytest.approx(np.percentile(sub, 25))
        assert q[g]["p75"] == pytest.approx(np.percentile(sub, 75))


@pytest.mark.parametrize("args,expected,verdict", [
    ((0.92, 0.03, 0.5, 30.0), 0.9411666667, rd.VERDICT_READY),
    ((0.55, 0.25, 3.0, 500.0), 0.1925, rd.VERDICT_NOT),
    ((0.87, 0.05, 1.2, 150.0), 0.7886666667, rd.VERDICT_ACCEPTABLE),
    ((0.85, 0.08, 1.2, 150.0), 0.7441666667, rd.VERDICT_ACCEPTABLE),
])
def test_readiness(spark, args, expected, verdict):
    df = spark.createDataFrame([args], "a double, e double, v double, l double")
    r = rd.readiness(df, "a", "e", "v", "l").first()
    assert r["overall_score"] == pytest.approx(expected)
    assert r["recommendations"][0] == verdict
    assert r["verdict"] == verdict


def test_readiness_weights_normalised():
    w = rd.normalised_weights({"accuracy": 1, "calibration": 1, "stability": 1, "landscape": 1})
    assert sum(w.values()) == pytest.approx(1.0)


def test_vote_entropy_three_of_five(spark):
    rows = [(0, m, 1.0 if m < 3 else -1.0) for m in range(5)]
    df = spark.createDataFrame(rows, "pair_id long, model_id int, margin double")
    assert ac.committee_scores(df, ["pair_id"]).first()["score"] == pytest.approx(0.9709505945)


def test_curriculum_sample_sizes(spark):
    df = margins_df(spark, [0.1, 0.3, 0.5, 0.8, 0.9])
    got = mg.curriculum_sample(df, 10).groupBy("bucket").count().collect()
    assert {r["bucket"]: r["count"] for r in got} == {"easy": 2, "medium": 6, "hard": 2}
    assert mg.curriculum_sample(df, 7).count() == 6  # truncation 1 + 4 + 1
    valid = {r["pair_id"] for r in df.collect()}
    assert {r["pair_id"] for r in mg.curriculum_sample(df, 10).collect()} <= valid


def test_transcript_split(spark):
    text = "\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant:  d\n "
    df = spark.createDataFrame([(text, "no separator ")], "chosen string, rejected string")
    r = cv.split_transcripts(df).first()
    assert r["prompt"] == "a\n\nAssistant: b c"
    assert r["chosen"] == "d"
    assert r["rejected"] == "no separator "


def test_py_strip_unicode(spark):
    df = spark.createDataFrame([("\x1c\x85 x 　",)], "s string")
    assert df.select(py_strip(F.col("s")).alias("s")).first()["s"] == "\x1c\x85 x 　".strip()


def test_best_worst_ties(spark):
    comps = [{"response": r, "overall_score": float(s)} for r, s in zip("xyzw", [3, 3, 1, 1])]
    df = spark.createDataFrame([("p", comps)],
                               "prompt string, completions array<struct<response:string,overall_score:double>>")
    r = cv.best_worst_array(df).first()
    assert (r["chosen"], r["rejected"]) == ("x", "w")
    long = spark.createDataFrame([(0, "p", i, c["response"], float(c["overall_score"])) for i, c in enumerate(comps)],
                                 "prompt_id long, prompt string, completion_idx long, response string, overall_score double")
    r2 = cv.best_worst_long(long, ["prompt_id"]).first()
    assert (r2["chosen"], r2["rejected"]) == ("x", "w")


def test_ab_label_null_takes_b(spark):
    df = spark.createDataFrame([("h", "A", "B", 1), ("h", "A", "B", 0), ("h", "A", "B", None)],
                               "history string, human_ref_A string, human_ref_B string, labels int")
    got = [r["chosen"] for r in cv.ab_label(df).collect()]
    assert sorted(got) == ["A", "B", "B"]


def test_consecutive_pairs(spark):
    df = spark.createDataFrame([(0, "p0", "r0", 1), (1, "p1", "r1", 1), (2, "p2", "r2", 5), (3, "p3", "r3", 2),
                                (4, "p4", "r4", 9)], "ord long, prompt string, response string, helpfulness int")
    got = sorted((r["pair_idx"], r["prompt"], r["chosen"], r["rejected"])
                 for r in cv.consecutive_pairs(df, ["ord"]).collect())
    assert got == [(0, "p0", "r1", "r0"), (1, "p2", "r2", "r3")]


def test_convert_unknown_kind(spark):
    with pytest.raises(ValueError):
        cv.convert("nope", spark.range(1))


def test_bin_of_point_three(spark):
    df = spark.createDataFrame([(0.3,)], "p double")
    assert df.select(calibration_bin(F.col("p")).alias("b")).first()["b"] == 2
    assert BIN_EDGES[3] == 0.30000000000000004


def test_probability_one_counts_but_in_no_bin(spark):
    df = spark.createDataFrame([(0, 40.0), (1, 0.0)], "pair_id long, margin double")
    r = ev.calibration_report(df).first()
    # p(40) == 1.0 sits in no bin; |0.5 - 1| / 2 from the other row
    assert r["ece"] == pytest.approx(0.25)


def test_close_top_bins_probability_one(spark):
    df = spark.createDataFrame([(0, 40.0), (1, 0.0)], "pair_id long, margin double")
    assert ev.calibration_report(df, close_top=True).first()["ece"] == pytest.approx(0.25)
    rel = ev.reliability_table(df).collect()
    assert sum(r["n"] for r in rel) == 1  # p == 1.0 dropped from the table by default


def test_spectrum_is_full(spark):
    spec = ls.spectrum_frame(spark, [3.0, 2.0, 1.0], "r")
    assert ls.spectrum_summary(spec, dim=3).first()["is_full"] is True
    assert ls.spectrum_summary(spec, dim=10).first()["is_full"] is False
    assert ls.spectrum_summary(spec).first()["is_full"] is None


def test_one_pass_ece_equals_table_form(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(0, 2, 500)
    df = margins_df(spark, m)
    got = ev.calibration_report(df, label_mode="sign").first()["ece"]
    p = 1 / (1 + np.exp(-m))
    y = (m > 0).astype(float)
    ece = 0.0
    for i in range(10):
        sel = (p >= BIN_EDGES[i]) & (p < BIN_EDGES[i + 1])
        if sel.sum():
            ece += abs(p[sel].mean() - y[sel].mean()) * sel.sum()
    assert got == pytest.approx(ece / len(p))


def test_spectrum_summary_sample(spark):
    spec = ls.spectrum_frame(spark, SAMPLE_EIGS, "r")
    r = ls.spectrum_summary(spec).first()
    assert r["trace"] == pytest.approx(650)  # n(n+1)(2n+1)/6
    assert r["condition_number"] == pytest.approx(144)
    assert r["effective_rank"] == pytest.approx(650 ** 2 / 60_710)  # the sum of fourth powers
    assert r["flatness_index"] == pytest.approx(1 / 144)
    assert r["sharpness_score"] == pytest.approx(144 / 650)
    n90 = ls.explained_variance(spec).first()["n_for_level"]
    assert n90 == 7  # 559 of 650 after six, 595 after seven


def test_spectrum_edge_cases(spark):
    spec = spark.createDataFrame([("r", 0, 100.0), ("r", 1, 0.0)], "run_id string, idx int, eigenvalue double")
    r = ls.spectrum_summary(spec).first()
    assert r["condition_number"] == pytest.approx(100.0 / 1e-10)
    spec0 = spark.createDataFrame([("r", 0, 0.0)], "run_id string, idx int, eigenvalue double")
    r0 = ls.spectrum_summary(spec0).first()
    assert math.isinf(r0["flatness_index"]) and r0["effective_rank"] == 1.0 and r0["sharpness_score"] == 0.0


def test_global_index_matches_sort(spark):
    rng = np.random.default_rng(5)
    vals = rng.integers(0, 50, 2000)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(vals)], "k long, v long")
    got = {r["k"]: r["idx"] for r in global_index(df, ["v", "k"], "idx").collect()}
    order = sorted(range(len(vals)), key=lambda i: (vals[i], i))
    assert all(got[k] == pos for pos, k in enumerate(order))


def test_index_within_group_skewed(spark):
    # one hot group holding most rows is still numbered 0..n-1
    rows = [(i, 0 if i % 10 else 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g int")
    out = index_within_group(df, ["g"], ["k"], "pos").groupBy("g").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).collect()
    for r in out:
        assert r["lo"] == 0 and r["hi"] == r["n"] - 1


def test_repartition_invariance(spark):
    df = margins_df(spark, np.linspace(-2, 3, 101))
    a = ev.calibration_report(df.repartition(1)).first()
    b = ev.calibration_report(df.repartition(8)).first()
    assert a["ece"] == pytest.approx(b["ece"]) and a["brier"] == pytest.approx(b["brier"])


def test_validation_quarantine(spark):
    df = spark.createDataFrame([(0, "p", "c", "r", "0.5"), (1, "", "c", "r", None), (2, "  ", "c", "r", None),
                                (3, "p", None, "r", None), (4, "p", "c", "r", "abc")],
                               "pair_id long, prompt string, chosen string, rejected string, margin string")
    valid, bad = io.validate_pairs(df)
    assert sorted(r["pair_id"] for r in valid.collect()) == [0, 2]
    reasons = {r["pair_id"]: r["error"] for r in bad.collect()}
    assert reasons[1].startswith("prompt") and reasons[3].startswith("chosen") and "numeric" in reasons[4]


def test_required_columns_lists_all():
    class Fake:
        columns = ["prompt"]
    with pytest.raises(ValueError, match="chosen.*rejected"):
        io.require_columns(Fake(), ["prompt", "chosen", "rejected"])


def test_unsupported_extension(spark):
    with pytest.raises(ValueError, match="Unsupported"):
        io.read_preferences(spark, "/tmp/x.txt")


def test_dataset_filename():
    assert io.dataset_filename("hh", "train", None, "parquet") == "hh_train.parquet"
    assert io.dataset_filename("hh", "train", 5000, "json") == "hh_train_5k.json"
    assert io.dataset_filename("hh", "test", 500, "csv") == "hh_test_0k500.csv"


def test_hutchinson_close_to_exact_and_power_equals_eigh(spark):
    rng = np.random.default_rng(0)
    d = rng.normal(size=(400, 8))
    w = rng.normal(size=8) * 0.3
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(d)], "pair_id long, d array<double>")
    cur = ls.Curvature(df, w)
    H = cur.gramian()
    p = 1 / (1 + np.exp(-(d @ w)))
    assert np.allclose(H, (d * (p * (1 - p))[:, None]).T @ d / len(d))
    exact = float(np.trace(H))
    est = cur.trace_hutchinson(400, seed=1)
    assert est == pytest.approx(exact, rel=0.15)
    ev_ = np.sort(np.linalg.eigvalsh(H))[::-1]
    assert cur.top_eigenvalues(3) == pytest.approx(ev_[:3], rel=1e-8)
    assert cur.top_eigenvalues_svd(2) == pytest.approx(ev_[:2], rel=1e-6)
    v = rng.normal(size=(8, 2))
    assert np.allclose(cur.hvp(v), H @ v) and np.allclose(cur.hvp(v[:, 0]), H @ v[:, 0])
    cur.unpersist()


def test_nearest_distance_brute_force(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(X)], "k long, v array<double>")
    got = {r["k"]: r["nn_distance"] for r in ac.nearest_distance(df, "k", "v", block_size=16).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        assert got[i] == pytest.approx(D[i].min(), rel=1e-9)


def test_active_loop_conserves_rows(spark):
    pool = spark.createDataFrame([(i, "p", "a", "b") for i in range(250)],
                                 "pair_id long, prompt string, response_a string, response_b string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(250)], "pair_id long, label int")
    scores = pool.select("pair_id", (F.col("pair_id") % 17).cast("double").alias("score"))
    lab, hist, chosen = ac.active_loop(pool, lambda p: scores, labels, rounds=3, k=100)
    assert chosen.count() == 250
    h = hist.orderBy("round").collect()
    assert [r["selected"] for r in h] == [100, 100, 50]
    assert h[-1]["pool_remaining"] == 0 and lab.count() == 250


def test_read_preferences_json_document(spark, tmp_path):
    import json
    path = tmp_path / "pairs.json"
    path.write_text(json.dumps([{"question": "q1", "good": "a", "bad": "b", "score": 0.5},
                                {"question": "q2", "good": "c\n\"quoted\"", "bad": "d", "score": 0.25}]))
    df = io.read_preferences(spark, str(path), prompt_col="question", chosen_col="good",
                             rejected_col="bad", margin_col="score", multi_line=True)
    got = sorted((r["prompt"], r["chosen"], r["rejected"], r["margin"]) for r in df.collect())
    assert got == [("q1", "a", "b", 0.5), ("q2", "c\n\"quoted\"", "d", 0.25)]


def test_item_strengths_match_numpy_mm(spark):
    """TRN-3 brute force: five distributed MM rounds equal five numpy MM steps."""
    from prefsight.operators.train import item_strengths
    rng = np.random.default_rng(4)
    true = np.array([0.0, 0.5, 1.0, -0.5, 0.25])
    comps = []
    for _ in range(3000):
        i, j = rng.choice(5, 2, replace=False)
        p = 1 / (1 + np.exp(-(true[i] - true[j])))
        comps.append((int(i), int(j)) if rng.random() < p else (int(j), int(i)))
    df = spark.createDataFrame(comps, "winner long, loser long")
    out, rounds = item_strengths(df, iterations=5, tol=0.0)
    assert rounds == 5
    got = {r["item"]: r["log_strength"] for r in out.collect()}
    W = np.zeros(5)
    N = np.zeros((5, 5))
    for w, l in comps:
        W[w] += 1
        N[w, l] += 1
        N[l, w] += 1
    th = np.ones(5)
    for _ in range(5):
        th = W / (N / (th[:, None] + th[None, :])).sum(axis=1)
        th = th / np.exp(np.log(th).mean())
    for i in range(5):
        assert got[i] == pytest.approx(np.log(th[i]), abs=1e-9)


def test_active_loop_keeps_unlabelled_pairs(spark):
    pool = spark.createDataFrame([(i, "p", "a", "b") for i in range(10)],
                                 "pair_id long, prompt string, response_a string, response_b string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 10, 2)], "pair_id long, label int")
    scores = pool.select("pair_id", F.col("pair_id").cast("double").alias("score"))
    lab, hist, chosen = ac.active_loop(pool, lambda p: scores, labels, rounds=2, k=5)
    assert [tuple(r) for r in hist.orderBy("round").collect()] == [(0, 5, 2, 8), (1, 5, 3, 7)]
    assert {r["pair_id"] for r in lab.collect()} == {8, 6, 4}
    assert {r["pair_id"] for r in chosen.filter("round = 1").collect()} == {9, 7, 5, 4, 3}


def test_active_loop_uses_the_retrained_scores(spark):
    pool = spark.createDataFrame([(i, "p", "a", "b") for i in range(6)],
                                 "pair_id long, prompt string, response_a string, response_b string")
    labels = pool.select("pair_id", F.lit(1).alias("label"))
    up = pool.select("pair_id", F.col("pair_id").cast("double").alias("score"))
    down = pool.select("pair_id", (-F.col("pair_id")).cast("double").alias("score"))
    seen = []

    def retrain(labelled):
        seen.append(labelled.count())
        return lambda p: down
    _, _, chosen = ac.active_loop(pool, lambda p: up, labels, rounds=2, k=2, retrain_fn=retrain)
    assert {(r["round"], r["pair_id"]) for r in chosen.collect()} == {(0, 5), (0, 4), (1, 0), (1, 1)}
    assert seen == [2, 4]


def test_nearest_distance_with_empty_blocks(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "k long, v array<double>")
    got = {r["k"]: r["nn_distance"] for r in ac.nearest_distance(df, "k", "v", block_size=1).collect()}
    assert got == {i: 1.0 for i in range(6)}


def test_greedy_diverse_returns_k_items(spark):
    rows = [(1, [0.0, 0.0], 3.0), (2, [0.0, 0.0], 2.0), (3, [3.0, 4.0], 1.0), (4, [0.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows, "k long, v array<double>, s double")
    got = [tuple(r) for r in ac.greedy_diverse(df, "k", "v", "s", 4).orderBy("round").collect()]
    assert [g[1] for g in got] == [1, 3, 2, 4] and got[1][3] == 5.0 and got[2][3] == 0.0


def test_update_rules_follow_their_formulas():
    g1, g2, w0, lr = np.array([0.3, -0.4]), np.array([-0.1, 0.2]), np.array([1.0, 2.0]), 0.1

    def two(name):
        st = tr.RunState(name, 0, w0.copy())
        tr.update(st, g1, lr)
        tr.update(st, g2, lr)
        return st.w
    for name, decay in (("adam", 0.0), ("adamw", 0.01)):
        w = w0 * (1 - lr * decay) - lr * g1 / (np.abs(g1) + 1e-8)
        m, v = 0.9 * 0.1 * g1 + 0.1 * g2, 0.999 * 0.001 * g1**2 + 0.001 * g2**2
        w = w * (1 - lr * decay) - lr * (m / (1 - 0.9**2)) / (np.sqrt(v / (1 - 0.999**2)) + 1e-8)
        assert np.allclose(two(name), w)
    a = g1 + 0.01 * w0
    w = w0 - lr * 1.9 * a
    b = g2 + 0.01 * w
    assert np.allclose(two("sgd"), w - lr * (b + 0.9 * (0.9 * a + b)))
    u = 1.95 * g1
    w = w0 - lr * u / np.linalg.norm(u)
    u = g2 + 0.95 * (0.95 * g1 + g2)
    assert np.allclose(two("muon"), w - lr * u / np.linalg.norm(u))
    w = w0 - 0.01 * (np.sign(g1) + 0.1 * w0)
    assert np.allclose(two("lion"), w - 0.01 * (np.sign(0.9 * 0.01 * g1 + 0.1 * g2) + 0.1 * w))


def test_learning_rate_schedule():
    assert tr.lr_at(0, 1.0, 4, 12) == pytest.approx(0.01) and tr.lr_at(2, 1.0, 4, 12) == pytest.approx(0.505)
    assert tr.lr_at(4, 1.0, 4, 12) == 1.0 and tr.lr_at(8, 1.0, 4, 12) == pytest.approx(0.55)
    assert tr.lr_at(12, 1.0, 4, 12) == pytest.approx(0.1) == tr.lr_at(50, 1.0, 4, 12)


def bt_loss_and_gradient(d, w):
    m = d @ w
    return np.log1p(np.exp(-m)).mean(), -(d / (1 + np.exp(m))[:, None]).mean(axis=0), (m > 0).mean()


def test_fit_many_equals_numpy_and_takes_rules(spark):
    rng = np.random.default_rng(4)
    d = rng.normal(size=(80, 3)) * 20 + 5
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(d)], "pair_id long, d array<double>")

    def plain(st, g, rate):
        st.w = st.w - rate * g
    runs = [("sgd", 1), ("plain", 2)]
    states = tr.fit_many(df, runs, 3, steps=4, lr=0.05, warmup=1, rules={"plain": plain})
    for (name, seed), st in zip(runs, states, strict=True):
        w = np.random.default_rng(seed).standard_normal(3) * 0.01
        mine = tr.RunState(name, seed, w)
        for step in range(4):
            loss, g, acc = bt_loss_and_gradient(d, mine.w)
            assert st.log[step][1:3] == pytest.approx((loss, acc)) and st.log[step][4] == pytest.approx(np.linalg.norm(g))
            g = g / max(1.0, np.linalg.norm(g))
            rule = plain if name == "plain" else tr.update
            rule(mine, g, tr.lr_at(step, 0.05, 1, 4))
        assert np.allclose(st.w, mine.w)
        loss, _, acc = bt_loss_and_gradient(d, st.w)
        assert (st.final_loss, st.final_accuracy) == pytest.approx((loss, acc))
    assert max(rec[4] for rec in states[0].log) > 1.0  # the norm before clipping
    with pytest.raises(ValueError):
        tr.fit_many(df, [("unknown", 0)], 3, steps=1)


def test_fit_exact_is_the_optimum(spark):
    rng = np.random.default_rng(6)
    d = rng.normal(size=(200, 3)) + np.array([0.5, 0.0, -0.3])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(d)], "pair_id long, d array<double>")
    w, _ = tr.fit_exact(df, reg=1e-3)
    _, g, _ = bt_loss_and_gradient(d, w)
    assert np.linalg.norm(g + 1e-3 * w) < 1e-5


def test_prefix_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(i), int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 9, 500), strict=True))]
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(7)
    got = {(r["g"], r["o"]): r["p"] for r in ix.prefix_sums(df, ["g"], ["o"], "v", "p").collect()}
    for g, o, _ in rows:
        assert got[g, o] == sum(v for a, b, v in rows if a == g and b < o)


def test_checkpoint_folder_has_to_be_shared_off_local():
    from prefsight import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_user_scorers(spark):
    from prefsight.operators import scoring as sc
    df = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(9)], "k long, f array<double>").repartition(3)
    got = {(r["k"], r["model_id"]): r["reward"] for r in sc.score_with(
        df, {1: lambda x: x.sum(axis=1), 2: lambda x: np.tanh(x[:, 0])}, "f", keep=["k"]).collect()}
    assert got == {(i, m): pytest.approx(i + 2.0 if m == 1 else math.tanh(i)) for i in range(9) for m in (1, 2)}


def test_absolute_reward_subtracts_the_empty_response(spark):
    from prefsight.operators import scoring as sc
    scored = spark.createDataFrame([("p", 1, 3.0), ("p", 1, 5.0), ("q", 1, 1.0)], "prompt string, model_id int, reward double")
    empty = spark.createDataFrame([("p", 1, 2.0)], "prompt string, model_id int, reward double")
    got = sorted((r["prompt"], r["absolute_reward"]) for r in sc.absolute_reward(scored, empty, ["prompt"]).collect())
    assert got == [("p", 1.0), ("p", 3.0), ("q", None)]


def test_nearest_distance_lsh_recall(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 16))
    X = np.concatenate([base, base + 0.1 * rng.normal(size=base.shape), base + 0.2 * rng.normal(size=base.shape)])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(X)], "k long, v array<double>")
    got = {r["k"]: r["nn_distance"] for r in ac.nearest_distance_lsh(df, "k", "v", bucket=32).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    exact = D.min(axis=1)
    assert all(got[i] is None or got[i] >= exact[i] - 1e-9 for i in range(len(X)))
    assert np.mean([got[i] is not None and got[i] <= exact[i] + 1e-9 for i in range(len(X))]) >= 0.9
    few = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "k long, v array<double>")
    assert {r["nn_distance"] for r in ac.nearest_distance_lsh(few, "k", "v").collect()} == {3.0}
    assert ac.nearest_distance_lsh(few.limit(0), "k", "v").count() == 0


def test_nearest_distance_lsh_in_a_dense_group(spark):
    """A bucket over block_size: pairs of different blocks are compared too."""
    rng = np.random.default_rng(11)
    X = np.concatenate([rng.normal(size=(300, 16)), 4 + 0.01 * rng.normal(size=(300, 16))])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(X)], "k long, v array<double>")
    got = {r["k"]: r["nn_distance"]
           for r in ac.nearest_distance_lsh(df, "k", "v", tables=8, bucket=64, block_size=64).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    exact = D.min(axis=1)[300:]
    assert len(got) == len(X)
    assert np.mean([got[300 + i] <= exact[i] + 1e-9 for i in range(300)]) >= 0.99


def test_comparison_grid_evaluates_every_run(spark):
    """CMP-1: held-out evaluation and spectrum of all 15 runs; adamw 0 is the run of CMP-2."""
    from prefsight.plans.registry import load_all
    reg = load_all()
    sf = "/root/testdata/sf0.001"
    rows = {(r["optimizer"], r["seed"]): r.asDict() for r in reg["cmp_grid"].run(spark, sf).collect()}
    assert len(rows) == 15
    one = reg["cmp_run"].run(spark, sf).first().asDict()
    for r in rows.values():
        assert r["n_validation"] == one["n_validation"] and r["is_full"]
        assert 0 <= r["final_val_accuracy"] <= 1 and r["top_eigenvalue"] > 0
    assert len({r["final_val_loss"] for r in rows.values()}) == 15
    for name in ("final_train_loss", "final_val_accuracy", "final_val_loss", "calibration_ece", "top_eigenvalue",
                 "trace_estimate", "condition_number", "effective_rank"):
        assert rows["adamw", 0][name] == pytest.approx(one[name], rel=1e-6)
