import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefsight.llm import op2_lm_score as L
from prefsight.llm import op5_toxicity as T
from prefsight.llm import queries as Q


def tokens(t):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", raw) + [b"\n"]


@pytest.fixture(scope="module")
def scored(docs):
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    rows = L.lm_scores(docs.withColumn("held_out", ~train), train, keep=["doc_id", "held_out", "text"]).collect()
    return rows


def test_base_score_and_counts_are_exact(docs, scored):
    all_rows = docs.select("doc_id", "text").collect()
    assert len(scored) == len(all_rows)
    c = Counter()
    for r in all_rows:
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            c.update(tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    for r in scored:
        ts = tokens(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(t in c for t in ts), n)
        want = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
        assert -20 * len(ts) < r["score"] < 0


def test_model_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_filter_holds_quantised_counts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    counts = rng.zipf(1.5, 4000).clip(1, 10**6)
    size, raw = L.segment(keys, counts, 1, 12)
    lm = L.LogFrequencyFilter([(1, 0, size, raw)], 1, {1: 1}, {}, 10, 10)
    assert len(lm) == len(raw) + 8
    got = lm.levels([], keys)
    want = L.level_of(counts)
    assert (got >= want).all() and (got == want).mean() > 0.98  # only false hits, upwards
    assert (lm.levels([], rng.integers(0, 2**63, 4000, dtype=np.uint64)) > 0).mean() < 0.02
    assert L.level_of(np.array([1, 2, 3, 4, 5, 6])).tolist() == [1, 2, 3, 4, 4, 5]


def test_probabilities_sum_to_about_one():
    """Over the vocabulary and one unknown word, after any history."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.4, 30).clip(1, 50)).encode() for _ in range(200)]
    sums = {}
    for t in texts:
        toks, bounds = L.tokens_of([t])
        for w in toks:
            sums[int(w)] = sums.get(int(w), 0) + 1
    keys, counts = np.array(list(sums), np.uint64), np.array(list(sums.values()))
    size, raw = L.segment(keys, counts, 1, 24)
    lm = L.LogFrequencyFilter([(1, 0, size, raw)], 1, {1: 1}, {}, int(counts.sum()), len(counts))
    p = 10 ** lm.log10_probability(keys, np.array([0, len(keys)]))
    assert p.sum() == pytest.approx(1, abs=0.05)


def test_probabilities_after_a_history_sum_to_about_one(spark):
    """Orders two and three: no mass is lost by n-grams seen once."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.4, 30).clip(1, 400)) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    vocabulary = sorted({w for t in texts for w in t.split()})
    for order in (2, L.MAX_ORDER):
        lm = L.Counts(frame, order, 24).filter
        sums = []
        for t in texts[:60]:
            history = " ".join(t.split()[:order - 1])
            toks, bounds = L.tokens_of([f"{history} {w}".encode() for w in vocabulary] + [history.encode()])
            p = 10 ** lm.log10_probability(toks, bounds)
            last = np.append(bounds[1:-1] - 2, bounds[-1] - 1)  # the word after the history, or the end
            sums.append(p[last].sum())
        assert np.mean(sums) == pytest.approx(1, abs=0.05)
        assert 0.75 < min(sums) and max(sums) < 1.25


def test_scores_brute_force(spark, docs):
    """The discounted model from exact counts, rounded to levels; a filter of few false hits."""
    assert L.MAX_ORDER == 3
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    learnt = [tokens(t) for i, t in rows if i is not None and i % 3 != 0]
    counts, types, left = Counter(), Counter(), Counter()

    def ngrams(ts, n):
        padded = [None] * (n - 1) + ts
        return [tuple(padded[i:i + n]) for i in range(len(ts))]
    for ts in learnt:
        for n in (1, 2, 3):
            counts.update(ngrams(ts, n))
    for g, c in counts.items():
        if len(g) > 1:
            types[g[:-1]] += 1
            left[g[:-1]] += c - 1
    total, words = sum(map(len, learnt)), sum(len(g) == 1 for g in counts)

    def estimate(c):
        return L.ESTIMATE[L.level_of(np.array([c]))[0]]
    share = {}
    for n in (2, 3):
        seen, all_of = Counter(), Counter()
        for h, t in types.items():
            if len(h) == n - 1:
                level = int(L.level_of(np.array([left[h]]))[0])
                seen[level] += left[h]
                all_of[level] += left[h] + t
        share[n] = {level: min(0.99, seen[level] / all_of[level]) for level in all_of}

    def score(ts):
        out = 0.0
        grams = {n: ngrams(ts, n) for n in (1, 2, 3)}
        for i in range(len(ts)):
            p = (estimate(counts[grams[1][i]]) + 1) / (total + words + 1)
            for n in (2, 3):
                g = grams[n][i]
                d = left[g[:-1]]
                a = share[n][int(L.level_of(np.array([d]))[0])] if d else 0.0
                p = a * min(1.0, estimate(max(0, counts[g] - 1)) / max(estimate(d), 1.0)) + (1 - a) * p
            out += math.log10(p)
        return out
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    got = L.lm_scores(docs, train, keep=["doc_id", "text"], bits_per_event=48).collect()
    assert len(got) == len(rows)
    for r in got[:150]:
        assert r["score"] == pytest.approx(score(tokens(r["text"])), rel=2e-3, abs=1e-3)


def test_joined_filter_gives_the_scores_of_a_broadcast_one(docs):
    """A filter over the bound loses nothing: it is looked up by shard."""
    def scores(bound):
        rows = L.lm_scores(docs, F.col("doc_id") % 5 != 0, keep=["doc_id"], max_order=3, max_filter_bytes=bound).collect()
        return sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows)
    whole, joined = scores(1 << 40), scores(0)
    assert len(whole) == len(joined) == docs.count()
    for a, b in zip(whole, joined, strict=True):
        assert a == pytest.approx(b, rel=1e-9)


def test_shuffles_of_finished_steps_are_removed(spark, docs):
    """op2 stopped on disk: the shuffles of the counts and of all n-grams asked for stayed to the end."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def shuffled():
        files = env.blockManager().diskBlockManager().getAllFiles()
        names = {files.apply(i).getName() for i in range(files.size())}
        return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}
    before = shuffled()
    scores = L.lm_scores(docs, F.col("doc_id") % 5 != 0, keep=["doc_id"], max_filter_bytes=0)
    for _ in range(50):  # files go in the background
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before  # the plan that is left has yet to run
    assert scores.count() == docs.count()


def test_what_many_chunks_ask_for_is_probed_once(monkeypatch):
    joint = np.sort(np.random.default_rng(3).integers(0, 1 << L.CODE_BITS, 500, dtype=np.uint64))
    size, bits = L.segment(joint[:250], np.arange(1, 251), 1, 12)  # raw keys: only what is asked counts here
    asked, levels_of = [], L.LogFrequencyFilter.levels_of

    def seen(self, order, joint):
        asked.append(len(joint))
        return levels_of(self, order, joint)
    monkeypatch.setattr(L.LogFrequencyFilter, "levels_of", seen)
    lm = L.LogFrequencyFilter([], 1, {1: 1}, {}, 10, 10)
    rows = [(0, -1, 1, 0, size, bits)] + [(0, c, 1, None, 500, L._packed_gaps(joint, 0)) for c in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)],
                                       names=["shard", "chunk", "order", "bucket", "size", "data"])
    out = pa.Table.from_batches(list(L._answer_rows([batch], lm))).to_pylist()
    assert asked == [500]
    assert [r["chunk"] for r in out] == list(range(20)) and len({r["data"] for r in out}) == 1
    part = L.LogFrequencyFilter([(1, 0, size, bits)], 1, {1: 1}, {}, 10, 10)
    want = levels_of(part, 1, joint).astype(np.uint8).tobytes()
    assert pa.decompress(out[0]["data"], decompressed_size=500, codec="zstd", asbytes=True) == want


def test_lm_empty_and_untrained(empty, docs):
    assert L.lm_scores(empty, F.lit(True), keep=["doc_id"]).count() == 0
    rows = L.lm_scores(docs.limit(3), F.lit(False), keep=["doc_id"]).collect()
    assert len(rows) == 3 and all(r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in rows)


def make_texts(n, seed):
    rng = np.random.default_rng(seed)
    common = [f"word{i}" for i in range(200)]
    out = []
    for i in range(n):
        s = [" ".join(rng.choice(common, 8)) for _ in range(rng.integers(2, 12))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.integers(len(s))
            s[at] += f" vile{rng.choice(['ness', 'r', 'ly'])}"
        out.append((i, ". ".join(s) + ".", int(toxic)))
    return out


def test_toxicity_learns_words_and_finds_the_sentence(spark):
    rows = make_texts(600, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model = T.train_toxicity(docs, labels, F.col("doc_id") < 400)
    got = {r["doc_id"]: r for r in T.score_toxicity(docs, model, keep=["doc_id"]).collect()}
    held = [(i, y) for i, _, y in rows if i >= 400]
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.98 * len(held)
    for i, y in held:
        if y and got[i]["predicted"]:
            assert any("vile" in s for s in got[i]["offending"])


def test_noisy_or():
    s = np.array([0.5, 0.5, 0.2])
    assert T.noisy_or(s, np.array([0, 0, 2]), 3).tolist() == pytest.approx([0.75, 0.0, 0.2])


def test_toxicity_edge_cases(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train_toxicity(docs, none, F.lit(True))
    rows = T.score_toxicity(docs, model, keep=["doc_id", "score", "component_id"]).collect()
    assert len(rows) == docs.count() and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)
    assert T.score_toxicity(empty, model, keep=["doc_id"]).count() == 0
    model = T.Model(np.array([1], np.uint64), np.array([1.0]), -5.0)
    by = {r["doc_id"]: r["score"] for r in T.score_toxicity(docs, model, keep=["doc_id"]).collect()}
    assert by[10**6] == by[10**6 + 1] == 0.0 and 0 < by[10**6 + 10] <= 1


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in Q.run("op5_toxicity", spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    clean = [r for r in rows if not labels[r["doc_id"]]]
    toxic = [r for r in rows if labels[r["doc_id"]]]
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
