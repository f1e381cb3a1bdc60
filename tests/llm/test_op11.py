import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from prefsight.llm import op11_period_runs as R
from prefsight.llm import queries as Q


def words_of(t):
    return (t or "").encode().split()


def tailed(key, t):
    w = words_of(t)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_runs(w, min_words=24, min_repeats=3):
    n, out = len(w), []
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_words, min_repeats * q):
                part = w[i:i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(key, t):
    w = tailed(key, t)
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    start, length, period = best or (None,) * 3
    return (key, len(runs), start, length, period, best and 1000 * length // period,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        w = []
        while len(w) < rng.choice([0, 5, 24, 150, 400]):
            block = [rng.choice("abc" if seed % 2 else "abcdefghij").encode() for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 30]))]
            w += (block * rng.choice([1, 1, 2, 3, 4, 9]))[:rng.randrange(1, 200)]
        texts.append(w)
    for low in (24, 6):
        got = R._chunk_runs(texts, low, 3)
        assert [list(map(tuple, g.tolist())) for g in got] == [brute_runs(w, low) for w in texts]


def test_nested_runs_and_bounds():
    w = [b"x"] * 30
    assert brute_runs(w) == [(0, 30, 1)] == [tuple(r) for r in R._chunk_runs([w], 24, 3)[0].tolist()]
    inner = ([b"a"] * 24 + [b"b"]) * 3
    assert R._chunk_runs([inner], 24, 3)[0].tolist() == [list(r) for r in brute_runs(inner)]
    short = [b"p", b"q"] * 11 + [b"p"]
    assert not len(R._chunk_runs([short], 24, 3)[0]) and len(R._chunk_runs([short + [b"q"]], 24, 3)[0]) == 1


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in Q.table(spark, sf, "documents").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in Q.op11_period_runs(spark, sf).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted((brute(*r) for r in rows), key=lambda r: r[0])
    assert sum(r[1] for r in got) > 0


def test_edge_cases(spark, docs, texts, empty):
    rewritten = R.repeat_tails(docs)
    small = {(r["doc_id"], r["text"]) for r in docs.collect() if len(words_of(r["text"])) < 3000}
    keys = {k for k, _ in small}
    got = {tuple(r[c] for c in COLUMNS) for r in R.period_runs(rewritten, keep=["doc_id"]).collect() if r["doc_id"] in keys}
    assert got == {brute(*r) for r in small}
    assert R.period_runs(empty).count() == 0 == R.repeat_tails(empty).count()
    long = spark.createDataFrame([("a b c " * 50_000, 7, "k"), (None, 8, None), ("", 9, "z")],
                                 "text string, n_runs int, other string")
    a, b, c = sorted(R.period_runs(long, with_text=True).collect(), key=lambda r: r["n_runs_input"])
    assert (a["n_runs"], a["start"], a["length"], a["period"], a["collapsed"]) == (1, 0, 150_000, 3, "a b c")
    for r in (b, c):
        assert r["n_runs"] == 0 and r["start"] is None and r["exponent_milli"] is None and r["collapsed"] == ""
        assert r["runs_sha256"] == r["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert R.period_runs(docs).count() == docs.count()
