import random
import re
from collections import Counter

import numpy as np
import pytest

from prefsight.llm import op13_collocations as C


def brute(rows, min_count, longest=5, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", raw):
            w = re.findall(rb"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    inside = {}
    for (lang, w), a in cands.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = lang, w[i:i + m]
                inside[key] = max(inside.get(key, 0), a)
    out = {}
    for (lang, w), a in cands.items():
        if inside.get((lang, w), 0) >= a:
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, b" ".join(w), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
                  for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["É", "a-b", "😀", "x" * 300]
    rows = [(None, "en"), ("", None), (" \t\n ", "de"), ("one", "xx"), ("Same Words same words, same words", "en")]
    for i in range(150):
        w = [rng.choice(vocab) if rng.random() < 0.6 else "New York\tCity  hall" for _ in range(rng.choice([0, 3, 40]))]
        rows.append(("".join(x + rng.choice([" ", " ", "\t", ". ", ",", "\n", "\x0b", "  "]) for x in w), rng.choice(["en", "en", "de", None, "und"])))
    return rows + rows[-20:]


@pytest.mark.parametrize("min_count,top,longest", [(3, 2000, 5), (6, 7, 5), (4, 50, 3), (10**6, 5, 5)])
def test_brute_force(spark, rows, min_count, top, longest):
    docs = spark.createDataFrame([(t, x, 1.0, "p") for t, x in rows], "text string, lang string, score double, phrase string")
    assert got(C.collocations(docs, min_count=min_count, top=top, longest=longest)) == brute(rows, min_count, longest, top)


def test_fingerprints_that_collide(spark, rows, monkeypatch):
    texts, langs = [(t or "").encode() for t, _ in rows], [x or "und" for _, x in rows]
    everything = {k: np.full(16, 2**64 - 1, np.uint64) for k in (1, 2, 3)}

    def counts():
        out = Counter()
        chunk = C.Chunk(texts, langs)
        for n, at, first, c, _, stray in C._occurrences(chunk, everything, 5):
            for places, k in ((first, c), (stray, np.ones(len(stray), int))):
                for p, x in zip(places.tolist(), k.tolist()):
                    out[chunk.langs[chunk.row[p]], n, C._phrase(chunk, p, n)] += x
        return out
    plain = counts()
    monkeypatch.setattr(C.Chunk, "fingerprints", lambda self, n: np.zeros(max(0, len(self) - n + 1), np.uint64))
    assert counts() == plain and len(plain) > 1000
    for lang, _, p, a, *_ in brute(rows, 4):
        assert plain[lang, len(p.split(" ")), p.encode()] == a


def test_recount_by_text(spark, rows, monkeypatch):
    """Fingerprints of eight bits: nearly all collide, the counts stay exact."""
    real = C.K.keyed
    monkeypatch.setattr(C.K, "keyed", lambda x, n: real(real(x, n) & np.uint64(255), n))
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)  # one chunk sees every collision

    def crowded(f):
        def run(it, *args):
            C.K.keyed = lambda x, n: real(real(x, n) & np.uint64(255), n)
            try:
                yield from f(it, *args)
            finally:
                C.K.keyed = real
        return run
    monkeypatch.setattr(C, "_count_rows", crowded(C._count_rows))
    monkeypatch.setattr(C, "_phrase_rows", crowded(C._phrase_rows))
    assert got(C.collocations(docs, min_count=5)) == brute(rows, 5)


def test_filters_drop_nothing(spark):
    keys = [(i * 0x9E3779B97F4A7C15 + 77) % 2**64 - 2**63 for i in range(3000)]
    bloom = C.bloom_filter(spark.createDataFrame([(k,) for k in keys], "fp long"))
    assert C.may_hold(bloom, np.array(keys, np.int64).view(np.uint64)).all()
    other = np.random.default_rng(1).integers(0, 2**63, 20_000, np.int64).view(np.uint64)
    assert C.may_hold(bloom, other).mean() < 0.05


def test_no_rows(spark, docs):
    none = spark.createDataFrame([], "text string, lang string")
    assert got(C.collocations(none)) == []
    odd = docs.selectExpr("text", "component_id as lang", "n_words as n")
    assert got(C.collocations(odd, min_count=50)) == brute([(r["text"], r["lang"]) for r in odd.collect()], 50)
