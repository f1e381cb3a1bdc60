import hashlib
import random

import pytest

from prefsight.llm import op12_repeated_spans as S


def brute(rows, size):
    texts = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in texts:
        for i in range(len(w) - size + 1):
            if k is not None:
                win = tuple(w[i:i + size])
                first[win] = min(first.get(win, k), k)
    out = []
    for k, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if k is not None and first[tuple(w[i:i + size])] < k:
                gone |= set(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def rows_with_repeats(seed, n=120, size=12):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([size - 1, size, size + 1, 3 * size, 90]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(40))]
            if rng.random() < 0.3 and w:
                w[rng.randrange(len(w))] = "CHANGED"
        if i % 5 == 0:
            w = passages[0] + w  # a hot passage with other surroundings each time
        rows.append((rng.randrange(1000) if i % 17 else i, rng.choice([" ", "  ", "\n\t"]).join(w)))
    return rows + [rows[3], (5000, rows[7][1]), (5001, rows[7][1]), (None, rows[7][1]), (None, None), (5002, None), (5003, ""),
                   (5004, " \t "), (5005, "é 😀 " * 40), (5006, "É 😀 " * 40), (5007, "é 😀 " * 30)]


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,gram,shard,stream", [(1, 5, 60_000, 400_000), (2, 12, 40, 100), (3, 3, 200, 50)])
def test_brute_force(spark, seed, gram, shard, stream):
    rows = rows_with_repeats(seed)
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_words int, mark string")
    out = S.repeated_spans(docs, min_words=12, gram=gram, shard_words=shard, stream_words=stream, with_text=True)
    want = brute(rows, 12)
    assert got(out) == want and 20 < sum(r[2] > 0 for r in want) < len(want) - 20
    for r in out.collect():
        assert r["n_removed"] == sum(s["last"] - s["first"] for s in r["spans"])


def test_pieces_of_long_documents(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(2000)}" for _ in range(40_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[100:39_000])), (3, "head " + " ".join(base) + " tail"),
            (4, " ".join(base[20_000:20_049])), (5, " ".join(base[20_000:20_050])), (0, " ".join(base[16_370:16_430]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.repeated_spans(docs, with_text=True, shard_words=9000)) == brute(rows, 50)


@pytest.mark.parametrize("seed", range(8))
def test_automaton(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(12)]
    order = list(range(12))
    rng.shuffle(order)
    made = S.SuffixAutomaton()
    for k in order[:8]:
        made.add(texts[k], k)
    made.finish()
    for size in (1, 3, 6):
        for k, w in enumerate(texts):
            cover = set()
            for i in range(len(w) - size + 1):
                win = w[i:i + size]
                if any(texts[o][j:j + size] == win for o in order[:8] if o < k for j in range(len(texts[o]) - size + 1)):
                    cover |= set(range(i, i + size))
            spans = made.repeats(w, size, k)
            assert {i for a, b in spans for i in range(a, b)} == cover and spans == S.merged(spans)


def test_columns_and_no_rows(spark, docs, empty, texts):
    out = S.repeated_spans(docs)
    assert out.count() == docs.count()
    known = {r["doc_id"]: r for r in out.where("doc_id is not null").collect()}
    base = 10**6 + 6
    assert known[base]["n_removed"] == 0 and known[base + 1]["n_removed"] == known[base + 1]["n_words"] == 60
    assert known[base + 2]["n_removed"] == 0  # upper case is another text
    assert known[base + 5]["n_removed"] == 30_000 == known[base + 5]["n_words"] - 1
    assert S.repeated_spans(empty).count() == 0
    with pytest.raises(ValueError):
        S.repeated_spans(docs, min_words=5)
