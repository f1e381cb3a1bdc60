import hashlib
import random
import re

import pytest

from prefsight.llm import op8_decontaminate as D
from prefsight.llm import op10_ngram_join as J
from prefsight.llm import queries as Q
from prefsight.plans.oracle_check import compare, duck_connection


class Spec:
    def __init__(self, name):
        self.name, self.sql = name, Q.SQL[name]

    def run(self, spark, sf):
        return Q.run(self.name, spark, sf)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, sf, name):
    got = compare(spark, Spec(name), sf, duck_connection(sf))
    assert got["status"] == "match" and not got["type_mismatches"], got


def words8(t):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


def brute8(text, items):
    w = words8(text)
    hit, ids = set(), set()
    for i, t in items:
        iw = words8(t)
        n = min(10, len(iw))
        wins = {tuple(iw[s:s + n]) for s in range(len(iw) - n + 1)} if n else set()
        for s in range(len(w) - n + 1 if n else 0):
            if tuple(w[s:s + n]) in wins:
                hit |= set(range(s, s + n))
                if i is not None:
                    ids.add(str(i))
    named = sorted(ids)
    return len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontaminate_brute_force(spark, block):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 30])))) for i in range(25)]
    items += [(None, " ".join(rng.choice(vocab) for _ in range(14))), (99, None), (98, ""), (3, "extra words of item three"),
              (10, items[0][1])]
    docs = []
    for i in range(60):
        t = [rng.choice(vocab) + rng.choice(["", ",", "!", ".\n"]) for _ in range(rng.choice([0, 1, 5, 80]))]
        if i % 3 == 0:
            t.insert(rng.randrange(len(t) + 1), rng.choice(items)[1] or "")
        docs.append((i % 55 if i != 7 else None, " ".join(t).title(), "old"))
    docs += [(70, None, "old"), (71, "", "old"), (72, "x " * 50_000 + items[3][1], "old")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(frame, bench, keep=["doc_id"], block_windows=block).collect()
    want = sorted(((i, *brute8(t, items)) for i, t, _ in docs), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_decontaminate_empty(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = D.decontaminate(docs, bench).collect()
    assert len(rows) == docs.count() and not any(r["contaminated"] for r in rows)
    assert "score" in rows[0].asDict()
    assert D.decontaminate(empty, bench, keep=["doc_id"]).count() == 0


def sets10(t):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n = min(5, len(w))
    return frozenset(tuple(w[s:s + n]) for s in range(len(w) - n + 1)) if n else frozenset()


def brute10(rows):
    sets = [(i, sets10(t)) for i, t in rows]
    inverted = {}
    for k, (i, s) in enumerate(sets):
        for g in s if i is not None else ():
            inverted.setdefault(g, []).append(k)
    links = {}
    for k, (i, s) in enumerate(sets):
        common = {}
        for g in s if i is not None else ():
            for o in inverted[g]:
                common[o] = common.get(o, 0) + 1
        links[k] = [o for o, c in common.items() if 100 * c >= 80 * (len(s) + len(sets[o][1]) - c)]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, others in links.items():
        for o in others:
            a, b = find(sets[k][0]), find(sets[o][0])
            root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def test_join_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in J.ngram_components(docs).collect()), key=repr)
    assert got == brute10(rows)


@pytest.mark.parametrize("shingles,rows_sent", [(100_000, 10**6), (2000, 500), (2000, 0)])
def test_join_of_a_family_near_the_threshold(spark, monkeypatch, shingles, rows_sent):
    """Hundreds of variants around 0.8, in several blocks, with a passage in all others."""
    monkeypatch.setattr(J, "BLOCK", 40)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(J, "BROADCAST_ROWS", rows_sent)
    monkeypatch.setattr(J, "BROADCAST_BYTES", rows_sent // 50)
    rng = random.Random(8)
    base = [f"b{rng.randrange(9999)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(25))
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(120)] = f"z{rng.randrange(99999)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, passage + " " + " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.randrange(4, 90))))
             for i in range(150)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in J.ngram_components(frame).collect()), key=repr) == brute10(rows)


def test_join_empty(empty):
    assert J.ngram_components(empty).count() == 0
