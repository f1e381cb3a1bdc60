import re

import numpy as np

from prefsight.llm import kernels as K
from prefsight.llm.components import connected_components

PATTERNS = {K.SPACE_WORDS: rb"[^\x20\x09-\x0D]+", K.ALNUM_WORDS: rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def lower(t: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in t)


def test_words_are_those_of_the_patterns(texts):
    raw = [(t or "").encode() for _, t in texts]
    for kind, pattern in PATTERNS.items():
        hashes, bounds = K.word_hashes(raw, kind)
        name: dict = {}
        for i, t in enumerate(raw):
            words = re.findall(pattern, lower(t))
            mine = hashes[bounds[i]:bounds[i + 1]]
            assert len(words) == len(mine)
            for w, h in zip(words, mine.tolist(), strict=True):
                assert name.setdefault(w, h) == h
        assert len(set(name.values())) == len(name)


def test_runs_of_repeated_words_differ():
    words = K.mix(np.arange(3, dtype=np.uint64))
    runs = {}
    for a in np.ndindex(3, 3, 3, 3, 3):
        runs[a] = int(K.rolling(words[list(a)], 5)[0])
    assert len(set(runs.values())) == 3**5
    assert len(K.rolling(words, 4)) == 0


def test_long_text_is_one_chunk():
    h, b = K.word_hashes([b"ab " * 2_000_000, b"ab"], K.SPACE_WORDS)
    assert b.tolist() == [0, 2_000_000, 2_000_001] and len(set(h.tolist())) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r["node"]: r["component"] for r in
           connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {199: 199, 200: 199}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
