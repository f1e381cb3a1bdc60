"""Finished steps leave no shuffle files: they would add up on disk until the driver collects its garbage."""
import random
import time

import pytest

from prefsight.llm import op12_repeated_spans as S
from prefsight.llm.components import connected_components
from prefsight.llm.op10_ngram_join import ngram_components


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def left_by(spark, call):
    """Shuffle files that a call has left; they are removed in the background."""
    before = shuffle_files(spark)
    out = call()
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    return out, left


@pytest.fixture(scope="module")
def near_copies(spark):
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(100 + i, " ".join([*w[:60], "changed", *w[61:]])) for i, w in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10], "src long, dst long")
    out, left = left_by(spark, lambda: connected_components(edges))
    assert not left
    for _ in range(2):  # the result can be run again
        found = {r["node"]: r["component"] for r in out.collect()}
        assert found == {i: i - (i - 1) % 10 for i in range(1, 41)}


def test_ngram_components(spark, near_copies):
    out, left = left_by(spark, lambda: ngram_components(near_copies))
    assert not left
    for _ in range(2):
        assert all(r["component_id"] == r["doc_id"] % 100 for r in out.collect())


def test_repeated_spans(spark, near_copies):
    out, left = left_by(spark, lambda: S.repeated_spans(near_copies))
    assert not left
    for _ in range(2):
        assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {i: 119 * (i >= 100) for i in [*range(20), *range(100, 120)]}
