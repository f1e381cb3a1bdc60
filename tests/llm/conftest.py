import os
import random

import pytest

SF = os.environ.get("PREFSIGHT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts(spark):
    """Texts of the mounted documents, with edge cases, as (id, text) rows."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(rng.choice(words) for _ in range(60))
    near = base.split()
    near[30] = "other"
    more = [None, "", "  \t\n ", "One", "one two  THREE", "one two three", base, base, base.upper(), " ".join(near),
            long, long + " tail", "é ü 😀 x\u0085y", "a▁b ▁", "x" * 5000]
    return rows + [(10**6 + i, t) for i, t in enumerate(more)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with null and repeated ids and columns whose names clash with results."""
    rows = [(i, t, "score", 1, "x") for i, t in texts]
    rows += [(None, "a row without id", "score", 1, "x"), (1_000_004, "one two  THREE", "score", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int, component_id string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
