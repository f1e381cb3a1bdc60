import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefsight.operators import ensemble as en
from prefsight.operators import indexing
from prefsight.operators import margins as mg
from prefsight.operators import selection
from prefsight.operators.selection import order_statistics

INF, NAN = float("inf"), float("nan")


def key(v):
    return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)


def groups(seed):
    rng = random.Random(seed)
    return {
        "normal": [rng.gauss(0, 1) for _ in range(700)],
        "ties": [float(rng.randrange(4)) for _ in range(500)],
        "powers": [2.0 ** rng.randrange(-1070, 1020) * rng.choice([1, -1]) for _ in range(300)],
        "huge": [1.7e308, -1.7e308, 1.6e308, 0.0, 1.0, 5e-324, -5e-324] * 3,
        "special": [None, NAN, INF, -INF, 0.0, -0.0, 3.0, None, NAN, INF, -INF] + [rng.random() for _ in range(40)],
        "one": [7.0], "none": [None, None], "same": [2.5] * 200}


@pytest.mark.parametrize("cells,small,few", [(4096, 512, 256), (16, 1, 256), (64, 8, 0)])
def test_every_place(spark, monkeypatch, cells, small, few):
    monkeypatch.setattr(selection, "FEW_PLACES", few)  # 0: followed in a table
    data = groups(cells)
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ask = {g: sorted({0, 1, len(vs) // 4, len(vs) // 2, len(vs) - 2, len(vs) - 1, len(vs), -1}) for g, vs in data.items()}
    places = spark.createDataFrame([(g, p) for g, ps in ask.items() for p in ps] + [("absent", 0), ("one", 0)], "g string, place long")
    got = {(r["g"], r["place"]): r["value"] for r in order_statistics(df, ["g"], "v", places, cells=cells, small=small).collect()}
    want = {(g, p): sorted(data[g], key=key)[p] for g, ps in ask.items() for p in ps if 0 <= p < len(data[g])}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert key(got[k]) == key(v), k


def test_quantiles_and_threshold_without_a_sort(spark, monkeypatch):
    def sorted_table(*_, **__):
        raise AssertionError("the table was sorted")
    monkeypatch.setattr(indexing, "global_index", sorted_table)
    rng = np.random.default_rng(0)
    x = {g: rng.normal(size=n) ** 3 for g, n in (("a", 5000), ("b", 3), ("c", 1))}
    df = spark.createDataFrame([(g, i, float(v)) for g, vs in x.items() for i, v in enumerate(vs)], "g string, k long, v double")
    got = {r["g"]: r for r in mg.exact_quantiles(df, ["g"], "v", "k", qs=(0.0, 0.3, 0.5, 1.0), names=["a", "b", "c", "d"]).collect()}
    for g, vs in x.items():
        np.testing.assert_allclose(list(got[g])[1:], np.percentile(vs, [0, 30, 50, 100]), rtol=1e-12)
    pred = df.where("g = 'a'").select("k", F.abs("v").alias("std_reward"))
    for rate in (0.0, 0.1, 1.0):
        r = en.calibrate_threshold(pred, "k", rate).first()
        at = min(int(5000 * (1 - rate)), 4999)
        assert (r["n"], r["position"], r["threshold"]) == (5000, at, sorted(abs(x["a"]))[at])
    with pytest.raises(ValueError):
        en.calibrate_threshold(pred.limit(0), "k")


def test_many_groups_join(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW_PLACES", 0)
    monkeypatch.setattr(selection, "MAX_BROADCAST_RANGES", 0)
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1009).cast("double").alias("v"))
    places = spark.createDataFrame([(g, p) for g in range(7) for p in (0, 200, 427)], "g long, place long")
    data = {}
    for r in df.collect():
        data.setdefault(r["g"], []).append(r["v"])
    got = order_statistics(df, ["g"], "v", places, cells=16, small=4).collect()
    assert len(got) == 21 and all(sorted(data[r["g"]])[r["place"]] == r["value"] for r in got)
