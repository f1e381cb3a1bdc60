import numpy as np
import pytest

from prefsight.operators import neighbours as nb


def brute(x):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return d.min(axis=1)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "k long, v array<double>")


def clusters(seed, n, dim, groups, spread):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] * 10 + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("x,pivots,ring", [
    (clusters(1, 600, 8, 20, 0.3), None, 32),
    (clusters(2, 500, 4, 1, 1.0), 3, 16),          # one dense cell of many rings
    (np.random.default_rng(3).normal(size=(300, 40)), 40, 50),  # distances all alike
    (np.round(clusters(4, 400, 2, 5, 0.5)), 10, 8),  # grid: many copies and ties
    (np.arange(50.0)[:, None], 50, 1),               # every vector a pivot
], ids=["clusters", "dense", "alike", "grid", "pivots"])
def test_equals_brute_force(spark, x, pivots, ring):
    got = nb.nearest_distance_exact(frame(spark, x), "k", "v", pivots=pivots, ring_size=ring, query_rows=64)
    mine = {r["k"]: r["nn_distance"] for r in got.collect()}
    assert len(mine) == len(x)
    np.testing.assert_allclose([mine[i] for i in range(len(x))], brute(x), rtol=1e-9, atol=1e-12)


def test_few_items_copies_and_nulls(spark):
    schema = "k long, v array<double>"

    def run(rows):
        return {r["k"]: r["nn_distance"] for r in nb.nearest_distance_exact(spark.createDataFrame(rows, schema), "k", "v").collect()}
    assert run([]) == {}
    assert run([(1, [1.0, 2.0])]) == {1: None}
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)]) == {1: 0.0, 2: 0.0, 3: None}
    assert run([(1, [0.0]), (2, [3.0]), (3, [3.0]), (4, [7.0])]) == {1: 3.0, 2: 0.0, 3: 0.0, 4: 4.0}


def test_most_rings_are_not_visited(spark, monkeypatch):
    """On clustered vectors the bounds leave a small part of all distances."""
    x = clusters(5, 3000, 6, 60, 0.05)
    seen = spark.sparkContext.accumulator(0)
    real = nb._nearest

    def counted(a, b, same=False):
        seen.add(len(a) * len(b))
        return real(a, b, same)
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(nb)
    monkeypatch.setattr(nb, "_nearest", counted)
    try:
        got = {r["k"]: r["nn_distance"] for r in nb.nearest_distance_exact(frame(spark, x), "k", "v", ring_size=64).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(nb)
    np.testing.assert_allclose([got[i] for i in range(len(x))], brute(x), rtol=1e-9)
    assert seen.value < 0.1 * len(x) ** 2


def test_distances_are_made_in_blocks(spark, monkeypatch):
    """a task's arrays held a whole batch times all pivots, and grew with both."""
    x = np.random.default_rng(6).normal(size=(900, 12))
    seen = spark.sparkContext.accumulator(0)
    large = spark.sparkContext.accumulator(0)
    real = nb._distances

    def noted(a, b):
        if a is not b:  # the pivots among themselves
            seen.add(1)
            large.add(int(len(a) * len(b) > 2000))
        return real(a, b)
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(nb)
    monkeypatch.setattr(nb, "_distances", noted)
    monkeypatch.setattr(nb, "BLOCK_ENTRIES", 2000, raising=False)
    try:
        got = {r["k"]: r["nn_distance"] for r in nb.nearest_distance_exact(
            frame(spark, x).coalesce(1), "k", "v", pivots=100, ring_size=50, query_rows=500).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(nb)
    np.testing.assert_allclose([got[i] for i in range(len(x))], brute(x), rtol=1e-9)
    assert seen.value > 0 and large.value == 0


def test_vectors_are_sent_to_blocks_and_not_to_rings(spark, monkeypatch):
    """on distances all alike every vector was sent once to each ring, which filled the disk."""
    x = np.random.default_rng(7).normal(size=(2000, 40))
    rows = spark.sparkContext.accumulator(0)
    real = nb.batch_matrix

    def counted(series):
        rows.add(len(series))
        return real(series)
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(nb)
    monkeypatch.setattr(nb, "batch_matrix", counted)
    try:
        got = {r["k"]: r["nn_distance"] for r in nb.nearest_distance_exact(frame(spark, x), "k", "v", ring_size=32).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(nb)
    np.testing.assert_allclose([got[i] for i in range(len(x))], brute(x), rtol=1e-9)
    assert 0 < rows.value < 30 * len(x)


@pytest.mark.parametrize("x", [np.random.default_rng(8).normal(size=(700, 30)), clusters(9, 700, 5, 12, 0.2)],
                         ids=["alike", "clusters"])
def test_blocks_take_turns_and_leave_no_files(spark, monkeypatch, x):
    """what a turn wrote goes before the next; only the vectors and their distances stay until the result is read."""
    import time
    from pathlib import Path

    def shuffled():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f: Path(f).stat().st_size for f in disk.getAllFiles().mkString("\n").split("\n")
                if "/shuffle_" in f and Path(f).exists()}

    def kept():
        return {f.name for f in (Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) / "prefsight-scratch").glob("nearest-*")}
    turns = []
    real = nb._compared
    monkeypatch.setattr(nb, "WAVE_ROWS", 0)
    monkeypatch.setattr(nb, "WAVE_COPIES", 1)
    monkeypatch.setattr(nb, "_compared", lambda *a: turns.append(1) or real(*a))
    before, tables = shuffled(), kept()
    result = nb.nearest_distance_exact(frame(spark, x), "k", "v", ring_size=16, block_rows=100, query_rows=90)
    for _ in range(50):  # they are removed in the background
        left = sum(size for f, size in shuffled().items() if f not in before)
        if left < x.size:
            break
        time.sleep(0.2)
    assert len(turns) > 1 and len(kept() - tables) == 2 and left < x.size  # an eighth of the vectors' bytes
    got = {r["k"]: r["nn_distance"] for r in result.collect()}
    np.testing.assert_allclose([got[i] for i in range(len(x))], brute(x), rtol=1e-9)


def test_single_floats_and_integers(spark):
    """Vectors keep their element type where it is float; others are compared as doubles."""
    for kind in ("float", "int"):
        rows = [(i, [int(v) for v in row]) for i, row in enumerate(np.random.default_rng(10).integers(0, 50, (200, 3)))]
        items = spark.createDataFrame(rows, "k long, v array<int>").selectExpr("k", f"cast(v as array<{kind}>) v")
        got = {r["k"]: r["nn_distance"] for r in nb.nearest_distance_exact(items, "k", "v", ring_size=16).collect()}
        np.testing.assert_allclose([got[i] for i in range(200)], brute(np.array([v for _, v in rows], dtype=float)), rtol=1e-12)


@pytest.mark.parametrize("scale", [1e-20, 1.0, 1e20])
def test_screen_leaves_out_no_nearer_vector(scale):
    """F1: single-precision products only tell which vectors are compared in double precision."""
    rng = np.random.default_rng(11)
    x, y = (scale * (5.0 + rng.normal(size=(n, 64))) for n in (300, 200))
    y[:20] = x[:20] * (1 + 1e-9)  # far nearer than single precision can tell
    d = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)).min(axis=1)
    screen, rows = nb._Screen(x, y, 300 * 200), np.arange(300)
    for best in (d * (1 + 1e-9), d + 1e-12 * scale):
        assert screen.may_be_nearer(rows, slice(0, 200), best).all()
    told = screen.may_be_nearer(rows, slice(0, 200), d * 0.99)
    assert not told[20:].any()


def test_screen_is_asked_of_few_rings(spark, monkeypatch):
    """F1: the rings of a block that bounds leave out are not compared in single precision either."""
    x = clusters(12, 3000, 6, 60, 0.05)
    seen = spark.sparkContext.accumulator(0)
    real = nb._Screen.may_be_nearer

    def counted(self, rows, ring, best):
        seen.add(len(rows) * (ring.stop - ring.start))
        return real(self, rows, ring, best)
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(nb)
    monkeypatch.setattr(nb._Screen, "may_be_nearer", counted)
    try:
        got = {r["k"]: r["nn_distance"] for r in nb.nearest_distance_exact(frame(spark, x), "k", "v", ring_size=16).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(nb)
    np.testing.assert_allclose([got[i] for i in range(len(x))], brute(x), rtol=1e-9)
    assert 0 < seen.value < 0.1 * len(x) ** 2


def test_blocks_and_turns_are_bounded():
    """neither a block nor a turn grows with the vectors, their length or the rings that each may need."""
    for n, dim in ((10, 3), (50_000, 64), (10 ** 6, 64), (10 ** 9, 4096), (10 ** 9, 1)):
        rows = nb._block_rows(n, dim, nb.RING_SIZE)
        assert 1 <= rows <= nb.BLOCK_ROWS and rows * dim <= nb.BLOCK_VALUES
    asked, held = {b: 1000 - b for b in range(20)}, dict.fromkeys(range(20), 100)
    turns = list(nb._turns(asked, held, 300, 3000))
    assert [b for turn in turns for b in turn] == list(range(20)) and len(turns) > 1
    assert all(300 * copies >= asked[b] for turn in turns for b, copies in turn.items())
    assert all(sum(asked[b] + copies * held[b] for b, copies in turn.items()) <= 3000 for turn in turns)
    assert list(nb._turns({3: 9000, 5: 1}, {3: 10, 5: 10}, 100, 50)) == [{3: 90}, {5: 1}]
