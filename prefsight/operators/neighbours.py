"""ACT-5 at scale: exact nearest distances by pivot partitions and distance bounds.

Some vectors are *pivots*; every vector belongs to the cell of its nearest pivot.  A
cell is ordered by the distance to its pivot and cut into rings of at most
``ring_size`` vectors, so a cell that holds a third of all vectors is many rings.
Rings of near cells, one after the other, make up blocks of about ``block_rows``
vectors.

For a vector x with a known upper bound u on its nearest distance, a ring of pivot p
with distances in [near, far] can hold a nearer one only if

* ``d(x, p) - far < u`` and ``near - d(x, p) < u`` (triangle inequality), and
* ``(d(x, p)^2 - d(x, c)^2) / (2 d(p, c)) < u`` for x's own pivot c (every vector of
  p's cell is on p's side of the plane between p and c).

First bounds come from the pivots and from each ring by itself; then every vector is
sent only to the blocks with a ring that passes, once to each, and is compared there
only with the rings that pass.  No vector that could be nearer is left out, so the
result is exact; how many rings are visited depends on the data (few if vectors
cluster, most of them if all distances are alike).

Disk: a vector goes to blocks and not to rings, and the blocks take their turns, so at
most some ``WAVE_COPIES`` copies of the vectors are in shuffle files at a time however
many comparisons are needed; those of a turn go when its distances are stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefsight.operators.indexing import index_within_group
from prefsight.operators.linalg import batch_matrix
from prefsight.session import checkpointed, discarded, ensure_checkpoint_dir, shuffles_removed, stored

MAX_PIVOTS = 1024
RING_SIZE = 1024
#: Vectors of a block, and vectors sent to one copy of a block; fewer if they have more numbers than that.
BLOCK_ROWS = 1 << 15
BLOCK_VALUES = 1 << 21
#: Fewer in a block if there are not so many vectors, so that there are tasks enough.
LEAST_BLOCKS = 8
#: Vectors sent in one turn: so many times all vectors, or WAVE_ROWS if that is more.
WAVE_COPIES = 4
WAVE_ROWS = 1 << 20
#: Tasks of a turn; more copies of blocks are one after the other.
MAX_TASKS = 4096
#: Distances that a task holds in one array, whatever the pivots, the rows of a batch or of a ring.
BLOCK_ENTRIES = 1 << 19


def _blocks(rows: int, width: int):
    """Slices of ``rows`` rows whose distances to ``width`` vectors fit into one array."""
    step = max(1, BLOCK_ENTRIES // max(1, width))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; products are taken around b's mean to keep digits."""
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(d2, 0.0))


def _order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the squared distances less a constant of the row, around b's mean: the order of b for each row of a."""
    centre = b.mean(axis=0)
    b = b - centre
    d = (a - centre) @ b.T
    return np.subtract(0.5 * (b * b).sum(axis=1), d, out=d)


def _nearest(a: np.ndarray, b: np.ndarray, same: bool = False) -> np.ndarray:
    """Distance of each row of a to the nearest row of b (of the others, if a is b)."""
    if not len(b) or (same and len(b) < 2):
        return np.full(len(a), np.inf)
    at = np.empty(len(a), dtype=np.int64)
    for part in _blocks(len(a), len(b)):
        d = _order(a[part], b)
        if same:
            np.fill_diagonal(d[:, part], np.inf)
        at[part] = d.argmin(axis=1)
    return np.sqrt(((a - b[at]) ** 2).sum(axis=1))


def _slack(u):
    """Room for rounding when bounds are compared."""
    return u + 1e-9 * (1.0 + u)


def _may_hold(d, near, far, u, own, gap):
    """Whether vectors between ``near`` and ``far`` of a pivot can be nearer than ``u``: ``d`` is the distance to that
    pivot, ``own`` to the own pivot, ``gap`` between the two."""
    room = _slack(u)
    plane = np.divide(d ** 2 - own ** 2, 2.0 * gap, out=np.full_like(d, -np.inf), where=gap > 0)
    return (d - far < room) & (near - d < room) & (plane < room + 1e-9 * d)


def choose_pivots(vectors: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """Up to ``n`` of the vectors (columns id, vec), those with the least keyed hashes."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(n).select("vec").collect()  # <= MAX_PIVOTS
    return np.array([r["vec"] for r in rows], dtype=np.float64)


def _chain(between: np.ndarray) -> list[int]:
    """The pivots, each followed by the nearest one that is left."""
    left, chain = np.ones(len(between), dtype=bool), [0]
    left[0] = False
    while left.any():
        chain.append(int(np.where(left, between[chain[-1]], np.inf).argmin()))
        left[chain[-1]] = False
    return chain


def _candidates(pdf: pd.DataFrame, pivots: np.ndarray, between: np.ndarray, parts: pd.DataFrame, blocks: int) -> np.ndarray:
    """Which of the first ``blocks`` blocks can hold a vector nearer than u, for each row.

    ``parts`` has what a block has of a cell, by cell: distances from near to far, rings from first to last."""
    cell, first = np.unique(parts["cell"].to_numpy(), return_index=True)
    near, far = parts["near"].to_numpy(), parts["far"].to_numpy()
    u, own, r = pdf["u"].to_numpy(), pdf["cell"].to_numpy(), pdf["r"].to_numpy()
    d = _distances(batch_matrix(pdf["vec"]), pivots[cell])
    row, at = np.nonzero(_may_hold(d, np.minimum.reduceat(near, first), np.maximum.reduceat(far, first),
                                   u[:, None], r[:, None], between[own][:, cell]))
    # All parts of each cell that passes.
    width = np.diff(np.append(first, len(parts)))[at]
    part = np.arange(width.sum()) + np.repeat(first[at] - (np.cumsum(width) - width), width)
    dp, row = np.repeat(d[row, at], width), np.repeat(row, width)
    room = _slack(u)[row]
    ring = pdf["ring"].to_numpy()[row]
    itself = ((parts["cell"].to_numpy()[part] == own[row]) & (parts["first"].to_numpy()[part] == ring)
              & (parts["last"].to_numpy()[part] == ring))
    ok = (dp - far[part] < room) & (near[part] - dp < room) & ~itself
    out = np.zeros((len(pdf), blocks), dtype=bool)
    out[row[ok], parts["block"].to_numpy()[part[ok]]] = True
    return out


class _Screen:
    """Single-precision products of the rows of x and of y that tell which rows of x may have a nearer one in y.

    The bound on their rounding, 2^-23 for each of the products of a row and some more, is on the side of telling too
    many rows; distances are never taken from here."""

    def __init__(self, x: np.ndarray, y: np.ndarray, entries: int):
        centre = y.mean(axis=0)
        x, y = x - centre, y - centre
        self.scale = max(np.abs(x).max(), np.abs(y).max()) or 1.0
        x, y = x / self.scale, y / self.scale
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        # Their product is half the squared distance less half of xx.
        self.x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
        self.y = np.hstack([-y, 0.5 * yy[:, None]]).astype(np.float32)
        self.over = (x.shape[1] + 8) * 2.0 ** -23 * (np.sqrt(xx * yy.max()) + yy.max()) - 0.5 * xx + 1e-30
        self.held = np.empty(entries, dtype=np.float32)

    def may_be_nearer(self, rows: np.ndarray, ring: slice, best: np.ndarray) -> np.ndarray:
        """Whether each of ``rows`` may be nearer than ``best`` to one of the rows of y in ``ring``."""
        y = self.y[ring]
        d = np.matmul(self.x[rows], y.T, out=self.held[:len(rows) * len(y)].reshape(len(rows), len(y)))
        least = d[np.arange(len(rows)), d.argmin(axis=1)]
        return least <= 0.5 * (best / self.scale) ** 2 + self.over[rows]


def _against(a: pd.DataFrame, b: pd.DataFrame, pivots: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The bounds of the rows of a after a comparison with those rings of b, each in one piece, that may hold a nearer one."""
    b = b.sort_values(["cell", "ring"], ignore_index=True)
    x, y, best = batch_matrix(a["vec"]), batch_matrix(b["vec"]), a["u"].to_numpy(copy=True)
    cell, ring, r = (a[c].to_numpy() for c in ("cell", "ring", "r"))
    rings = [(*key, slice(at[0], at[-1] + 1), b["r"].to_numpy()[at].min(), b["r"].to_numpy()[at].max())
             for key, at in b.groupby(["cell", "ring"]).indices.items()]
    cells = np.unique(b["cell"].to_numpy())
    width = max(len(cells), *(at.stop - at.start for _, _, at, _, _ in rings))
    screen = _Screen(x, y, max(BLOCK_ENTRIES, width))
    for part in _blocks(len(x), width):
        d = dict(zip(cells, _distances(x[part], pivots[cells]).T))
        for c, k, at, near, far in rings:
            ok = _may_hold(d[c], near, far, best[part], r[part], between[cell[part], c])
            rows = part.start + np.nonzero(ok & ((cell[part] != c) | (ring[part] != k)))[0]
            if len(rows):
                rows = rows[screen.may_be_nearer(rows, at, best[rows])]
            if len(rows):
                best[rows] = np.minimum(best[rows], _nearest(x[rows], y[at]))
    return best


def _block_rows(n: int, dim: int, ring_size: int) -> int:
    """Vectors of a block, of ``n`` of ``dim`` numbers; a ring is never split."""
    return max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, dim), max(ring_size, -(-n // LEAST_BLOCKS))))


def _turns(asked: dict[int, int], held: dict[int, int], query_rows: int, most: int) -> Iterator[dict[int, int]]:
    """Blocks that take their turn together with the copies of each: a copy for ``query_rows`` vectors, and ``most``
    rows sent in a turn, or one block."""
    turn, rows = {}, 0
    for block in sorted(asked):
        copies = -(-asked[block] // query_rows)
        sent = asked[block] + copies * held[block]
        if turn and rows + sent > most:
            yield turn
            turn, rows = {}, 0
        turn[block], rows = copies, rows + sent
    if turn:
        yield turn


def _compared(queries: DataFrame, bounded: DataFrame, sent, parts: pd.DataFrame, turn: dict[int, int]) -> DataFrame:
    """(id, u) of the vectors that may have a nearer one in the blocks of ``turn``, after a comparison with them."""
    spark = queries.sparkSession
    numbers = np.array(list(turn), dtype=np.int32)
    own = parts[parts["block"].isin(numbers)].reset_index(drop=True)
    own["block"] = np.searchsorted(numbers, own["block"])
    of = spark.sparkContext.broadcast(own)

    def asks(batches):
        p, between = sent.value
        for pdf in (batch.iloc[part] for batch in batches for part in _blocks(len(batch), max(len(p), len(numbers)))):
            row, block = np.nonzero(_candidates(pdf, p, between, of.value, len(numbers)))
            yield pdf.iloc[row].assign(block=numbers[block])

    def across(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "u": pd.Series([], dtype="float64")})
        return pd.DataFrame({"id": a["id"], "u": _against(a, b, *sent.value)})

    copies = F.broadcast(spark.createDataFrame(list(turn.items()), "block int, n long"))  # one row per block
    tasks = min(4 * sum(turn.values()), MAX_TASKS)  # so many that few have two copies
    key = ["block", "copy"]
    schema = T.StructType([*queries.schema, T.StructField("block", T.IntegerType())])
    asked = (queries.mapInPandas(asks, schema).join(copies, "block")
             .withColumn("copy", F.pmod(F.xxhash64("id"), F.col("n"))).drop("n").repartition(tasks, *key))
    held = (bounded.where(F.col("block").between(int(numbers[0]), int(numbers[-1])))
            .select("block", "cell", "ring", "r", "vec").join(copies, "block")
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
            .drop("n").repartition(tasks, *key))
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(across, "id long, u double")


def nearest_distance_exact(items: DataFrame, key_col: str, vec_col: str, *, pivots: int | None = None,
                           ring_size: int = RING_SIZE, query_rows: int | None = None, block_rows: int | None = None,
                           seed: int = 0) -> DataFrame:
    """(key, nn_distance): exact Euclidean distance to the nearest other item.

    ``pivots`` defaults to the square root of the number of vectors, at most
    ``MAX_PIVOTS``; ``block_rows`` and ``query_rows`` to ``BLOCK_ROWS``, a
    ``LEAST_BLOCKS``-th of the vectors or ``BLOCK_VALUES`` numbers, whichever is least.
    Items with equal vectors have distance 0 and are one vector in the search, so a group
    of copies costs one row.  A null vector, and an item that is alone, has a null
    distance.  Vectors have one length and finite components."""
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    of = items.schema[vec_col].dataType
    kind = "array<float>" if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else "array<double>"
    src = items.select(F.col(key_col), F.col(vec_col).cast(kind).alias("vec"))
    distinct = stored(src.where("vec is not null").groupBy("vec").agg(F.count(F.lit(1)).alias("copies"))
                      .withColumn("id", F.monotonically_increasing_id()), "nearest-distinct")
    n = distinct.count()
    if n < 2:
        return src.join(distinct.select(F.col("vec").alias("of"), "copies"), F.col("vec") == F.col("of"), "left").select(
            key_col, F.when(F.col("copies") > 1, F.lit(0.0)).alias("nn_distance"))
    chosen = choose_pivots(distinct.select("id", "vec"), min(pivots or math.isqrt(n) + 1, MAX_PIVOTS), seed)
    sent = spark.sparkContext.broadcast((chosen, _distances(chosen, chosen)))

    def place(batches):
        p, _ = sent.value
        for pdf in (batch.iloc[part] for batch in batches for part in _blocks(len(batch), len(p))):
            x = batch_matrix(pdf["vec"])
            d = _distances(x, p)
            cell = d.argmin(axis=1)
            # A pivot's own distance is 0: its bound is the next pivot.
            exact = np.sqrt(((x[:, None, :] - p[cell][:, None, :]) ** 2).sum(axis=2))[:, 0]
            other = np.where(d > 1e-6 * (1.0 + d.max()), d, np.inf).min(axis=1)
            bound = np.where(exact > 0, exact, other)
            yield pd.DataFrame({"id": pdf["id"], "cell": cell.astype(np.int32), "r": exact, "u": bound})

    placed = checkpointed(distinct.mapInPandas(place, "id long, cell int, r double, u double"))
    members = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most MAX_PIVOTS rows
    size = block_rows or _block_rows(n, chosen.shape[1], ring_size)
    asked_rows = query_rows or size
    starts, start = np.zeros(len(chosen), dtype=np.int64), 0
    for c in _chain(sent.value[1]):
        starts[c], start = start, start + members.get(c, 0)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x = batch_matrix(pdf["vec"])
        u = np.minimum(pdf["u"].to_numpy(), _nearest(x, x, same=True))
        block = (starts[pdf["cell"].iloc[0]] + pdf["ring"].iloc[0] * ring_size) // size
        return pdf.assign(u=u, block=np.int32(block))

    with shuffles_removed(spark):
        rings = checkpointed(index_within_group(placed, ["cell"], ["r", "id"], "pos")
                             .withColumn("ring", F.floor(F.col("pos") / ring_size).cast("int")).drop("pos"))
    row = f"id long, copies long, cell int, ring int, r double, u double, vec {kind}"
    bounded = stored(distinct.join(rings, "id").select("id", "copies", "cell", "ring", "r", "u", "vec")
                     .groupBy("cell", "ring").applyInPandas(inside, f"{row}, block int"), "nearest-bounded")
    discarded(distinct)
    # What each block has of each cell: no more rows than pivots and blocks.
    shape = [(r["cell"], r["block"], r["near"], r["far"], r["first"], r["last"], r["rows"])
             for r in bounded.groupBy("cell", "block").agg(
                 F.min("r").alias("near"), F.max("r").alias("far"), F.min("ring").alias("first"),
                 F.max("ring").alias("last"), F.count(F.lit(1)).alias("rows")).collect()]
    parts = pd.DataFrame(shape, columns=["cell", "block", "near", "far", "first", "last", "rows"]).sort_values(
        ["cell", "block"], ignore_index=True)
    held_rows = parts.groupby("block")["rows"].sum()
    blocks = int(parts["block"].max()) + 1
    every = spark.sparkContext.broadcast(parts)
    queries = bounded.where("copies = 1 and u > 0").drop("copies", "block")

    def asks(batches):
        p, between = sent.value
        total = np.zeros(blocks, dtype=np.int64)
        for pdf in (batch.iloc[part] for batch in batches for part in _blocks(len(batch), max(len(p), blocks))):
            total += _candidates(pdf, p, between, every.value, blocks).sum(axis=0)
        block = np.nonzero(total)[0]
        yield pd.DataFrame({"block": block.astype(np.int32), "n": total[block]})

    counts = {r["block"]: r["n"] for r in queries.mapInPandas(asks, "block int, n long").groupBy("block").agg(
        F.sum("n").alias("n")).collect()}  # one row per block
    best = bounded.select("id", "u")
    for k, turn in enumerate(_turns(counts, held_rows, asked_rows, max(WAVE_ROWS, WAVE_COPIES * n))):
        before, best = best, stored(best.union(_compared(queries, bounded, sent, parts, turn))
                                    .groupBy("id").agg(F.min("u").alias("u")), "nearest-best")
        if k:
            discarded(before)
    best = (best.join(bounded.select("id", "vec", "copies"), "id")
            .select(F.col("vec").alias("of"),
                    F.when(F.col("copies") > 1, F.lit(0.0)).otherwise(F.col("u")).alias("nn_distance")))
    return src.join(best, F.col("vec") == F.col("of"), "left").select(key_col, "nn_distance")
