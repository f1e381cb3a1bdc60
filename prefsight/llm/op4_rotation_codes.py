"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated by ``rotations`` random orthogonal matrices; the signs of
its coordinates are its code, and the inner product of the vector with its code is
stored as correction factor.  For a query q, ``<code, rotated q> / (sqrt(d) factor)``
estimates the cosine without bias, with an error below
``bound * sqrt((1 - factor**2) / factor**2 / (d - 1))`` except with a probability that
vanishes in ``bound**2``; the mean over rotations is tighter.  Only pairs whose upper
confidence bound reaches the threshold are recomputed exactly, in double precision.

Pairs to estimate come from bands of the code bits: pairs at the threshold agree in
``bits`` bits of at least one of ``bands`` bands with probability ``1 - miss``.  A
pair is counted in the first band it shares.  ``bits`` follows the logarithm of the
number of vectors, so buckets stay small; a larger bucket is dealt into blocks whose
pairs are tasks' groups.  Equal vectors are one class with a multiplicity, and a
block sends a count per vector and a spanning forest, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefsight.llm.components import connected_components
from prefsight.session import ensure_checkpoint_dir

THRESHOLD = 0.93
MISS = 0.002
BOUND = 5.0
BUCKET = 64
BLOCK = 1024
CELL_ROWS = 4096
SEED = 4


class Plan:
    """Bits of a band, number of bands and the rotations of each dimension."""

    def __init__(self, n: int, threshold: float = THRESHOLD, miss: float = MISS):
        self.threshold = threshold
        agree = 1 - math.acos(threshold) / math.pi
        self.bits = min(30, max(4, math.ceil(math.log2(max(2, n) / BUCKET)))) if n > BUCKET else 4
        self.bands = math.ceil(math.log(miss) / math.log(1 - agree ** self.bits))
        self.made: dict[int, np.ndarray] = {}

    def rotations(self, d: int) -> np.ndarray:
        """(rotations, d, d) orthogonal matrices, the same on every machine."""
        if d not in self.made:
            rng = np.random.default_rng([SEED, d])
            count = math.ceil(self.bits * self.bands / d)
            q, r = np.linalg.qr(rng.standard_normal((count, d, d)))
            self.made[d] = q * np.sign(np.diagonal(r, axis1=1, axis2=2))[:, None, :]
        return self.made[d]

    def __getstate__(self):
        return {**self.__dict__, "made": {}}

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signs, factors) of unit vectors: (n, rotations, d) booleans, (n, rotations)."""
        turned = np.einsum("nd,kde->nke", x, self.rotations(x.shape[1]))
        return turned >= 0, np.abs(turned).sum(axis=2) / math.sqrt(x.shape[1])

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each band."""
        flat = signs.reshape(len(signs), -1)[:, :self.bits * self.bands].reshape(len(signs), self.bands, self.bits)
        return flat @ (1 << np.arange(self.bits, dtype=np.int64))


def usable(vector) -> np.ndarray | None:
    """The vector as doubles, if it has only finite components and is not zero."""
    if not vector or any(v is None for v in vector):
        return None
    x = np.array(vector, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signature_rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        sigs, vecs = [], []
        for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x = None if label is None else usable(vector)
            raw = None if x is None else (x + 0.0).tobytes()
            vecs.append(raw)
            sigs.append(None if raw is None else hashlib.blake2b(repr(label).encode() + b" " + raw, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary()),
                                          pa.array(vecs, pa.binary())], names=["id", "label", "sig", "vec"])


def _code_rows(batches, plan: Plan):
    """Each class with its code, its factors and the buckets of its bands."""
    for batch in batches:
        raws = batch.column(batch.schema.get_field_index("vec")).to_pylist()
        code: list = [None] * len(raws)
        factor: list = [None] * len(raws)
        keys: list = [None] * len(raws)
        sizes = np.array([len(r) // 8 for r in raws])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            signs, factors = plan.codes(_unit(np.stack([np.frombuffer(raws[i]) for i in at])))
            for i, s, f, k in zip(at, signs, factors, plan.keys(signs), strict=True):
                code[i], factor[i], keys[i] = np.packbits(s).tobytes(), f.tobytes(), k
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(code, pa.binary()),
             pa.array(factor, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=[*batch.schema.names, "dim", "code", "factor", "keys"])


class Estimates:
    """Vectors of one dimension ready to be compared: rotated, and as weighted codes."""

    def __init__(self, x, signs, factors, plan: Plan, bound: float = BOUND):
        d, k = x.shape[1], factors.shape[1]
        self.x, self.threshold = x, plan.threshold
        self.turned = np.einsum("nd,kde->nke", x, plan.rotations(d)).reshape(len(x), -1).astype(np.float32)
        self.weight = (np.where(signs, 1.0, -1.0) / (math.sqrt(d) * k * factors[:, :, None])).reshape(
            len(x), -1).astype(np.float32)
        spread = np.maximum(1 - factors ** 2, 0) / factors ** 2 / max(1, d - 1)
        self.error = bound * np.sqrt(spread.sum(axis=1)) / k + 1e-5

    def near_pairs(self, left, right):
        """Pairs of ``left`` and ``right`` whose cosine reaches the threshold, and how many were exact."""
        estimate = self.turned[left] @ self.weight[right].T
        i, j = np.nonzero(estimate + self.error[right][None, :] >= self.threshold)
        a, b = left[i], right[j]
        near = np.zeros(len(a), bool)
        for s in range(0, len(a), 65536):
            near[s:s + 65536] = np.einsum("nd,nd->n", self.x[a[s:s + 65536]], self.x[b[s:s + 65536]]) >= self.threshold
        return a[near], b[near], len(i)


def _bucket_links(est: Estimates, keys, band, left, right, links, peer, times):
    """Adds the links between (or, if they are the same, among) rows of a bucket."""
    def root(i):
        while peer[i] != i:
            peer[i] = peer[peer[i]]
            i = peer[i]
        return i
    for s in range(0, len(left), 512):
        a, b, _ = est.near_pairs(left[s:s + 512], right)
        if left is right:
            a, b = a[a < b], b[a < b]
        for t in range(0, len(a), 65536):
            p, q = a[t:t + 65536], b[t:t + 65536]
            # An earlier band has counted the pairs that share a bucket there.
            new = ~(keys[p, :band] == keys[q, :band]).any(axis=1)
            p, q = p[new], q[new]
            np.add.at(links, p, times[q])
            np.add.at(links, q, times[p])
            for i, j in zip(p.tolist(), q.tolist(), strict=True):
                i, j = root(i), root(j)
                if i != j:
                    peer[max(i, j)] = min(i, j)


def _cell_links(table: pa.Table, plan: Plan) -> pa.Table:
    """Links of all buckets, or pairs of blocks of buckets, in a cell.

    A row counts in one bucket; its links and a forest of them are returned.
    """
    ids, times, side, dims, bands, lo, hi, label, key = (
        table[c].to_numpy() for c in ("id", "times", "b", "dim", "band", "lo", "hi", "label", "key"))
    vecs, codes, factors = (table[c].to_pylist() for c in ("vec", "code", "factor"))
    n = len(ids)
    links, peer = np.zeros(n, np.int64), np.arange(n)
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        rows = rows[np.lexsort((hi[rows], lo[rows], key[rows], label[rows], bands[rows]))]
        x = _unit(np.frombuffer(b"".join(vecs[i] for i in rows)).reshape(len(rows), d))
        f = np.frombuffer(b"".join(factors[i] for i in rows)).reshape(len(rows), -1)
        packed = np.frombuffer(b"".join(codes[i] for i in rows), np.uint8).reshape(len(rows), -1)
        signs = np.unpackbits(packed, axis=1, count=f.shape[1] * d).reshape(len(rows), -1, d).astype(bool)
        est, keys = Estimates(x, signs, f, plan), plan.keys(signs)
        change = np.zeros(len(rows), bool)
        for col in (hi, lo, key, label, bands):
            change[1:] |= col[rows][1:] != col[rows][:-1]
        starts = np.concatenate(([0], np.flatnonzero(change)))
        mine, forest_of = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for s, e in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            at = np.arange(s, e)
            first, last = lo[rows[s]], hi[rows[s]]
            if first == last:
                left = right = at
            else:
                left, right = at[side[rows[s:e]] == first], at[side[rows[s:e]] == last]
            _bucket_links(est, keys, int(bands[rows[s]]), left, right, mine, forest_of, times[rows])
        links[rows] = mine
        peer[rows] = rows[forest_of]
    got = np.flatnonzero(links)
    ends = got.copy()
    while (peer[ends] != ends).any():
        ends = peer[ends]
    return pa.table({"sig": table["sig"].take(pa.array(got)), "id": ids[got], "links": links[got], "peer": ids[ends]})


def vector_links(vectors: DataFrame, *, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
                 threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Rows link if their labels are equal and their cosine is at least ``threshold``
    (every link found is exact; ``miss`` bounds the share of pairs at the threshold
    that are not looked at).  n_links counts the other rows linked directly,
    component_id is the least id reachable and kept tells whether it is the row's.
    A null label or a vector that is null, empty, zero or holds null or non-finite
    components links with nothing, and so do vectors of different sizes.  Rows
    with equal label and vector are linked.  A null id links nothing and has a
    null component_id and kept.  Rows that repeat an id count each and share a
    component.  Other columns are not read; no rows give no rows.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                          F.col(vector).cast("array<double>").alias("vec"))
    sigs = rows.mapInArrow(_signature_rows, "id bigint, label bigint, sig binary, vec binary").checkpoint()
    classes = (sigs.where("sig is not null and id is not null").groupBy("sig")
               .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("label").alias("label"),
                    F.first("vec").alias("vec")))
    n = vectors.count()
    plan = Plan(n, threshold, miss)
    coded = classes.mapInArrow(
        lambda it: _code_rows(it, plan),
        "sig binary, id bigint, times bigint, label bigint, vec binary, dim int, code binary, factor binary, "
        "keys array<bigint>").checkpoint()
    bucket = ["label", "dim", "band", "key"]
    members = coded.select("id", "sig", "label", "dim", F.posexplode("keys").alias("band", "key"))
    shared = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        *bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    dealt = (members.join(shared, bucket).withColumn("b", F.pmod(F.xxhash64("sig"), F.col("nb")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("sig", "band", "key", "b", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi")))
    # Buckets are small; a cell holds about CELL_ROWS rows of whole buckets.
    cell = F.pmod(F.xxhash64(*bucket, "lo", "hi"), F.lit(max(1, math.ceil(n * plan.bands / CELL_ROWS))))
    found = (coded.select("sig", "id", "times", "label", "dim", "vec", "code", "factor").join(dealt, "sig")
             .withColumn("cell", cell).groupBy("cell").applyInArrow(lambda t: _cell_links(t, plan),
                                                        "sig binary, id bigint, links bigint, peer bigint").checkpoint())
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("id").alias("src"), F.col("peer").alias("dst")))
    about = (coded.select("sig", F.col("id").alias("rep"), "times")
             .join(links, "sig", "left")
             .join(comps, F.col("rep") == comps["node"], "left")
             .select("sig", "rep", "times", "links", F.coalesce("component", "rep").alias("component")))
    out = sigs.select("id", "sig").join(about, "sig", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(vec_id),
                      F.when(F.col("id").isNull(), F.lit(0).cast("long"))
                      .otherwise(F.coalesce("links", F.lit(0)) + F.coalesce(F.col("times") - 1, F.lit(0))).alias("n_links"),
                      component.alias("component_id"), (component == F.col("id")).alias("kept"))
