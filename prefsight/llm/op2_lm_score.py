"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of all training n-grams are quantised on a geometric scale.  An n-gram of
level q is put into the filter as the events (n-gram, 1) ... (n-gram, q); a reader
probes for one event after the other and the last hit gives the count, so common
n-grams cost most events and there are no pointers or keys to store.  The filter
is built in segments, one per (order, bucket of the history), by the tasks that
sum the counts, and is broadcast to the workers that score texts.

A probability mixes the orders, with one sighting of each n-gram taken off:
``P(w|h) = a(h) (c(h w) - 1)/d(h) + (1 - a(h)) P(w|h')``, where ``d(h)`` is the sum
of ``c(h w) - 1`` over the words seen after h.  So the weights after a history sum
to one, and an n-gram seen once has none of its own, at every size of the corpus:
the filter holds ``c - 1`` of the others, and ``d(h)`` of their histories, all from
probes.  ``a`` depends on the level of d(h): the share ``sum (c - 1) / sum c`` over
all training tokens that follow such histories.  The lowest order is the count plus
one over tokens plus types plus one.

The filter has ``bits_per_event`` for each event and grows with the corpus.  One of
at most ``max_filter_bytes`` is broadcast.  A larger one stays a table of segments:
the distinct n-grams of each chunk of texts go to the task that has their segments
(shards of neighbouring buckets) as the gaps of their sorted codes, their levels come
back to the chunk, and the same probabilities are mixed from them.  This goes in rounds
of chunks, and the shuffles of each finished step are removed, so that the disk holds
those of one at a time.

False hits are lowered by sub-sequence bounds: an n-gram's level is at most that of its
last n - 1 words, a history's at most that of the history as an n-gram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefsight.llm import kernels as K
from prefsight.session import checkpointed, ensure_checkpoint_dir

MAX_ORDER = 3
BITS_PER_EVENT = 12
#: The largest filter that is broadcast; a larger one is joined by shard.
MAX_FILTER_BYTES = 16 << 20
#: Bytes of texts whose distinct n-grams are looked up together in a joined filter.
LOOKUP_BYTES = 4 << 20
#: N-grams of chunks that a task probes at once in the segments of a shard.
ASKED = 2_000_000
#: A joined filter is asked in so many rounds of chunks, so that the disk holds the n-grams of one at a time.
ROUNDS = 4
#: The least level in the filter, of words and of longer n-grams: all (discounted) counts.
LEAST_WORD, LEAST_NGRAM = 1, 1
#: A token of at least 1 / HEAVY of all training tokens is broadcast: at most HEAVY tokens.
HEAVY = 500_000
#: Distinct n-grams of all orders a task gathers before it sends its sums on.
FLUSH = 3_000_000
TOKENS_PER_BUCKET = 500_000

#: Least count of each level: 1, 2, 3, 4, 6, 8, 12, 16, 23, ... (steps of sqrt 2).
LEVELS = np.unique(np.ceil(2 ** (np.arange(0, 90) / 2) - 1e-9).astype(np.int64))
#: The middle of each level; 0 for level 0.
ESTIMATE = np.concatenate(([0.0], (LEVELS + np.append(LEVELS[1:] - 1, LEVELS[-1])) / 2))

END = np.uint64(0x0E4D0E4D0E4D0E4D)
START = np.uint64(0x57A2757A2757A275)
#: Bits of an n-gram's code in its bucket's segment; two share one far less often than a probe errs.
CODE_BITS = 32


def probes_of(bits_per_event: int) -> int:
    """Probes of an event that err least often: ln 2 for each of its bits."""
    return max(1, round(bits_per_event * math.log(2)))


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


# --- tokens -----------------------------------------------------------------

def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each ended by END, and each text's bounds."""
    hashes, bounds = K.word_hashes(texts, K.SPACE_WORDS)
    return np.insert(hashes, bounds[1:], END), bounds + np.arange(len(bounds))


def histories(tokens: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """The word before each token, the one before that, ...: START before a text."""
    out, before = [], tokens
    first = np.zeros(len(tokens), bool)
    first[bounds[:-1]] = True
    for _ in range(order - 1):
        before = np.concatenate(([START], before[:-1]))
        before[first] = START
        out.append(before)
    return out


def _history_hash(words: list[np.ndarray]) -> np.ndarray:
    total = np.full(len(words[0]), len(words), np.uint64)
    for j, w in enumerate(words):
        total += w * K._PLACE[j]
    return K.mix(total)


def _code(key: np.ndarray) -> np.ndarray:
    """What the segment of a bucket knows of a key."""
    return K.mix(key ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(64 - CODE_BITS)


def _joint(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for the bucket and the code of a key, in order of the buckets."""
    return (bucket.astype(np.uint64) << np.uint64(CODE_BITS)) | _code(key)


def _parted(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and code of each ``_joint``."""
    return (joint >> np.uint64(CODE_BITS)).astype(np.int64), joint & np.uint64((1 << CODE_BITS) - 1)


def ngram_keys(history: list[np.ndarray], tokens: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, key): the bucket and half of the 48-bit key come from the history."""
    if not history:
        return (K.mix(tokens) % np.uint64(n_buckets)).astype(np.int64), tokens
    h = _history_hash(history)
    key = ((h >> np.uint64(40)) << np.uint64(24)) | (tokens >> np.uint64(40))
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(n_buckets)).astype(np.int64), key


def _history_key(history: np.ndarray) -> np.ndarray:
    """Key of a history itself, from the upper half of its n-grams' keys."""
    return K.mix((history << np.uint64(8)) | np.uint64(0xA5)) >> np.uint64(16)


# --- sums -------------------------------------------------------------------

def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Gather:
    """Sums of a task, handed on when ``limit`` distinct keys are held."""

    def __init__(self, limit: int = FLUSH):
        self.parts, self.held, self.limit = [], 0, limit

    def add(self, keys: np.ndarray):
        u, c = np.unique(keys, return_counts=True)
        self.parts.append((u, c.astype(np.int64)))
        self.held += len(u)
        if self.held > 2 * self.limit:
            self.parts = [_summed(self.parts)]
            self.held = len(self.parts[0][0])
            if self.held > self.limit:
                return self.take()
        return None

    def take(self):
        out = _summed(self.parts) if self.parts else None
        self.parts, self.held = [], 0
        return out


def _unigram_rows(batches: Iterator[pa.RecordBatch]):
    gather = _Gather()

    def batch_of(sums):
        return pa.RecordBatch.from_arrays([pa.array(sums[0].view(np.int64)), pa.array(sums[1])], names=["h", "c"])
    for _, texts in K.text_chunks(batches):
        if full := gather.add(tokens_of(texts)[0]):
            yield batch_of(full)
    if rest := gather.take():
        yield batch_of(rest)


def _planes(keys: np.ndarray) -> bytes:
    """48-bit keys, sorted, as three planes of 16 bits: the upper ones compress."""
    return b"".join(((keys >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for s in (32, 16, 0))


def _from_planes(raw: bytes) -> np.ndarray:
    p = np.frombuffer(raw, np.uint16).reshape(3, -1).astype(np.uint64)
    return (p[0] << np.uint64(32)) | (p[1] << np.uint64(16)) | p[2]


def _ngram_rows(batches, max_order: int, n_buckets: int):
    gathers = {n: _Gather(FLUSH // (max_order - 1)) for n in range(2, max_order + 1)}

    def batch_of(order, sums):
        keys, counts = sums
        bucket = (keys >> np.uint64(48)).astype(np.int64)
        used, first = np.unique(bucket, return_index=True)
        ends = np.append(first[1:], len(keys))
        low = keys & np.uint64((1 << 48) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(used), order, np.int32)), pa.array(used.astype(np.int32)),
             pa.array([_planes(low[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()),
             pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())],
            names=["order", "bucket", "keys", "counts"])
    for _, texts in K.text_chunks(batches):
        tokens, bounds = tokens_of(texts)
        before = histories(tokens, bounds, max_order)
        for n, gather in gathers.items():
            bucket, key = ngram_keys(before[:n - 1], tokens, n_buckets)
            if full := gather.add((bucket.astype(np.uint64) << np.uint64(48)) | key):
                yield batch_of(n, full)
    for n, gather in gathers.items():
        if rest := gather.take():
            yield batch_of(n, rest)


def _bucket_sums(table: pa.Table, bits_per_event: int) -> pa.Table:
    """Filter segment of one bucket, and sums by level.

    ``cells`` has, for each level of the history's discounted sum, the number of
    types and of tokens; all continuations of a history are in its bucket.
    """
    keys, counts = _summed([(_from_planes(k), np.frombuffer(c, np.uint32).astype(np.int64))
                            for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True)])
    history = keys >> np.uint64(24)
    first = np.flatnonzero(np.concatenate(([True], history[1:] != history[:-1])))
    types, tokens = np.diff(np.append(first, len(keys))), np.add.reduceat(counts, first)
    left = tokens - types
    used, at = np.unique(level_of(left), return_inverse=True)
    types, tokens = (np.bincount(at, weights=x).astype(np.int64) for x in (types, tokens))
    size, raw = segment(np.concatenate((keys, _history_key(history[first]))), np.concatenate((counts - 1, left)),
                        LEAST_NGRAM, bits_per_event)
    return pa.table({
        "order": table["order"][:1], "bucket": table["bucket"][:1],
        "size": pa.array([size], pa.int64()), "bits": pa.array([raw], pa.binary()),
        "cells": pa.array([np.stack([used, types, tokens]).astype(np.int64).tobytes()], pa.binary())})


def _cell_rows(batches):
    for batch in batches:
        for order, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            used, types, tokens = np.frombuffer(raw, np.int64).reshape(3, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), order, np.int32)), pa.array(used), pa.array(types), pa.array(tokens)],
                names=["order", "hl", "types", "tokens"])


# --- the filter -------------------------------------------------------------

def _event_hashes(keys: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the places of all probes of the events (key, level) come from."""
    a = K.mix(keys ^ (level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return a, (a >> np.uint64(17)) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)


def _place(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Place in a segment of ``size`` bits; ``a`` grows by the second hash from probe to probe."""
    return (((a >> np.uint64(32)) * size) >> np.uint64(32)).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray, least: int, bits_per_event: int) -> tuple[int, bytes]:
    """Filter bits of one bucket; levels ``least`` ... q of each n-gram are put in."""
    q = level_of(counts)
    kept = q >= least
    keys, q = _code(keys[kept]), q[kept]
    fan = q - least + 1
    events = int(fan.sum())
    size = max(64, -(-events * bits_per_event // 8) * 8)
    bits = np.zeros(size, bool)
    level = np.arange(events) - np.repeat(np.cumsum(fan) - fan, fan) + least
    each = np.repeat(keys, fan)
    a, b = _event_hashes(each, level)
    for _ in range(probes_of(bits_per_event)):
        bits[_place(a, np.uint64(size))] = True
        a += b
    return size, np.packbits(bits, bitorder="little").tobytes()


class LogFrequencyFilter:
    """Quantised counts of n-grams, read by repeated membership probes."""

    def __init__(self, segments, n_buckets: int, least: dict[int, int], mix_in: dict[int, np.ndarray],
                 tokens: int, types: int, probes: int = probes_of(BITS_PER_EVENT)):
        """``segments`` are those of the whole corpus, of a shard, or none if levels are looked up elsewhere."""
        self.n_buckets, self.least, self.mix_in = n_buckets, least, mix_in
        self.tokens, self.types, self.probes = tokens, types, probes
        self.size = {n: np.full(n_buckets, 64, np.int64) for n in least}
        self.offset = {n: np.zeros(n_buckets, np.int64) for n in least}
        parts, at = [bytes(8)], 8
        for order, bucket, size, raw in segments:
            self.size[order][bucket], self.offset[order][bucket] = size, at * 8
            parts.append(raw)
            at += len(raw)
        self.bits = np.frombuffer(b"".join(parts), np.uint8)

    def __len__(self) -> int:
        return len(self.bits)

    def _has(self, order: int, bucket: np.ndarray, key: np.ndarray, level: int) -> np.ndarray:
        a, b = _event_hashes(key, np.array([level]))
        size, offset = self.size[order][bucket].astype(np.uint64), self.offset[order][bucket]
        ok = np.arange(len(key))
        for _ in range(self.probes):
            at = offset + _place(a, size)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            ok, a, b, size, offset = ok[hit], a[hit], b[hit], size[hit], offset[hit]
            a += b
        return ok

    def levels_of(self, order: int, joint: np.ndarray) -> np.ndarray:
        """Level of the count of each n-gram given by bucket and code, 0 if the filter does not have it."""
        out = np.zeros(len(joint), np.int64)
        alive = np.arange(len(joint))
        bucket, code = _parted(joint)
        level = self.least[order]
        while len(alive) and level <= len(LEVELS):
            alive = alive[self._has(order, bucket[alive], code[alive], level)]
            out[alive] = level
            level += 1
        return out

    def levels(self, history: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
        """Levels of the ``_probes``, 0 where the filter does not have them."""
        joint, back = _probes(history, tokens, self.n_buckets)
        return self.levels_of(len(history) + 1, joint)[back]

    def log10_probability(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 of the smoothed probability of each token given those before it."""
        max_order = max(self.least)
        before = histories(tokens, bounds, max_order)
        return self.mixed({n: self.levels(before[:n - 1], tokens) for n in range(1, max_order + 1)}, bounds)

    def mixed(self, found: dict[int, np.ndarray], bounds: np.ndarray) -> np.ndarray:
        """log10 of the probabilities, from the levels of the ``_probes`` of each order.

        No n-gram is more frequent than its last words, and the discounted sum of a history
        no larger than its own count; hits beyond these are false ones and are lowered."""
        shorter = found[1]
        p = (ESTIMATE[shorter] + 1) / (self.tokens + self.types + 1)
        for n in range(2, max(self.least) + 1):
            seen, history = found[n].reshape(2, -1)
            own = np.concatenate(([0], shorter[:-1]))  # level of the history itself
            own[bounds[:-1]] = len(LEVELS)  # START is not counted
            history, seen = np.minimum(history, own), np.minimum(seen, shorter)
            shorter = seen
            share = self.mix_in[n][history]  # 0 of a history without repeats
            ratio = np.minimum(1.0, ESTIMATE[seen] / np.maximum(ESTIMATE[history], 1.0))
            p = share * ratio + (1 - share) * p
        return np.log10(p)


def _mixing_shares(cells, least: dict[int, int]) -> dict[int, np.ndarray]:
    """Weight of each order above one, by the level of the history's discounted sum."""
    mix_in = {}
    for n in least:
        if n == 1:
            continue
        seen, total = np.zeros(len(LEVELS) + 1), np.zeros(len(LEVELS) + 1)
        for r in cells:
            if r["order"] == n:
                total[r["hl"]] += r["tokens"]
                seen[r["hl"]] += r["tokens"] - r["types"]
        mix_in[n] = np.minimum(0.99, seen / np.maximum(total, 1))
    return mix_in


def _unigram_segment(table: pa.Table, least: int, bits_per_event: int) -> pa.Table:
    keys = table["h"].to_numpy().view(np.uint64)
    size, raw = segment(keys, table["c"].to_numpy(), least, bits_per_event)
    return pa.table({"order": pa.array([1], pa.int32()), "bucket": table["bucket"][:1].cast(pa.int32()),
                     "size": pa.array([size], pa.int64()), "bits": pa.array([raw], pa.binary())})


def _with_bucket(batches, n_buckets: int):
    for b in batches:
        h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        bucket = (K.mix(h) % np.uint64(n_buckets)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bucket)], names=["h", "c", "bucket"])


class Counts:
    """Training counts: ``unigrams`` (h, c), totals and the filter.

    ``segments`` is None if the filter is whole, else the table it stays in."""

    def __init__(self, texts: DataFrame, max_order: int = MAX_ORDER, bits_per_event: int = BITS_PER_EVENT,
                 max_filter_bytes: int = MAX_FILTER_BYTES):
        texts = texts.select("text")
        self.unigrams = (texts.mapInArrow(_unigram_rows, "h bigint, c bigint")
                         .groupBy("h").agg(F.sum("c").alias("c")))
        self.unigrams = checkpointed(self.unigrams)
        total = self.unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.types = total["n"], total["v"]
        nb = self.n_buckets = min(65536, max(16, math.ceil(self.tokens / TOKENS_PER_BUCKET)))

        sums = checkpointed(
            texts.mapInArrow(lambda it: _ngram_rows(it, max_order, nb), "order int, bucket int, keys binary, counts binary")
            .groupBy("order", "bucket")
            .applyInArrow(lambda t: _bucket_sums(t, bits_per_event),
                          "order int, bucket int, size bigint, bits binary, cells binary"))
        cells = (sums.select("order", "cells")
                 .mapInArrow(_cell_rows, "order int, hl bigint, types bigint, tokens bigint")
                 .groupBy("order", "hl").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"))
                 .collect())  # at most one row a level and order
        by_count = F.lit(0)
        for least in LEVELS:
            by_count = by_count + (F.col("c") >= int(least)).cast("int")
        words = self.unigrams.agg(F.coalesce(F.sum(by_count), F.lit(0)).alias("events")).first()["events"]
        least = {1: LEAST_WORD} | {n: LEAST_NGRAM for n in range(2, max_order + 1)}

        unigram_segments = (
            self.unigrams.mapInArrow(lambda it: _with_bucket(it, nb), "h bigint, c bigint, bucket bigint")
            .groupBy("bucket")
            .applyInArrow(lambda t: _unigram_segment(t, LEAST_WORD, bits_per_event),
                          "order int, bucket int, size bigint, bits binary"))
        segments = checkpointed(unigram_segments).union(sums.select("order", "bucket", "size", "bits"))
        size = sums.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)).alias("b")).first()["b"]
        whole = size + words * bits_per_event // 8 <= max_filter_bytes
        rows = [tuple(r) for r in segments.collect()] if whole else []  # at most max_filter_bytes
        self.filter = LogFrequencyFilter(rows, nb, least, _mixing_shares(cells, least), self.tokens, self.types,
                                         probes_of(bits_per_event))
        self.segments = None if whole else segments


# --- a filter that is joined --------------------------------------------------

def _shard_size(n_buckets: int) -> int:
    """Buckets of a shard: at most 64, so that gaps take five bytes and segments a few MB."""
    return min(64, max(1, n_buckets // 256))


def _pack(texts: list[bytes]) -> tuple[int, bytes]:
    raw = np.array([len(texts), *map(len, texts)], np.int64).tobytes() + b"".join(texts)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(size: int, packed: bytes) -> list[bytes]:
    raw = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int64, n, 8))))
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _probes(history: list[np.ndarray], tokens: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``_joint`` of the distinct n-grams and, of longer ones, histories; the place of each
    token's n-gram and then of each token's history."""
    if history:
        bucket, key = ngram_keys(history, tokens, n_buckets)
        grams, back = np.unique((bucket.astype(np.uint64) << np.uint64(48)) | key, return_inverse=True)
        bucket, key = grams >> np.uint64(48), grams & np.uint64((1 << 48) - 1)
        new = np.concatenate(([True], grams[1:] >> np.uint64(24) != grams[:-1] >> np.uint64(24)))[:len(grams)]
        joint = np.concatenate((_joint(bucket, key), _joint(bucket[new], _history_key(key[new] >> np.uint64(24)))))
        back = np.concatenate((back, (len(grams) + np.cumsum(new) - 1)[back]))
    else:
        words, back = np.unique(tokens, return_inverse=True)
        joint = _joint(*ngram_keys([], words, n_buckets))
    order = np.argsort(joint)
    place = np.empty(len(joint), np.int64)
    place[order] = np.arange(len(joint))
    return joint[order], place[back]


def _packed_gaps(joint: np.ndarray, start: int) -> bytes:
    """Sorted numbers of a shard as the gaps between them, byte by byte: the upper bytes compress."""
    gaps = np.diff(joint, prepend=np.uint64(start))
    return pa.compress(gaps.view(np.uint8).reshape(-1, 8).T[:5].tobytes(), codec="zstd", asbytes=True)


def _from_gaps(n: int, packed: bytes, start: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    raw = pa.decompress(packed, decompressed_size=5 * n, codec="zstd", asbytes=True)
    planes[:, :5] = np.frombuffer(raw, np.uint8).reshape(5, n).T
    return np.cumsum(planes.view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(start)


def _shard_start(shard: int, n_buckets: int) -> int:
    return (shard * _shard_size(n_buckets)) << CODE_BITS


def _probe_rows(batches, max_order: int, n_buckets: int):
    for batch in batches:
        for chunk, size, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            tokens, bounds = tokens_of(_unpack(size, packed))
            before = histories(tokens, bounds, max_order)
            for n in range(1, max_order + 1):
                joint, _ = _probes(before[:n - 1], tokens, n_buckets)
                used, first = np.unique(_parted(joint)[0] // _shard_size(n_buckets), return_index=True)
                ends = np.append(first[1:], len(joint))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), chunk, np.int64)),
                     pa.array(np.full(len(used), n, np.int32)), pa.nulls(len(used), pa.int32()),
                     pa.array(ends - first, pa.int64()),
                     pa.array([_packed_gaps(joint[a:b], _shard_start(int(shard), n_buckets))
                               for shard, a, b in zip(used, first, ends, strict=True)], pa.binary())],
                    names=["shard", "chunk", "order", "bucket", "size", "data"])


def _answer_rows(batches, lm: LogFrequencyFilter):
    """Levels of the n-grams asked for; rows are sorted, a shard's segments (chunk -1) come first.

    Up to ``ASKED`` n-grams of a shard are gathered, and one that many chunks ask for is probed once."""
    at, segments, part, asked, held = None, [], None, {}, 0

    def answers():
        out = []
        for n, parts in asked.items():
            joint, back = np.unique(np.concatenate([j for _, j in parts]), return_inverse=True)
            found, a = part.levels_of(n, joint).astype(np.uint8)[back], 0
            for chunk, j in parts:
                out.append((chunk, n, at, len(j), pa.compress(found[a:a + len(j)].tobytes(), codec="zstd", asbytes=True)))
                a += len(j)
        asked.clear()
        chunks, orders, shards, sizes, found = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(chunks, pa.int64()), pa.array(orders, pa.int32()), pa.array(shards, pa.int32()),
             pa.array(sizes, pa.int64()), pa.array(found, pa.binary())],
            names=["chunk", "order", "shard", "size", "data"])
    for batch in batches:
        for shard, chunk, n, bucket, size, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if shard != at or held > ASKED:
                if asked:
                    yield answers()
                held = 0
            if shard != at:
                at, segments, part = shard, [], None
            if chunk < 0:
                segments.append((n, bucket, size, data))
                continue
            if part is None:
                part = LogFrequencyFilter(segments, lm.n_buckets, lm.least, {}, 0, 0, lm.probes)
                segments = []
            asked.setdefault(n, []).append((chunk, _from_gaps(size, data, _shard_start(shard, lm.n_buckets))))
            held += size
    if asked:
        yield answers()


def _looked_up_rows(batches, lm: LogFrequencyFilter):
    """Scores of the texts of each chunk; its texts (order 0) come first, then levels by order and shard."""
    at, texts, found = None, [], {}

    def scores():
        tokens, bounds = tokens_of(texts)
        before = histories(tokens, bounds, max(lm.least))
        levels = {}
        for n in lm.least:
            place = _probes(before[:n - 1], tokens, lm.n_buckets)[1]
            levels[n] = np.frombuffer(b"".join(found[n]), np.uint8).astype(np.int64)[place]
        score = np.add.reduceat(lm.mixed(levels, bounds), bounds[:-1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), at, np.int64)),
                                           pa.array(np.arange(len(texts), dtype=np.int32)), pa.array(score)],
                                          names=["__chunk", "__at", "score"])
    for batch in batches:
        for chunk, n, _, size, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if n == 0:
                if at is not None:
                    yield scores()
                at, texts, found = chunk, _unpack(size, data), {k: [] for k in lm.least}
            else:
                found[n].append(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True))
    if at is not None:
        yield scores()


def _all_looked_up(chunks: DataFrame, counts: Counts, lm) -> DataFrame:
    """(__chunk, __at, score) of the texts of all ``chunks``, in rounds whose shuffles go before the next."""
    turn = F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS))
    parts = [checkpointed(_looked_up(chunks.where(turn == i), counts, lm)) for i in range(ROUNDS)]
    return reduce(DataFrame.union, parts)


def _looked_up(chunks: DataFrame, counts: Counts, lm) -> DataFrame:
    """(__chunk, __at, score) of the texts of ``chunks`` (chunk, size, data), from the segments."""
    nb, max_order = counts.n_buckets, max(counts.filter.least)
    probes = chunks.mapInArrow(lambda it: _probe_rows(it, max_order, nb),
                               "shard int, chunk bigint, order int, bucket int, size bigint, data binary")
    segments = counts.segments.select(
        F.floor(F.col("bucket") / _shard_size(nb)).cast("int").alias("shard"), F.lit(-1).cast("long").alias("chunk"),
        "order", "bucket", "size", F.col("bits").alias("data"))
    answers = (segments.union(probes).repartition("shard").sortWithinPartitions("shard", "chunk")
               .mapInArrow(lambda it: _answer_rows(it, lm.value[0]),
                           "chunk bigint, order int, shard int, size bigint, data binary"))
    texts = chunks.select("chunk", F.lit(0).alias("order"), F.lit(-1).alias("shard"), "size", "data")
    return (texts.union(answers).repartition("chunk").sortWithinPartitions("chunk", "order", "shard")
            .mapInArrow(lambda it: _looked_up_rows(it, lm.value[0]), "__chunk bigint, __at int, score double"))


# --- scoring ----------------------------------------------------------------

def _score_rows(batches, lm: LogFrequencyFilter, heavy: np.ndarray, heavy_count: np.ndarray, n_keep: int, whole: bool):
    """Rows with scores; if the filter is joined, chunks with their texts packed in the first row instead."""
    bitmap = K.member_bitmap(heavy)
    chunk = (0 if whole else TaskContext.get().partitionId()) << 32
    for batch, texts in K.text_chunks(batches, "__text", K.CHUNK_BYTES if whole else LOOKUP_BYTES):
        tokens, bounds = tokens_of(texts)
        n = np.diff(bounds)
        if whole:
            score = [pa.array(np.add.reduceat(lm.log10_probability(tokens, bounds), bounds[:-1]))]
        else:
            size, packed = _pack(texts)
            rest = [None] * (len(texts) - 1)
            score = [pa.array(np.full(len(texts), chunk, np.int64)), pa.array(np.arange(len(texts), dtype=np.int32)),
                     pa.array([size, *rest], pa.int64()), pa.array([packed, *rest], pa.binary())]
            chunk += 1
        pos, at = K.member(tokens, heavy, bitmap)
        common = np.zeros(len(tokens))
        common[pos] = np.log10(heavy_count[at] + 1.0)
        known = np.zeros(len(tokens), np.int64)
        known[pos] = 1
        rare, times = [], []
        for i in range(len(texts)):
            a, b = bounds[i], bounds[i + 1]
            u, c = np.unique(tokens[a:b][known[a:b] == 0], return_counts=True)
            rare.append(u.view(np.int64))
            times.append(c.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(n_keep)), pa.array(n.astype(np.int64)), *score,
             pa.array(np.add.reduceat(common, bounds[:-1])), pa.array(np.add.reduceat(known, bounds[:-1])),
             pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
            names=[*batch.schema.names[:n_keep], "n_tokens", *(_SCORE if whole else _CHUNK), "__sum", "__known", "__rare", "__times"])


_SCORE = {"score": "double"}
_CHUNK = {"__chunk": "bigint", "__at": "int", "__size": "bigint", "__packed": "binary"}
_ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def lm_scores(docs: DataFrame, train: Column, *, keep: list[str], text: str = "text",
              max_order: int = MAX_ORDER, bits_per_event: int = BITS_PER_EVENT,
              max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``keep`` columns of every row with its model score, learnt where ``train`` holds.

    Adds n_tokens (words that ASCII white space separates, A-Z lower-cased, then
    one end), n_known (tokens that occur in training), train_tokens, base_score
    (sum of log10((c + 1) / (N + V + 1)) from exact counts) and score (log10
    probability of the text by the filter's model).

    A null text is an empty one: its end is scored.  Rows whose ``train`` is null
    are not learnt from.  Repeated rows count and are returned each time.  With no
    training rows every token has probability 1 / (0 + 0 + 1).  No rows give no
    rows.  Other columns are not read; result columns replace columns of ``keep``
    with their names.  A filter of over ``max_filter_bytes`` is not broadcast but
    joined with the n-grams of the texts; the scores are the same.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    K.small_batches(spark)
    keep = [c for c in keep if c not in _ADDED]
    body = F.col(text).cast("string")
    counts = Counts(docs.where(train).select(body.alias("text")), max_order, bits_per_event, max_filter_bytes)
    frequent = (counts.unigrams.where(F.col("c") * HEAVY >= counts.tokens).toArrow()  # at most HEAVY rows
                if counts.tokens else pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64())}))
    h, c = frequent["h"].to_numpy().view(np.uint64), frequent["c"].to_numpy()
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((counts.filter, h[order], c[order]))

    whole = counts.segments is None
    rows = docs.select(*keep, body.alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]),
                        "n_tokens bigint", *(f"{k} {t}" for k, t in (_SCORE if whole else _CHUNK).items()),
                        "__sum double, __known bigint",
                        "__rare array<bigint>, __times array<int>"])
    scored = (rows.mapInArrow(lambda it: _score_rows(it, *shared.value, len(keep), whole), schema)
              .withColumn("__row", F.monotonically_increasing_id()).checkpoint())
    rare = (scored.select("__row", F.explode(F.arrays_zip("__rare", "__times")).alias("t"))
            .select("__row", F.col("t.__rare").alias("h"), F.col("t.__times").alias("times")))
    joined = rare.join(counts.unigrams.where(F.col("c") * HEAVY < counts.tokens), "h")
    sums = joined.groupBy("__row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("__more"),
                                       F.sum("times").alias("__also"))
    out = scored.drop("__rare", "__times").join(sums if whole else checkpointed(sums), "__row", "left")
    if not whole:
        chunks = scored.where("__packed is not null").select(
            F.col("__chunk").alias("chunk"), F.col("__size").alias("size"), F.col("__packed").alias("data"))
        out = out.drop("__size", "__packed").join(_all_looked_up(chunks, counts, shared), ["__chunk", "__at"])
    floor = math.log10(counts.tokens + counts.types + 1)
    return out.select(
        *keep, "n_tokens", (F.col("__known") + F.coalesce("__also", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("__sum") + F.coalesce("__more", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        "score")
