"""Numpy kernels over whole texts, used inside Spark tasks.

Texts are processed in chunks of about a megabyte, so the memory of a task does
not depend on the batch size Spark chooses; one longer text is a chunk of its
own.  A word is identified by a 64-bit hash of its bytes: a sum of one random
number per byte value times a power of an odd constant, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1000
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: ASCII white space 0x20 and 0x09-0x0D separates; everything else is a word.
SPACE_WORDS = "space"
#: Words are runs of 0-9, a-z (after lower-casing A-Z) and every byte from 0x80.
ALNUM_WORDS = "alnum"
#: As SPACE_WORDS, but A-Z stay as they are.
EXACT_WORDS = "exact"
#: As SPACE_WORDS, and the bytes .,;:!? separate too.
PIECE_WORDS = "piece"


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keyed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed permutation of 64-bit values."""
    return mix(x ^ np.uint64((key * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _M64))


def _lower(codes: np.ndarray) -> np.ndarray:
    out = codes.copy()
    out[65:91] += 32
    return out


_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
#: The value a byte adds: that of its lower-case form.
_VALUE = _RANDOM[_lower(np.arange(256))]
_IS_WORD = {SPACE_WORDS: np.ones(256, bool), ALNUM_WORDS: np.zeros(256, bool)}
_IS_WORD[SPACE_WORDS][[9, 10, 11, 12, 13, 32]] = False
_IS_WORD[EXACT_WORDS] = _IS_WORD[SPACE_WORDS]
_IS_WORD[PIECE_WORDS] = _IS_WORD[SPACE_WORDS].copy()
_IS_WORD[PIECE_WORDS][list(b".,;:!?")] = False
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_WORD[ALNUM_WORDS][_a:_b] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; tables of long texts are not kept."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, CHUNK_BYTES * 5 // 4)

    def table(b: int) -> np.ndarray:
        t = np.full(size, b, np.uint64)
        t[0] = 1
        return np.multiply.accumulate(t)

    made = table(_BASE), table(_INVERSE)
    if size <= 4 * CHUNK_BYTES:
        _powers = made
    return made


def word_spans(texts: list[bytes], kind: str, prefixes: tuple[int, ...] = ()):
    """Words of all texts: ``(hashes, starts, sizes, prefix_hashes, buffer, offsets)``.

    ``buffer`` holds the texts, each followed by a line break, from ``offsets``;
    ``prefix_hashes[k]`` are the words of more than k bytes and the hashes of
    their first k bytes.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(buf)
    is_word = _IS_WORD[kind][buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if is_word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    value = _RANDOM if kind == EXACT_WORDS else _VALUE
    np.cumsum(value[buf] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    sizes = ends - starts
    beginnings = {}
    for k in prefixes:
        at = np.flatnonzero(sizes > k)
        beginnings[k] = at, mix((sums[starts[at] + k] - sums[starts[at]]) * inverse[starts[at]])
    return hashes, starts, sizes, beginnings, buf, offsets


def word_hashes(texts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and each text's bounds in that array.

    Returns ``(hashes, bounds)``; the words of text i are
    ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    hashes, starts, _, _, _, offsets = word_spans(texts, kind)
    return hashes, np.searchsorted(starts, offsets)


#: Independent odd multipliers of the places of a run of words.
_PLACE = mix(np.arange(0x5EED, 0x5EED + 64, dtype=np.uint64)) | np.uint64(1)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive hashes; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += hashes[j:j + n] * _PLACE[j]
    return mix(total)


def shingles_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Shingles of one text: runs of ``size`` words; the whole text if it has fewer."""
    if len(hashes) == 0:
        return hashes
    return rolling(hashes, min(size, len(hashes)))


def small_batches(spark) -> None:
    """Session setting for long texts: Arrow batches of at most BATCH_ROWS rows.

    A task and its Python worker then hold a few megabytes of text at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
                max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their whole texts as UTF-8; null becomes empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        texts = [t or b"" for t in col.cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > max_bytes:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t) + 1
        if start < len(texts):
            yield batch.slice(start), texts[start:]
    pa.default_memory_pool().release_unused()  # workers are reused by later stages


def member(values: np.ndarray, table: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``values`` that occur in the sorted ``table``, and where.

    ``bitmap`` (from ``member_bitmap``) turns most values away first.
    """
    maybe = np.flatnonzero(bitmap[(values & np.uint64(len(bitmap) - 1)).astype(np.int64)])
    if not len(maybe) or not len(table):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(table, values[maybe])
    at[at == len(table)] = 0
    ok = table[at] == values[maybe]
    return maybe[ok], at[ok]


def member_bitmap(table: np.ndarray) -> np.ndarray:
    bits = max(16, int(np.ceil(np.log2(max(1, len(table)) * 16))))
    bitmap = np.zeros(1 << bits, bool)
    bitmap[(table & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return bitmap
