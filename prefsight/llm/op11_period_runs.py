"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are equal), of at
least ``min_words`` words and ``min_repeats`` periods, that neither neighbour extends.

The dictionary names every factor of 1, 2, 4, ... words of a text: two factors have
one name exactly if they are equal, and a name of 2h words is the pair of the names
of its halves, so no hash is compared.  In a run of three periods a factor of
``size`` words, ``size / 2 < q <= size``, next occurs exactly q words later (a nearer
occurrence would make the period a power of a shorter one), and both occurrences lie
within twice the size.  These successors follow each other at distance q, an
arithmetic progression that proposes the period; stretches of equal distances are
extended to both sides and the distinct ones kept.  A factor that does not recur in
its text is dropped from all longer levels, so ordinary text costs a few sorts.

Each text is judged by itself: one map over the rows, nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prefsight.llm import kernels as K

MIN_WORDS = 24
MIN_REPEATS = 3


def text_words(text: bytes) -> list[bytes]:
    """Words that ASCII white space separates."""
    return text.split()


def _extend(words: np.ndarray, first: np.ndarray, last: np.ndarray, start, stop, period):
    """Move the bounds outwards while the neighbouring word keeps the period."""
    start, stop = start.copy(), stop.copy()
    while True:
        left = start > first
        left[left] = words[start[left] - 1] == words[start[left] - 1 + period[left]]
        right = stop < last
        right[right] = words[stop[right]] == words[stop[right] - period[right]]
        if not left.any() and not right.any():
            return start, stop
        start[left] -= 1
        stop[right] += 1


def find_runs(words: np.ndarray, begins: np.ndarray, ends: np.ndarray,
              min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period.

    ``words`` are the names of the words of several texts in a row, different texts
    sharing none; ``begins[i]`` and ``ends[i]`` bound the text of word i.  The
    successors prove periods of runs of at least three periods.
    """
    if min_repeats < 3:
        raise ValueError("runs of fewer than three periods are not proposed")
    n = len(words)
    found = [np.empty((0, 3), np.int64)]
    at, name, size = np.arange(n), words, 1
    while len(at):
        order = np.argsort(name, kind="stable")  # equal names stay in the order of their places
        place = at[order]
        again = np.zeros(len(order), bool)
        again[1:] = name[order][1:] == name[order][:-1]
        gap = np.diff(place)
        near = again[1:] & (gap <= size) & (2 * gap > size)
        p, d = place[:-1][near], gap[near]
        if len(p):
            by = np.argsort(p)
            p, d = p[by], d[by]
            cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(d) != 0)) + 1
            head, tail = np.concatenate(([0], cut)), np.concatenate((cut, [len(p)])) - 1
            start, stop = _extend(words, begins[p[head]], ends[p[head]], p[head], p[tail] + size + d[tail], d[head])
            found.append(np.stack((start, stop - start, d[head]), axis=1))
        # Names of twice the size, where both halves recur in the text.
        recurs = again.copy()
        recurs[:-1] |= again[1:]
        label = np.full(n, -1, np.int64)
        label[place[recurs]] = np.cumsum(~again)[recurs]
        at = np.flatnonzero(label >= 0)
        at = at[at + 2 * size <= ends[at]]
        at = at[label[at + size] >= 0]
        name = label[at] * (n + 1) + label[at + size]
        size *= 2
    runs = np.concatenate(found)
    runs = runs[(runs[:, 1] >= min_words) & (runs[:, 1] >= min_repeats * runs[:, 2])]
    return np.unique(runs[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _chunk_runs(texts: list[list[bytes]], min_words: int, min_repeats: int) -> list[np.ndarray]:
    """Runs of each text of a chunk, with starts counted in the text."""
    long = [i for i, w in enumerate(texts) if len(w) >= max(min_words, min_repeats)]
    sizes = np.array([len(texts[i]) for i in long], np.int64)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    words = np.empty(edges[-1], np.int64)
    seen = 0
    for k, i in enumerate(long):
        names: dict[bytes, int] = {}
        words[edges[k]:edges[k + 1]] = [names.setdefault(w, seen + len(names)) for w in texts[i]]
        seen += len(names)
    runs = find_runs(words, np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes), min_words, min_repeats)
    out = [runs[:0]] * len(texts)
    bounds = np.searchsorted(runs[:, 0], edges)
    for k, i in enumerate(long):
        out[i] = runs[bounds[k]:bounds[k + 1]] - np.array([edges[k], 0, 0])
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: least start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words but those of a run after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([w for w, k in zip(words, keep) if k])


_SCHEMA = ("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, n_runs bigint, "
           "start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
           "collapsed_sha256 string")


def period_runs(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None,
                min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS, with_text: bool = False) -> DataFrame:
    """The runs of every text: ``keep`` columns, then

    ``n_words``, ``runs`` (start word, length and period of each, by start and
    period), ``n_runs``, the strongest run's ``start``, ``length``, ``period`` and
    ``exponent_milli``, ``runs_sha256`` (a line ``start,length,period`` for each run),
    ``collapsed_sha256`` (the text without repeated periods) and, ``with_text``, that
    text itself as ``collapsed``.

    Words are what ASCII white space separates, unchanged.  A null, empty or blank
    text has no words and no runs: its four columns of the strongest run are null and
    both digests are those of the empty string.  Rows are judged one by one, so
    repeated rows give repeated results; no rows give no rows.  A kept column with the
    name of a result is returned as ``<name>_input``.
    """
    K.small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    schema = _SCHEMA + (", collapsed string" if with_text else "")
    made = [f.split()[0] for f in schema.split(", ")]
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(docs[c].alias(k) for c, k in zip(keep, kept)), docs[text].cast("string").alias("text"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def judge(batches):
        for batch, texts in K.text_chunks(batches):
            words = [text_words(t) for t in texts]
            columns: dict[str, list] = {name: [] for name in made}
            for w, found in zip(words, _chunk_runs(words, min_words, min_repeats)):
                runs = [tuple(r) for r in found.tolist()]
                best = strongest(runs)
                start, length, period = best or (None, None, None)
                collapsed = collapse(w, runs)
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                values = (len(w), [dict(zip(("start", "length", "period"), r)) for r in runs], len(runs), start, length,
                          period, best and 1000 * length // period, hashlib.sha256(lines.encode()).hexdigest(),
                          hashlib.sha256(collapsed).hexdigest())
                for name, value in zip(made, (*values, collapsed.decode()) if with_text else values):
                    columns[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(kept))] + [pa.array(columns[c], _TYPES[c]) for c in made],
                names=kept + made)

    full = ", ".join([f"{k} {types[k]}" for k in kept] + [schema])
    found = rows.mapInArrow(judge, full)
    return found.select(*(found[k].alias(f"{c}_input" if c in made else c) for c, k in zip(keep, kept)), *made)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_TYPES = {c: pa.int64() for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")} | {
    "runs": pa.list_(_RUN), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "collapsed": pa.string()}


def repeat_tails(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): every tenth document by crc32 of its id with a repeated tail.

    With h = crc32 of the decimal id, g = h div 10: if h mod 10 = 0 and there are n > 0
    words, each word i >= a becomes word a + (i - a) mod p, a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8); the words are joined by one space.  Other texts,
    and those of a null id, are unchanged; a null text is empty.
    """
    import zlib

    def rewrite(batches):
        for batch, texts in K.text_chunks(batches):
            out = []
            for key, t in zip(batch.column(0).to_pylist(), texts):
                h = 1 if key is None else zlib.crc32(str(key).encode())
                words = text_words(t) if h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    t = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
                out.append(t.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    K.small_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(rewrite, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
