"""Benchmark decontamination by a prefix-filtered set join.

An item window is a run of ``window`` words of a benchmark item (a shorter item
is one window).  It is looked up by containment 1.0, so of its shingles, ordered
from the rarest in the corpus to the most frequent, one is a necessary prefix:
a text that holds the window holds that shingle.

1. Windows of all items are made by a distributed pass and dealt into blocks of
   about ``block_windows`` distinct windows, the proven bound of what is broadcast.
2. One pass over all texts counts the window shingles of the block.
3. A second pass joins each window's rarest shingle with the texts' shingles;
   the shingle's offset fixes where the window would lie (positional bound), which
   must be inside the text (length bound), and every word is compared there.

A benchmark of several blocks takes the two passes per block and carries the
hits along with the texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefsight.llm import kernels as K
from prefsight.session import ensure_checkpoint_dir

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 200_000

_RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _window_rows(batches: Iterator[pa.RecordBatch], window: int):
    for batch, texts in K.text_chunks(batches):
        hashes, bounds = K.word_hashes(texts, K.ALNUM_WORDS)
        ids, wins = [], []
        for i, item in enumerate(batch.column(0).to_pylist()):
            h = hashes[bounds[i]:bounds[i + 1]]
            size = min(window, len(h))
            for s in range(len(h) - size + 1 if size else 0):
                ids.append(item)
                wins.append(h[s:s + size].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary())],
                                         names=["item", "win"])


class _Block:
    """Windows of one block: words, sizes, item lists and their shingles."""

    def __init__(self, rows):
        self.words = [np.frombuffer(r["win"], np.uint64) for r in rows]
        self.items = [r["items"] for r in rows]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        width = int(self.sizes.max(initial=0))
        self.matrix = np.zeros((len(rows), width), np.uint64)
        for i, w in enumerate(self.words):
            self.matrix[i, :len(w)] = w
        self.vocab = {}
        for q in sorted({min(SHINGLE, int(n)) for n in self.sizes}):
            table = np.unique(np.concatenate([K.rolling(w, q) for w in self.words
                                              if min(SHINGLE, len(w)) == q]))
            self.vocab[q] = (table, K.member_bitmap(table))

    def rank(self, counts: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle; ties by its place in the window."""
        found: dict[int, list] = {q: [] for q in self.vocab}
        for i, w in enumerate(self.words):
            q = min(SHINGLE, len(w))
            s = K.rolling(w, q)
            at = np.searchsorted(self.vocab[q][0], s)
            j = int(np.argmin(counts[q][at]))
            found[q].append((int(at[j]), i, j))
        self.prefix = {}
        for q, rows in found.items():
            if not rows:
                continue
            rows.sort()
            slot = np.array([r[0] for r in rows])
            used, first = np.unique(slot, return_index=True)
            table = self.vocab[q][0][used]
            self.prefix[q] = (table, K.member_bitmap(table), np.append(first, len(rows)),
                              np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        del self.words


def _count_shingles(batches, block: _Block):
    counts = {q: np.zeros(len(t[0]), np.int64) for q, t in block.vocab.items()}
    for _, texts in K.text_chunks(batches):
        hashes, _ = K.word_hashes(texts, K.ALNUM_WORDS)
        for q, (table, bitmap) in block.vocab.items():
            _, at = K.member(K.rolling(hashes, q), table, bitmap)
            counts[q] += np.bincount(at, minlength=len(table))
    for q, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), q, np.int32)), pa.array(at), pa.array(c[at])], names=["q", "at", "n"])


def _find(hashes, bounds, block: _Block):
    """(window, start) of every occurrence in the texts of a chunk."""
    wins, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for q, (table, bitmap, first, win, offset) in block.prefix.items():
        pos, at = K.member(K.rolling(hashes, q), table, bitmap)
        fan = first[at + 1] - first[at]
        row = np.repeat(first[at], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        w, s = win[row], np.repeat(pos, fan) - offset[row]
        text = np.searchsorted(bounds, np.repeat(pos, fan), side="right") - 1
        ok = (s >= bounds[text]) & (s + block.sizes[w] <= bounds[text + 1])
        w, s = w[ok], s[ok]
        for j in range(block.matrix.shape[1]):
            longer = block.sizes[w] > j
            same = ~longer
            same[longer] = hashes[s[longer] + j] == block.matrix[w[longer], j]
            w, s = w[same], s[same]
        wins.append(w)
        starts.append(s)
    return np.concatenate(wins), np.concatenate(starts)


def _hit_rows(batches, block: _Block, n_carried: int, last: bool):
    """Texts with their hits so far (runs of words and item ids), or the result."""
    for batch, texts in K.text_chunks(batches, "__text"):
        hashes, bounds = K.word_hashes(texts, K.ALNUM_WORDS)
        wins, starts = _find(hashes, bounds, block)
        delta = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + block.sizes[wins], -1)
        hit = np.cumsum(delta)[:-1] > 0
        text_of = np.searchsorted(bounds, starts, side="right") - 1
        items: dict[int, set] = {}
        for t, w in set(zip(text_of.tolist(), wins.tolist(), strict=True)):
            items.setdefault(t, set()).update(block.items[w])
        masks, found, out = [], [], []
        for i in range(len(texts)):
            mask = hit[bounds[i]:bounds[i + 1]]
            ids = items.get(i, set())
            if n_carried:
                before = batch.column(batch.num_columns - 2)[i].as_py()
                mask = mask | np.unpackbits(np.frombuffer(before, np.uint8), count=len(mask)).astype(bool)
                ids = ids | set(batch.column(batch.num_columns - 1)[i].as_py())
            if not last:
                masks.append(np.packbits(mask).tobytes())
                found.append(sorted(ids))
                continue
            named = sorted(ids)
            n_hit = int(mask.sum())
            out.append((len(mask), n_hit, len(named),
                        hashlib.sha256(",".join(named).encode()).hexdigest(), n_hit > 0))
        kept = [batch.column(i) for i in range(batch.num_columns - 2 * bool(n_carried))]
        names = batch.schema.names[:len(kept)]
        if not last:
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(masks, pa.binary()), pa.array(found, pa.list_(pa.string()))],
                names=[*names, "__mask", "__items"])
        else:
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*kept[:-1], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=[*names[:-1], "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None,
                  text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with its benchmark overlap.

    Adds n_words, n_hit (words inside any occurrence of an item window), n_items
    (items with an occurring window), items_sha256 (of those ids, sorted as
    strings, comma-joined) and contaminated (n_hit > 0).

    Words are runs of digits, A-Z lower-cased, and all characters beyond ASCII.
    A null or empty text has no words.  Item rows with a null or empty text have
    no window; the windows of a null id hit words but name no item; rows that
    repeat an id add their windows to it.  Repeated text rows each get a row.  An
    empty benchmark hits nothing; no rows give no rows.  Columns of ``docs`` other
    than ``keep`` (all but the text if not given) and the text are not read;
    result columns replace columns of ``keep`` with their names.
    """
    spark = docs.sparkSession
    names = [n.split()[0] for n in _RESULT.split(", ")]
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text and c not in names]
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    wins = (benchmark.select(F.col(item).cast("string").alias("item"),
                             F.col(item_text).cast("string").alias("text"))
            .mapInArrow(lambda it: _window_rows(it, window), "item string, win binary"))
    # collect_set holds the ids of one distinct window; nulls are left out.
    wins = wins.groupBy("win").agg(F.collect_set("item").alias("items"))
    ensure_checkpoint_dir(spark)
    K.small_batches(spark)
    n_wins = wins.count()
    n_blocks = max(1, math.ceil(n_wins / block_windows))
    if n_blocks > 1:
        wins = wins.checkpoint()
    carried = 0
    for b in range(n_blocks):
        mine = wins.where(F.pmod(F.xxhash64("win"), F.lit(n_blocks)) == b) if n_blocks > 1 else wins
        block = _Block(mine.collect())
        shared = spark.sparkContext.broadcast(block)
        counted = (rows.select(F.col("__text").alias("text"))
                   .mapInArrow(lambda it, s=shared: _count_shingles(it, s.value), "q int, at bigint, n bigint")
                   .groupBy("q", "at").agg(F.sum("n").alias("n")))
        counts = {q: np.zeros(len(t[0]), np.int64) for q, t in block.vocab.items()}
        for r in counted.collect():  # at most the shingles of a block
            counts[r["q"]][r["at"]] = r["n"]
        block.rank(counts)
        ranked = spark.sparkContext.broadcast(block)
        last = b == n_blocks - 1
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields
                  if f.name not in ("__mask", "__items")]
        schema = (", ".join([*fields[:-1], _RESULT]) if last
                  else ", ".join([*fields, "__mask binary, __items array<string>"]))
        rows = rows.mapInArrow(
            lambda it, s=ranked, n=carried, z=last: _hit_rows(it, s.value, n, z), schema)
        if not last:
            rows = rows.checkpoint()
            carried = 1
    return rows
