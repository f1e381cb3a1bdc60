"""Frequent phrases by Rabin-Karp fingerprints, ranked by the weakest of their cuts.

Every n-gram of a chunk of texts gets its fingerprint from one prefix polynomial over
the hashes of the words: a difference of two prefix sums times a negative power of the
base.  Three passes aggregate fingerprints and counts, summed within a task and packed
by ranges of fingerprints before the shuffle: words, pairs of frequent words, and three to five words whose pairs are
all frequent, as no phrase occurs more often than a part of it.  What is frequent goes
to the next pass as a Bloom filter, which lets pass a few that are not, never drops one
that is, and has at most ``MAX_BITS`` bits whatever the corpus.

Each row also carries a pointer to an occurrence: the bin (of 256) of its text, of which
the least is kept.  The last pass compares the words of all occurrences of a chunk that
may be frequent with the first of their fingerprint, and materialises a phrase only in
the texts its pointer names.  A fingerprint with two phrases is recounted by text; two
phrases with one 64-bit fingerprint that never meet in a chunk or under the pointers
would stay one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefsight.llm import kernels as K
from prefsight.session import ensure_checkpoint_dir, scratch_path

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
BITS_PER_KEY = 16
#: Bits for each pointer, whose false positives are phrases written out in vain.
BITS_PER_POINTER = 64
MAX_BITS = 1 << 28
#: Fingerprints that a task gathers before it sums and sends them.
GATHER = 1 << 22
#: Bytes of text for each range of fingerprints that a task sums.
RANGE_BYTES = 1 << 23
#: Phrases that a task keeps with their counts before it sends them.
HELD_PHRASES = 100_000

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True


class Chunk:
    """Words of some texts with the fingerprints of their n-grams."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        hashes, starts, sizes, _, buf, offsets = K.word_spans(texts, K.PIECE_WORDS)
        self.starts, self.ends, self.buf = starts, starts + sizes, buf
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        self.piece = np.cumsum(_BREAKS[buf], dtype=np.int64)[starts]
        n = len(hashes)
        power, self.inverse = K._power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=self.sums[1:])
        self.langs = langs
        names = {x: K.word_hashes([x.encode().hex().encode()], K.EXACT_WORDS)[0] for x in set(langs)}
        seed = np.array([names[x][0] if len(names[x]) else 0 for x in langs], np.uint64)
        self.seed = seed[self.row] if n else np.empty(0, np.uint64)
        self.bin = np.array([zlib.crc32(t) & 255 for t in texts], np.uint8)
        self._made: dict[int, np.ndarray] = {}
        self._hits: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.starts)

    def fingerprints(self, n: int) -> np.ndarray:
        """Of the n-gram at each word but the last n - 1, valid or not."""
        if n not in self._made:
            m = max(0, len(self) - n + 1)
            value = (self.sums[n:n + m] - self.sums[:m]) * self.inverse[:m]
            self._made[n] = K.keyed(value + self.seed[:m], n)
        return self._made[n]

    def within_pieces(self, n: int) -> np.ndarray:
        m = max(0, len(self) - n + 1)
        return self.piece[n - 1:n - 1 + m] == self.piece[:m]

    def candidates(self, n: int, filters: dict[int, np.ndarray]) -> np.ndarray:
        """Places of n-grams inside a piece whose words (or pairs, from three words on) may all be frequent."""
        ok = self.within_pieces(n)
        part = 1 if n == 2 else 2
        if n > 1:
            if part not in self._hits:
                self._hits[part] = may_hold(filters[part], self.fingerprints(part))
            hits = self._hits[part]
            for k in range(n - part + 1):
                ok = ok & hits[k:k + len(ok)]
        return np.flatnonzero(ok)


def may_hold(bloom: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the filter (two probes of a bitmap of 64-bit words)."""
    mask = np.uint64(len(bloom) * 64 - 1)
    ok = np.ones(len(values), bool)
    for shift in (0, 32):
        p = (values >> np.uint64(shift)) & mask
        ok &= (bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return ok


def pointed(values: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """One value for a fingerprint and the bin of a text."""
    return values ^ K.mix(bins.astype(np.uint64) + np.uint64(1))


def bloom_filter(keys: DataFrame, bits_per_key: int = BITS_PER_KEY) -> np.ndarray:
    """Filter over the column ``fp``, put together from 64-bit words that tasks OR."""
    need = max(1, keys.count()) * bits_per_key
    bits = min(MAX_BITS, 1 << max(10, (need - 1).bit_length()))
    probe = [F.expr(f"shiftrightunsigned(fp, {s}) & {bits - 1}L") for s in (0, 32)]
    words = (keys.select(F.explode(F.array(*probe)).alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow())
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return bloom


def _chunks(batches):
    for batch, texts in K.text_chunks(batches):
        yield Chunk(texts, batch.column(batch.schema.get_field_index("lang")).to_pylist())


def _totals(fp: np.ndarray, counts: np.ndarray | None, bins: np.ndarray):
    """Distinct fingerprints in order, with the sums of their counts and their least bins."""
    order = np.argsort(fp)
    fp = fp[order]
    first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
    total = np.diff(np.append(first, len(fp))) if counts is None else np.add.reduceat(counts[order], first)
    return fp[first], total, np.minimum.reduceat(bins[order], first)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of the values, all first ones first: of sorted values, the leading ones compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    """One row for each range of fingerprints (their leading ``bits`` bits)."""
    fp, counts, bins = _totals(np.concatenate([p[0] for p in parts]), None, np.concatenate([p[1] for p in parts]))
    edges = np.flatnonzero(np.diff(fp >> np.uint64(64 - bits))) + 1
    pieces = list(zip(*(np.split(x, edges) for x in (fp, counts.astype(np.uint32), bins))))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(f[0] >> np.uint64(64 - bits)) for f, _, _ in pieces], pa.int64()),
         *(pa.array([_planes(p[i]) for p in pieces], pa.binary()) for i in range(3))], names=["part", "fps", "counts", "bins"])


def _often(table: pa.Table, min_count: int) -> pa.Table:
    """The fingerprints of one range that occur often enough."""
    fp, counts, bins = (np.concatenate([_from_planes(x, kind) for x in table[c].to_pylist()])
                        for c, kind in (("fps", np.uint64), ("counts", np.uint32), ("bins", np.uint8)))
    fp, total, least = _totals(fp, counts.astype(np.int64), bins)
    ok = total >= min_count
    return pa.table({"fp": fp[ok].view(np.int64), "f": total[ok], "bin": least[ok].astype(np.int16)})


def _count_rows(batches, sizes: tuple[int, ...], filters: dict[int, np.ndarray], bits: int):
    parts, held = [], 0
    for chunk in _chunks(batches):
        for n in sizes:
            at = chunk.candidates(n, filters)
            parts.append((chunk.fingerprints(n)[at], chunk.bin[chunk.row[at]]))
            held += len(at)
        if held >= GATHER:
            yield _summed(parts, bits)
            parts, held = [], 0
    if held:
        yield _summed(parts, bits)


def _pointed_rows(batches):
    for batch in batches:
        values = pointed(batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["fp"])


def _occurrences(chunk: Chunk, filters: dict[int, np.ndarray], longest: int, only: np.ndarray | None = None):
    """Places that may hold a frequent phrase, for each size: (size, places, pointers, counts, shared, stray).

    ``pointers`` are the first places of the distinct fingerprints, ``counts`` how often
    their words occur; ``stray`` are places with the fingerprint of a pointer, a ``shared``
    one, but other words.
    """
    names: dict[bytes, int] = {}
    lower = chunk.buf.tobytes().lower()
    ids = np.array([names.setdefault(lower[a:b], len(names)) for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist())],
                   np.int64)
    lang = np.unique(np.array(chunk.langs), return_inverse=True)[1][chunk.row] if len(chunk) else ids
    for n in range(1, longest + 1):
        at = chunk.candidates(n, filters)
        fp = chunk.fingerprints(n)[at]
        ok = may_hold(filters[min(n, 3)] if only is None else only, fp)
        at, fp = at[ok], fp[ok]
        _, first, which = np.unique(fp, return_index=True, return_inverse=True)
        pointer = at[first]
        same = lang[at] == lang[pointer[which]]
        for k in range(n):
            same &= ids[at + k] == ids[pointer[which] + k]
        shared = np.bincount(which[~same], minlength=len(pointer)) > 0
        yield n, at, pointer, np.bincount(which[same], minlength=len(pointer)), shared, at[~same]


def _phrase(chunk: Chunk, place: int, n: int) -> bytes:
    return b" ".join(chunk.buf[chunk.starts[i]:chunk.ends[i]].tobytes() for i in range(place, place + n)).lower()


def _phrase_rows(batches, filters: dict[int, np.ndarray], pointers: np.ndarray | None, longest: int,
                 only: np.ndarray | None = None):
    """Phrases of the texts that pointers name, once a task, and the words of each lang (size 0).

    Without ``pointers``, all phrases in the filter ``only`` with their counts.
    """
    held: dict[tuple, int] = {}

    def batch():
        keys = list(held)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*columns[:3], columns[3].cast(pa.string()), pa.array(list(held.values()), pa.int64())],
                                          names=["fp", "lang", "size", "phrase", "c"])

    def add(fp: int, lang: str, n: int, phrase: bytes, c: int):
        held[fp, lang, n, phrase] = held.get((fp, lang, n, phrase), 0) + c

    for chunk in _chunks(batches):
        if pointers is not None:
            for lang, c in zip(chunk.langs, np.bincount(chunk.row, minlength=len(chunk.langs)).tolist()):
                add(0, lang, 0, b"", c)
        for n, at, first, counts, shared, stray in _occurrences(chunk, filters, longest, only):
            values = chunk.fingerprints(n)
            if pointers is not None:
                at = at[may_hold(pointers, pointed(values[at], chunk.bin[chunk.row[at]]))]
                first = np.concatenate((first[shared], at[np.unique(values[at], return_index=True)[1]]))
                counts = np.zeros(len(first), np.int64)
            for places, c in ((first, counts), (stray, np.ones(len(stray), np.int64))):
                fps, rows = values[places].view(np.int64).tolist(), chunk.row[places].tolist()
                for p, v, r, x in zip(places.tolist(), fps, rows, c.tolist()):
                    add(v, chunk.langs[r], n, _phrase(chunk, p, n), x)
        if len(held) >= HELD_PHRASES:
            yield batch()
            held.clear()
    if held:
        yield batch()


_PHRASES = "fp bigint, lang string, size int, phrase string, c bigint"


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                     longest: int = LONGEST) -> DataFrame:
    """(lang, size, phrase, f): all phrases of 1 to ``longest`` words that occur ``min_count`` times or more.

    f counts all occurrences within pieces, overlaps included, per lang.  The row of
    size 0 has the number of all words of its lang.
    """
    if longest < 3:
        raise ValueError("phrases of up to three words or more")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    K.small_batches(spark)
    rows = docs.select(docs[text].cast("string").alias("text"),
                       F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"))
    # Ranges of fingerprints, so many that one has a few megabytes at any size of the corpus.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (size // RANGE_BYTES).bit_length())
    filters: dict[int, np.ndarray] = {}
    often = []
    for key, sizes in ((1, (1,)), (2, (2,)), (3, tuple(range(3, longest + 1)))):
        sent = spark.sparkContext.broadcast(dict(filters))
        often.append(rows.mapInArrow(lambda it, sizes=sizes, sent=sent: _count_rows(it, sizes, sent.value, bits),
                                     "part bigint, fps binary, counts binary, bins binary")
                     .groupBy("part").applyInArrow(lambda t: _often(t, min_count), "fp bigint, f bigint, bin smallint")
                     .checkpoint())
        filters[key] = bloom_filter(often[-1])
    found = often[0].union(often[1]).union(often[2])
    mixed = found.mapInArrow(_pointed_rows, "fp bigint")
    sent = spark.sparkContext.broadcast((filters, bloom_filter(mixed, BITS_PER_POINTER)))
    path = scratch_path(spark, "phrases")
    (rows.mapInArrow(lambda it: _phrase_rows(it, *sent.value, longest), _PHRASES)
     .groupBy("fp", "lang", "size", "phrase").agg(F.sum("c").alias("c")).write.parquet(path))
    phrases = spark.read.parquet(path)
    totals = phrases.where("size = 0").select("lang", "size", "phrase", F.col("c").alias("f"))
    counted = phrases.where("size > 0").join(found, "fp")
    shared = counted.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp").checkpoint()
    if shared.isEmpty():
        return counted.select("lang", "size", "phrase", "f").union(totals)
    again = spark.sparkContext.broadcast(bloom_filter(shared))
    parts = spark.sparkContext.broadcast(filters)
    recounted = (rows.mapInArrow(lambda it: _phrase_rows(it, parts.value, None, longest, again.value), _PHRASES)
                 .join(shared, "fp", "left_semi").groupBy("lang", "size", "phrase").agg(F.sum("c").alias("f"))
                 .where(F.col("f") >= min_count))
    return (counted.join(shared, "fp", "left_anti").select("lang", "size", "phrase", "f").union(recounted).union(totals))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each lang's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts (A-Z lower-cased) are split into pieces at ``.,;:!?`` and line breaks, pieces
    into words at blanks and tabs.  Candidates have 2 to ``longest`` words and
    a = f(phrase) >= ``min_count``.  Cut after k words, with l and r the counts of the
    parts and n all words of the lang, a candidate scores floor(1000 a n / (l r)) in
    exact arithmetic; its lowest cut counts (ties: least k).  A candidate that lies
    inside a longer one of at least the same count is dropped.  Order: score and a
    descending, phrase in UTF-8 byte order.

    A null lang is ``und``.  A null, empty or blank text has no words.  Repeated rows
    count each time.  Other columns are not read, whatever their names.  No rows, or no
    frequent phrases, give no rows.
    """
    counts = frequent_phrases(docs, text=text, lang=lang, min_count=min_count, longest=longest)
    f = counts.where("size > 0").select("lang", "phrase", "f")
    cands = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"),
                                            F.split("phrase", " ").alias("w"))

    def joined(first, size):
        return F.array_join(F.slice("w", first, size), " ")

    cuts = cands.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"),
                       joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = (cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    exact = "decimal(19, 0)"
    score = F.expr(f"(cast(1000 * a as {exact}) * cast(n as {exact})) div (cast(l as {exact}) * cast(r as {exact}))")
    scored = (cuts.join(totals, "lang").withColumn("score", score)
              .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n", "a")).alias("s"))
              .select("lang", "phrase", "s.*"))

    longer = cands.where("size > 2").select(
        "lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    longer = longer.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("s"))
    around = (longer.select("lang", joined(F.col("s"), F.col("m")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    kept = scored.join(around, ["lang", "phrase"], "left").where("most is null or most < a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
