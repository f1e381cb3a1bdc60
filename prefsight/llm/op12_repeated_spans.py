"""Repeated spans removed by suffix automata over shards of reference passages.

A window is ``min_words`` consecutive words of a text.  A word goes if a window that
covers it also occurs in a document with a smaller id.

1. *Anchors.*  Each window names the least of the hashes of its runs of ``GRAM`` words,
   so equal windows name equal anchors; a text has about one for each 17 words.  Exact
   copies of a text are settled by their digests first.  Only windows whose anchor
   occurs in two documents can repeat; the other text is not looked at again.
2. *Reference.*  For each such window the first document that holds it is found by an
   aggregate, which combines copies before the shuffle.  The stretches of windows that
   a document is the first of several to hold are the reference passages: one copy of
   everything that repeats.  They are dealt into shards of bounded size.
3. *Automata.*  Documents are routed to the shards that hold their windows.  A task
   gets one shard, builds its suffix automaton over the words themselves, each state
   with the least document it occurs in, and streams the routed spans through it.  The
   matching statistics give the maximal spans of ``min_words`` words or more that a
   smaller document holds.  Hashes only propose; these words decide.

A shard is sent to the tasks that stream documents against it, not to all workers, as
the reference grows with the corpus; if many documents need one shard, they are dealt
into several groups with a copy of it each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefsight.llm import kernels as K
from prefsight.session import ensure_checkpoint_dir, shuffles_removed, stored

MIN_WORDS = 50
#: Words of a run whose hash can be an anchor.
GRAM = 18
#: Windows of one document in one piece of a reference shard.
PIECE = 16_384
#: Words of a reference shard, on average, and of the spans streamed against one copy of it.
SHARD_WORDS = 60_000
STREAM_WORDS = 400_000


# --- the automaton ----------------------------------------------------------

class SuffixAutomaton:
    """All factors of the added word sequences, each with its least owner."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, length: int, link: int, moves: dict[int, int], owner) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the factors that p extends by the word."""
        follow, link = self.next, self.link
        clone = self._state(self.length[p] + 1, link[q], dict(follow[q]), self.owner[q])
        link[q] = clone
        while p != -1 and follow[p].get(word) == q:
            follow[p][word] = clone
            p = link[p]
        return clone

    def add(self, words, owner: int) -> None:
        follow, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for word in words:
            known = follow[last].get(word)
            if known is not None:
                if length[known] != length[last] + 1:
                    known = self._split(last, word, known)
                if owners[known] is None or owner < owners[known]:
                    owners[known] = owner
                last = known
                continue
            p, last = last, self._state(length[last] + 1, 0, {}, owner)
            while p != -1 and word not in follow[p]:
                follow[p][word] = last
                p = link[p]
            if p != -1:
                q = follow[p][word]
                link[last] = q if length[q] == length[p] + 1 else self._split(p, word, q)

    def finish(self) -> SuffixAutomaton:
        """Hand each state's owner on to the states of its suffixes."""
        link, owners = self.link, self.owner
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if link[v] > 0 and (owners[link[v]] is None or owners[v] < owners[link[v]]):
                owners[link[v]] = owners[v]
        return self

    def repeats(self, words, min_words: int, document: int) -> list[tuple[int, int]]:
        """Maximal (start, end) covered by windows that a smaller document than this one holds."""
        follow, link, length, owners = self.next, self.link, self.length, self.owner
        out: list[list[int]] = []
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in follow[state]:
                state = link[state]
                matched = length[state]
            if word in follow[state]:
                state = follow[state][word]
                matched += 1
            if matched < min_words:
                continue
            while length[link[state]] >= min_words:
                state = link[state]
                matched = length[state]
            if owners[state] < document:
                if out and out[-1][1] >= i + 1 - min_words:
                    out[-1][1] = i + 1
                else:
                    out.append([i + 1 - min_words, i + 1])
        return [tuple(x) for x in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint ones, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


# --- anchors and windows ----------------------------------------------------

def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - span:width - span + n])


def window_anchors(hashes: np.ndarray, min_words: int, gram: int) -> np.ndarray:
    """The anchor of each window of a text; empty if it has no window."""
    if len(hashes) < min_words:
        return np.empty(0, np.uint64)
    return _sliding_min(K.rolling(hashes, gram), min_words - gram + 1)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window, from prefix sums of the powers of an odd base."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = K._power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:len(hashes)], out=sums[1:])
    return K.mix((sums[size:] - sums[:n]) * inverse[:n])


def _text_hashes(texts: list[bytes]) -> list[np.ndarray]:
    hashes, bounds = K.word_hashes(texts, K.EXACT_WORDS)
    return [hashes[bounds[i]:bounds[i + 1]] for i in range(len(texts))]


def _profile_rows(batches, min_words: int, gram: int):
    """Per text: its words, the digest of its words, its distinct anchors."""
    for batch, texts in K.text_chunks(batches):
        sizes, digests, anchors = [], [], []
        for t, h in zip(texts, _text_hashes(texts)):
            sizes.append(len(h))
            digests.append(hashlib.sha256(b" ".join(t.split())).hexdigest())
            anchors.append(np.unique(window_anchors(h, min_words, gram)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests),
             pa.array(anchors, pa.list_(pa.int64()))], names=["doc", "mark", "n_words", "digest", "anchors"])


def _span_rows(batches, min_words: int, gram: int):
    """Stretches of windows with a shared anchor: where they start and their words."""
    for batch, texts in K.text_chunks(batches):
        shared = batch.column(batch.schema.get_field_index("shared"))
        rows: list[tuple] = []
        for i, (t, h) in enumerate(zip(texts, _text_hashes(texts))):
            found = np.array(shared[i].as_py(), np.int64).view(np.uint64)
            hit = np.flatnonzero(np.isin(window_anchors(h, min_words, gram), found))
            if not len(hit):
                continue
            words = t.split()
            doc, mark = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for a, b in merged([(s, s + min_words) for s in _stretch_bounds(hit, min_words)]):
                rows.append((doc, mark, a, b - a, b" ".join(words[a:b]).decode()))
        for first in range(0, len(rows), K.BATCH_ROWS):
            part = list(zip(*rows[first:first + K.BATCH_ROWS]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, _SPAN_TYPES)], names=_SPAN_NAMES)


def _stretch_bounds(hit: np.ndarray, min_words: int) -> list[int]:
    """Enough of the sorted window starts for the union of their windows to be that of all."""
    cut = np.flatnonzero(np.diff(hit) > min_words)
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(hit) - 1]))
    out: list[int] = []
    for a, b in zip(first.tolist(), last.tolist()):
        part = hit[a:b + 1]
        out += range(int(part[0]), int(part[-1]) + 1, min_words)
        out.append(int(part[-1]))
    return out


_SPAN = "doc bigint, mark bigint, start bigint, n bigint, text string"
_SPAN_NAMES = [f.split()[0] for f in _SPAN.split(", ")]
_SPAN_TYPES = [pa.int64()] * 4 + [pa.string()]


def _window_rows(batches, min_words: int):
    """(window, doc, mark, start, at): the hash of each window of a span, at an offset in it."""
    for batch, texts in K.text_chunks(batches):
        found = [window_hashes(h, min_words) for h in _text_hashes(texts)]
        sizes = np.array([len(f) for f in found])
        if not sizes.sum():
            continue
        ids = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes)) for i in range(3)]
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *ids, pa.array(at)],
                                         names=["window", "doc", "mark", "start", "at"])


def _passage_rows(batches, min_words: int):
    """The words of each run of owned windows of a span: (doc, piece key, n, text)."""
    for batch, texts in K.text_chunks(batches):
        rows = []
        for i, t in enumerate(texts):
            doc, mark, start = (batch.column(k)[i].as_py() for k in range(3))
            at = np.unique(np.array(batch.column(batch.schema.get_field_index("owned"))[i].as_py(), np.int64))
            words = t.split()
            cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(at // PIECE) != 0))
            for a, b in zip(at[np.concatenate(([0], cut + 1))].tolist(), at[np.concatenate((cut, [len(at) - 1]))].tolist()):
                rows.append((doc, mark, start, a // PIECE, b + min_words - a, b" ".join(words[a:b + min_words]).decode()))
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.string()])],
                                         names=["doc", "mark", "start", "piece", "n", "text"])


def _stream(shard: pa.Table, spans: pa.Table, min_words: int) -> pa.Table:
    """Spans of one group of documents that the automaton of one shard finds."""
    names: dict[str, int] = {}
    automaton = SuffixAutomaton()
    if spans.num_rows:
        for doc, text in zip(shard["doc"].to_pylist(), shard["text"].to_pylist()):
            automaton.add([names.setdefault(w, len(names)) for w in text.split(" ")], doc)
        automaton.finish()
    out = []
    for doc, mark, start, text in zip(*(spans[c].to_pylist() for c in ("doc", "mark", "start", "text"))):
        words = [names.get(w, -1) for w in text.split(" ")]
        out += [(doc, mark, start + a, start + b) for a, b in automaton.repeats(words, min_words, doc)]
    columns = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc", "mark", "first", "last"])


def _cut_rows(batches):
    """Words left of each text without its spans."""
    for batch, texts in K.text_chunks(batches):
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        removed, digests, kept_spans, kept_texts = [], [], [], []
        for t, found in zip(texts, spans):
            words, left, at = t.split(), [], 0
            union = merged([(s["first"], s["last"]) for s in found])
            for a, b in union:
                left += words[at:a]
                at = b
            kept = b" ".join(left + words[at:])
            removed.append(sum(b - a for a, b in union))
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_spans.append([{"first": a, "last": b} for a, b in union])
            kept_texts.append(kept.decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
             pa.array(kept_spans, _SPANS), pa.array(kept_texts, pa.string())],
            names=["doc", "mark", "n_removed", "digest", "spans", "kept"])


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_CUT = ("doc bigint, mark bigint, n_removed bigint, digest string, "
        "spans array<struct<first:bigint,last:bigint>>, kept string")


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                   gram: int = GRAM, shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS,
                   with_text: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256, spans`` and, ``with_text``, ``kept_text``.

    ``spans`` are the removed words as disjoint (first, last) word numbers, last excluded.
    A word is removed if ``min_words`` consecutive words around it also occur in a
    document with a smaller id; the first holder of a passage keeps it, however often it
    repeats it.  Words are what ASCII white space separates, unchanged; what is left is
    joined by one space.

    Ids are taken as long integers.  A null, empty or blank text has no words.  A row
    with a null id is smaller than none and none is smaller than it: nothing is removed,
    and it is no reference.  Rows that repeat an id are judged one by one, and not
    against each other.  Other columns are not read, whatever their names.  No rows give
    no rows.
    """
    if not 0 < gram <= min_words:
        raise ValueError("an anchor lies within a window")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    K.small_batches(spark)
    body = docs[text].cast("string")
    rows = docs.select(docs[doc_id].cast("long").alias("doc"), F.xxhash64(body).alias("mark"), body.alias("text"))

    profiles = stored(rows.mapInArrow(
        lambda it: _profile_rows(it, min_words, gram),
        "doc bigint, mark bigint, n_words bigint, digest string, anchors array<bigint>"), "spans-profiles")
    # Copies of a whole text repeat wholly and are nobody's first holder.
    whole = profiles.where("doc is not null and size(anchors) > 0").select("doc", "mark", "digest", "anchors").dropDuplicates(
        ["doc", "mark"])
    firsts = whole.groupBy("digest").agg(F.min("doc").alias("first_doc"))
    single = whole.join(firsts, "digest").where("doc = first_doc").select("doc", "mark", "anchors")
    anchors = single.select("doc", "mark", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor")
    # Stored on its own, so that the shuffles of the anchors are gone before texts are shuffled.
    marked = stored(anchors.join(shared, "anchor").groupBy("doc", "mark").agg(F.collect_list("anchor").alias("shared")),
                    "spans-marked")
    spans = stored(rows.join(marked, ["doc", "mark"]).select("doc", "mark", "shared", "text").mapInArrow(
        lambda it: _span_rows(it, min_words, gram), _SPAN).dropDuplicates(["doc", "mark", "start"]), "spans-spans")

    windows = spans.mapInArrow(lambda it: _window_rows(it, min_words),
                               "window bigint, doc bigint, mark bigint, start bigint, at int")
    owner = F.min(F.struct("doc", "mark", "start", "at")).alias("owner")
    owned = stored(windows.groupBy("window").agg(owner, F.max("doc").alias("most")).where("owner.doc < most")
                   .select("window", "owner.*"), "spans-owned")
    key = ["doc", "mark", "start"]
    by_span = owned.groupBy(*key).agg(F.collect_list("at").alias("owned"))
    passages = stored(spans.join(by_span, key).select(*key, "owned", "text").mapInArrow(
        lambda it: _passage_rows(it, min_words),
        "doc bigint, mark bigint, start bigint, piece bigint, n bigint, text string"), "spans-passages")
    with shuffles_removed(spark):
        total = passages.agg(F.sum("n")).first()[0] or 0
    n_shards = max(1, -(-total // shard_words))

    def shard(piece):
        return F.pmod(F.xxhash64("doc", "mark", "start", piece), F.lit(n_shards)).alias("shard")

    shards = passages.select(shard(F.col("piece")), "doc", "text")
    homes = owned.select("window", F.col("doc").alias("first_doc"), shard(F.floor(F.col("at") / PIECE)))
    routed = (windows.join(homes, "window").where("doc > first_doc").select("shard", *key).distinct()
              .join(spans, key)).select("shard", *key, "n", "text")
    routed = stored(routed, "spans-routed")
    copies = routed.groupBy("shard").agg(F.ceil(F.sum("n") / stream_words).alias("copies"))
    streams = routed.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64(*key), F.col("copies")))
    dealt = shards.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    found = (dealt.select("shard", "copy", "doc", "text").groupBy("shard", "copy")
             .cogroup(streams.select("shard", "copy", *key, "text").groupBy("shard", "copy"))
             .applyInArrow(lambda a, b: _stream(a, b, min_words), "doc bigint, mark bigint, first bigint, last bigint"))
    gone = stored(found.distinct().groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans")),
                  "spans-gone")
    cut = (rows.join(gone, ["doc", "mark"]).select("doc", "mark", "spans", "text").mapInArrow(_cut_rows, _CUT)
           .dropDuplicates(["doc", "mark"]))
    if not with_text:
        cut = cut.drop("kept")

    empty = F.lit(hashlib.sha256(b"").hexdigest())
    copy = (F.col("doc") > F.col("first_doc")) & (F.col("n_words") >= min_words)
    copy = F.coalesce(copy, F.lit(False))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("last")))
    nothing = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")
    out = (profiles.drop("anchors").withColumnRenamed("digest", "full")
           .join(firsts.withColumnRenamed("digest", "full"), "full", "left")
           .join(cut, ["doc", "mark"], "left"))
    columns = [F.col("doc").alias(doc_id), "n_words",
               F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
               F.when(copy, empty).otherwise(F.coalesce("digest", "full")).alias("kept_sha256"),
               F.when(copy, everything).otherwise(F.coalesce("spans", nothing)).alias("spans")]
    if not with_text:
        return out.select(*columns)
    # Texts without repeats keep all their words.
    full = rows.select(F.col("doc").alias("d"), F.col("mark").alias("m"), "text").dropDuplicates(["d", "m"])
    plain = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), " ")
    out = out.join(full, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    return out.select(*columns, F.when(copy, F.lit("")).otherwise(F.coalesce("kept", plain)).alias("kept_text"))
