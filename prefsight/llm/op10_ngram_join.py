"""N-gram Jaccard self-join by filtering under multiple global token orders.

A text's set is its distinct five-word shingles.  Two sets with Jaccard >= t that
are ordered by one global order of all shingles share a token in their first
``n - ceil(t n) + 1`` tokens; this holds for every order, so a candidate pair has
to pass the filter of each of several orders before it is verified exactly.

* ``BANDS * ROWS`` orders are keyed permutations of the shingles.  Rows of a *group*
  agree on the first token of ``ROWS`` orders at once; the pairs of a group have
  passed those filters and are verified in blocks.  This finds nearly all links,
  and large families of near copies become one component each.
* One order goes from rare to frequent shingles (frequencies of all texts, in a
  sketch of fixed size), so passages that many texts share come last.  Its whole
  prefixes are joined.  Only pairs in different components, that no group has
  compared, whose sizes, positions and histograms by hash allow a link, and that
  also share a prefix token under the permuted orders, are verified: every link
  not yet implied is found.

Texts with equal sets are one node.  A block of a group emits a spanning forest of
its links, not the links, so no node makes the pairs of a family; the remaining
pairs are dealt into tiles, and a text is sent to a tile once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefsight.llm import kernels as K
from prefsight.llm.components import connected_components
from prefsight.session import checkpointed, ensure_checkpoint_dir, shuffles_removed

SHINGLE = 5
PERCENT = 80
BANDS = 6
ROWS = 3
SKETCH_BITS = 20
BLOCK = 256
#: Cells of a set's histogram by hash (a byte each).
CELLS = 256
#: Most shingles of a block: some megabytes of texts and their hashes in a task.
BLOCK_SHINGLES = 100_000
#: Most bytes broadcast to a scan of the texts; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Bytes a broadcast row takes beside its lists.
_ROW_BYTES = 64
#: Most rows of ids alone that are broadcast.
BROADCAST_ROWS = BROADCAST_BYTES // _ROW_BYTES

_MULTIPLIERS = K.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The set of each text; about a megabyte of texts is hashed at a time."""
    sets, start, held = [], 0, 0
    for end in range(1, len(texts) + 1):
        held += len(texts[end - 1]) + 1
        if end == len(texts) or held + len(texts[end]) > K.CHUNK_BYTES:
            hashes, bounds = K.word_hashes(texts[start:end], K.SPACE_WORDS)
            sets += [np.unique(K.shingles_of(hashes[a:b], size)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            start, held = end, 0
    return sets


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


# --- frequency sketch -------------------------------------------------------

def _sketch_rows(batches, size: int):
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    shift = np.uint64(64 - SKETCH_BITS)
    for _, texts in K.text_chunks(batches):
        hashes, _ = K.word_hashes(texts, K.SPACE_WORDS)
        np.add.at(counts, (K.rolling(hashes, size) >> shift).astype(np.int64), 1)
    for block, part in enumerate(counts.reshape(64, -1)):
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.astype(np.uint32).tobytes()])],
                                         names=["block", "counts"])


def _sum_sketch(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(b, np.uint32).astype(np.int64) for b in table["counts"].to_pylist()]
    return pa.table({"block": [table["block"][0].as_py()], "counts": [sum(parts).tobytes()]})


def frequency_levels(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Level of each sketch cell: 0, or 1 + log2 of how far it is above chance.

    Counts of all texts; the sketch (2**SKETCH_BITS counters) bounds what tasks
    send and what is broadcast, whatever the corpus.
    """
    with shuffles_removed(docs.sparkSession):
        rows = (docs.select("text").mapInArrow(lambda it: _sketch_rows(it, size), "block bigint, counts binary")
                .groupBy("block").applyInArrow(_sum_sketch, "block bigint, counts binary").collect())
    counts = np.zeros((64, (1 << SKETCH_BITS) // 64), np.int64)
    for r in rows:
        counts[r["block"]] = np.frombuffer(r["counts"], np.int64)
    mean = counts.mean()
    usual = mean + 6 * np.sqrt(mean) + 8
    return np.where(counts > usual, 1 + np.log2(np.maximum(counts, 1) / usual), 0).astype(np.uint8).ravel()


# --- sets and their prefixes ------------------------------------------------

def _signature_rows(batches, levels: np.ndarray, size: int, percent: int):
    shift = np.uint64(64 - SKETCH_BITS)
    for batch, texts in K.text_chunks(batches):
        n, sig, bands, prefix, heavy, cells = [], [], [], [], [], []
        for s in _sets(texts, size):
            n.append(len(s))
            if not len(s):
                for out in (sig, bands, prefix, heavy, cells):
                    out.append(None)
                continue
            sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            firsts = (s[None, :] * _MULTIPLIERS[:, None]).min(axis=1).reshape(BANDS, ROWS)
            bands.append([x[0] for x in (K.rolling(f, ROWS) for f in firsts)])
            cells.append(np.minimum(np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 255)
                         .astype(np.uint8).tobytes())
            level = levels[(s >> shift).astype(np.int64)]
            first = np.argsort(level, kind="stable")[:prefix_size(len(s), percent)]
            prefix.append(s[first].view(np.int64))
            heavy.append(int((level[first] == 0).sum()))
        as_long = [None if b is None else np.array(b, np.uint64).view(np.int64) for b in bands]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
             pa.array(as_long, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64())),
             pa.array(heavy, pa.int32()), pa.array(cells, pa.binary())],
            names=["id", "n", "sig", "bands", "prefix", "n_light", "cells"])


# --- verification -----------------------------------------------------------

def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the linked pairs among a block's sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    inter = np.zeros((len(sets), len(sets)), np.float32)
    if len(sets) == 2:
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts[column] > 1
        owner, column = owner[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, (first, first + 4096))
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[a:b], column[a:b] - first] = 1
            inter += part @ part.T
    inter = inter.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    link = 100 * inter >= percent * union
    np.fill_diagonal(link, False)
    return link


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric matrix connects."""
    seen = np.zeros(len(link), bool)
    out = []
    for root in range(len(link)):
        if seen[root]:
            continue
        seen[root] = True
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(link[at] & ~seen)
            seen[new] = True
            out += [(root, int(x)) for x in new]
            queue += new.tolist()
    return out


def _verify_group(table: pa.Table, size: int, percent: int) -> pa.Table:
    ids = table["id"].to_pylist()
    sets = _sets([t or b"" for t in table["text"].cast(pa.binary()).to_pylist()], size)
    pairs = [(ids[a], ids[b]) for a, b in forest(linked(sets, percent)) if ids[a] != ids[b]]
    return pa.table({"src": pa.array([a for a, _ in pairs], pa.int64()),
                     "dst": pa.array([b for _, b in pairs], pa.int64())})


def _close_cells(batches, percent: int):
    """Pairs whose histograms differ by no more than those of linked sets can.

    Each token in one set only changes one cell by one (cells stop at 255, which
    lowers the difference), and linked sets have at most
    ``(100 - percent) / (100 + percent)`` of both sizes of such tokens.
    """
    for batch in batches:
        n = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
                for i in (4, 5))
        ok = (100 + percent) * np.abs(a - b).sum(axis=1, dtype=np.int64) <= (100 - percent) * n
        kept = batch.filter(pa.array(ok))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["src", "dst"])


def _share_prefixes(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets share a prefix token under each of the permuted orders."""
    for m in _MULTIPLIERS[:ROWS]:
        x, y = (np.partition(s * m, k - 1)[:k] for s, k in ((s, prefix_size(len(s), percent)) for s in (a, b)))
        if not len(np.intersect1d(x, y, assume_unique=True)):
            return False
    return True


def _verify_tile(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Linked pairs of a tile: each row has a text and the partners to compare it with."""
    ids = table["id"].to_pylist()
    sets = _sets([t or b"" for t in table["text"].cast(pa.binary()).to_pylist()], size)
    rows: dict[int, list[int]] = {}
    for i, x in enumerate(ids):
        rows.setdefault(x, []).append(i)
    found = []
    for i, partners in enumerate(table["partners"].to_pylist()):
        for other in set(partners):
            for j in rows.get(other, ()):
                a, b = sets[i], sets[j]
                if (100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and _share_prefixes(a, b, percent)
                        and linked([a, b], percent)[0, 1]):
                    found.append((ids[i], other))
    return pa.table({"src": pa.array([a for a, _ in found], pa.int64()),
                     "dst": pa.array([b for _, b in found], pa.int64())})


def _picked(rows: DataFrame, ids: DataFrame, on, entries: str = "0") -> DataFrame:
    """``rows`` joined with slim ``ids``, which are broadcast if they have few bytes.

    ``entries`` gives the number of list entries of a row of ``ids``.  Of more bytes,
    only the distinct ids are broadcast if they fit, to turn other rows away first.
    """
    ids = checkpointed(ids)
    with shuffles_removed(ids.sparkSession):
        size = ids.agg(F.coalesce(F.sum(_ROW_BYTES + 8 * F.expr(entries)), F.lit(0)).alias("b"),
                       F.count(F.lit(1)).alias("n")).first()
    if size["b"] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(ids), on)
    if size["n"] <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")  # few texts are shuffled
    return rows.join(ids, on)


def _blocks(by: str, n: str):
    """Number of blocks of a group: of at most BLOCK texts and BLOCK_SHINGLES shingles on average."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(n) / BLOCK_SHINGLES)).cast("int").alias(by)


def _block_edges(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified edges inside groups; ``members`` has (band, key, node, n).

    A group of more than a block of texts or shingles is dealt into blocks, and each
    pair of blocks is a task's group of its own.
    """
    blocks = members.groupBy("band", "key").agg(_blocks("nb", "n"))
    dealt = (members.join(blocks, ["band", "key"])
             .withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("band", "key", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"), "node"))
    rows = _picked(docs, dealt.withColumnRenamed("node", "id"), "id").select("band", "key", "lo", "hi", "id", "text")
    return (rows.groupBy("band", "key", "lo", "hi")
            .applyInArrow(lambda t: _verify_group(t, size, percent), "src bigint, dst bigint"))


def _pair_edges(docs: DataFrame, pairs: DataFrame, sizes: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified pairs among candidates (src, dst); ``sizes`` has (node, n).

    Components of the candidate graph, dealt into blocks, make tiles; a text is
    sent once to each tile in which it has a pair, not once per pair.
    """
    clusters = connected_components(pairs)
    blocks = clusters.join(sizes, "node").groupBy("component").agg(_blocks("nb", "n"))
    placed = (pairs.join(clusters, pairs["src"] == clusters["node"]).join(blocks, "component")
              .withColumn("a", F.pmod(F.xxhash64("src"), F.col("nb"))).withColumn("b", F.pmod(F.xxhash64("dst"), F.col("nb")))
              .select(F.col("component").alias("cluster"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"),
                      "src", "dst"))
    tile = ["cluster", "lo", "hi"]
    members = (placed.select(*tile, F.col("src").alias("id"), F.col("dst").alias("partner"))
               .union(placed.select(*tile, "dst", F.lit(None).cast("long")))
               .groupBy(*tile, "id").agg(F.collect_set("partner").alias("partners")))  # within a block
    rows = _picked(docs, members, "id", "size(partners)").select(*tile, "id", "text", "partners")
    return rows.groupBy(*tile).applyInArrow(lambda t: _verify_tile(t, size, percent), "src bigint, dst bigint")


def ngram_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                     size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Words are what ASCII white space separates, A-Z lower-cased; a text of fewer
    than ``size`` words is one shingle.  component_id is the least id reachable by
    links (Jaccard >= percent / 100), itself included.  A null, empty or blank
    text has no shingles, no links and its own id.  A row with a null id keeps its
    n_shingles, links nothing and has a null component_id.  Rows that repeat an
    id are one node with the links of all its texts; each row is returned.  Other
    columns are not read.  No rows give no rows.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    K.small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(texts, size))
    sets = texts.mapInArrow(
        lambda it: _signature_rows(it, levels.value, size, percent),
        "id bigint, n bigint, sig binary, bands array<bigint>, prefix array<bigint>, n_light int, cells binary").checkpoint()

    # One row per distinct set; its least id stands for all its copies.
    reps = checkpointed(sets.where("sig is not null and id is not null").groupBy("sig").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("cells").alias("cells")))
    nodes = reps.select(F.col("rep").alias("node"), "sig", "n", "bands")
    clean = texts.where("id is not null")

    def groups(first: int, last: int) -> DataFrame:
        return nodes.select("node", "n", F.posexplode("bands").alias("band", "key")).where(
            f"band between {first} and {last}")

    g = groups(0, 0)
    members = g.join(g.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"),
                     ["band", "key"], "left_semi")
    edges = checkpointed(_block_edges(clean, members, size, percent))

    def labelled(df: DataFrame, found: DataFrame) -> DataFrame:
        comps = connected_components(found)
        return df.join(comps, df["node"] == comps["node"], "left").select(
            *(df[c] for c in df.columns), F.coalesce(comps["component"], df["node"]).alias("comp"))

    g = labelled(groups(1, BANDS - 1), edges)
    split = g.groupBy("band", "key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b")
    members = g.join(split, ["band", "key"], "left_semi").select("band", "key", "node", "n")
    edges = checkpointed(edges.union(_block_edges(clean, members, size, percent)))

    # Whole prefixes under the order by rarity.  A token of level 0 has a bounded
    # number of rows; others are aggregated before they are joined.
    marked = checkpointed(labelled(nodes, edges))
    whole = _picked(sets.select("id", "sig", "prefix", "n_light"),
                    marked.select("sig", F.col("node").alias("id"), "comp"), ["sig", "id"])
    entries = whole.select(F.posexplode("prefix").alias("pos", "token"), F.col("id").alias("node"), "comp", "n_light")
    w = Window.partitionBy("token")
    light = (entries.where("pos < n_light").withColumn("a", F.min("comp").over(w))
             .withColumn("b", F.max("comp").over(w)).where("a < b").select("token", "pos", "node"))
    heavy = entries.where("pos >= n_light")
    heavy = heavy.join(heavy.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
                       .where("a < b"), "token", "left_semi").select("token", "pos", "node")
    alive = light.union(heavy).join(marked.select("node", "n", "comp", "bands"), "node")
    x, y = alive.alias("x"), alive.alias("y")
    # Of the common tokens of a linked pair, the first leaves room in both sets for
    # an intersection of percent / (100 + percent) of both sizes.
    both_sizes = F.lit(percent) * (F.col("x.n") + F.col("y.n"))
    fits = ((F.lit(100 + percent) * (F.col("x.n") - F.col("x.pos")) >= both_sizes)
            & (F.lit(100 + percent) * (F.col("y.n") - F.col("y.pos")) >= both_sizes))
    apart = F.lit(True)
    for k in range(BANDS):
        apart = apart & (F.col("x.bands")[k] != F.col("y.bands")[k])
    pairs = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node"))
                    & (F.col("x.comp") != F.col("y.comp")) & fits & apart)
             .select(F.col("x.node").alias("src"), F.col("y.node").alias("dst")).distinct())
    cells = reps.select("rep", "n", "cells")
    both = (pairs.join(cells.select(F.col("rep").alias("src"), F.col("n").alias("n1"), F.col("cells").alias("c1")), "src")
            .join(cells.select(F.col("rep").alias("dst"), F.col("n").alias("n2"), F.col("cells").alias("c2")), "dst"))
    pairs = checkpointed(both.select("src", "dst", "n1", "n2", "c1", "c2").mapInArrow(
        lambda it: _close_cells(it, percent), "src bigint, dst bigint").distinct())
    rest = _pair_edges(clean, pairs, reps.select(F.col("rep").alias("node"), "n"), size, percent)
    comps = connected_components(edges.union(rest))

    out = sets.select("id", "n", "sig").join(reps.select("sig", "rep"), "sig", "left")
    out = out.join(comps, out["rep"] == comps["node"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
