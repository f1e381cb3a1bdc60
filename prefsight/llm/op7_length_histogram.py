"""Exact histogram of encoded lengths, and what every context limit cuts.

Texts are counted by their number of tokens, in the tasks; the histogram (one row
per length that occurs) is all that is shuffled.  Suffix sums over it answer, for
any limit, how many texts are longer, how many tokens remain after truncation and
which share of the texts fits.  Between two rows the answers are linear in the
limit, so the rows are a complete table of answers: ``at_limits`` reads it.

The sums run in two steps, inside ranges of ``RANGE`` lengths and over the ranges,
so no task holds the histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefsight.llm import kernels as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer cuts text into words (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RANGE = 1024

_encoders: dict[int, object] = {}


def encoder(ranks: bytes):
    """The byte-pair encoder of a rank file, made once per worker."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def _length_rows(batches: Iterator[pa.RecordBatch], ranks: bytes):
    encode = encoder(ranks).encode_ordinary
    counts: dict[int, int] = {}
    for _, texts in K.text_chunks(batches):
        for t in texts:
            n = len(encode(t.decode("utf-8"))) if t else 0
            counts[n] = counts.get(n, 0) + 1
    lengths = np.array(sorted(counts), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array([counts[n] for n in lengths.tolist()], pa.int64())],
                                     names=["n_tokens", "n"])


def length_counts(docs: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): texts by encoded length; a null or empty text has length 0."""
    K.small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:  # below a megabyte
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    return (docs.select(F.col(text).cast("string").alias("text"))
            .mapInArrow(lambda it: _length_rows(it, ranks.value), "n_tokens bigint, n bigint")
            .groupBy("n_tokens").agg(F.sum("n").alias("n_docs")))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For every length that occurs, as a context limit, the exact totals.

    n_docs and n_tokens_here are the texts of that length and their tokens;
    n_longer the texts above the limit; kept_tokens the total if all texts are
    truncated to the limit; cut_tokens the rest; fitting the share of texts that
    are not cut (a quantile q is the least length with fitting >= q); total_docs
    and total_tokens are those of the corpus.  No rows give no rows.
    """
    ranged = counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n_tokens_here"),
                           F.floor(F.col("n_tokens") / RANGE).alias("__range")).checkpoint()
    whole = ranged.groupBy("__range").agg(F.sum("n_docs").alias("__d"), F.sum("n_tokens_here").alias("__t"))
    above = Window.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per range of lengths: the longest text over RANGE rows at most.
    whole = whole.select("__range", F.coalesce(F.sum("__d").over(above), F.lit(0)).alias("__d_above"),
                         F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__t_above"),
                         F.sum("__d").over(every).alias("total_docs"), F.sum("__t").over(every).alias("total_tokens"))
    inside = (Window.partitionBy("__range").orderBy(F.col("n_tokens").desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = (ranged.withColumn("__d_in", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
            .withColumn("__t_in", F.coalesce(F.sum("n_tokens_here").over(inside), F.lit(0)))
            .join(whole, "__range"))
    longer, tokens_longer = F.col("__d_above") + F.col("__d_in"), F.col("__t_above") + F.col("__t_in")
    cut = tokens_longer - longer * F.col("n_tokens")
    return rows.select("n_tokens", "n_docs", "n_tokens_here", longer.alias("n_longer"),
                       (F.col("total_tokens") - cut).alias("kept_tokens"), cut.alias("cut_tokens"),
                       ((F.col("total_docs") - longer) / F.col("total_docs")).alias("fitting"),
                       "total_docs", "total_tokens")


def at_limits(answers: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, n_longer, kept_tokens) for any limits, from the rows of ``suffix_sums``.

    A limit below the least length cuts every text to the limit.
    """
    # The stated limits are few: each row is compared with all of them.
    picks = [F.max(F.when(F.col("n_tokens") <= x, F.struct("n_tokens", "n_longer", "kept_tokens"))).alias(f"l{i}")
             for i, x in enumerate(limits)]
    best = answers.agg(F.max("total_docs").alias("d"), *picks).first()
    rows = []
    for i, x in enumerate(limits):
        r = best[f"l{i}"]
        rows.append((x, r["n_longer"], r["kept_tokens"] + (x - r["n_tokens"]) * r["n_longer"]) if r else
                    (x, best["d"] or 0, x * (best["d"] or 0)))
    return answers.sparkSession.createDataFrame(rows, "limit bigint, n_longer bigint, kept_tokens bigint")
