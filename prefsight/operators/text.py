"""Text rendering, vocabulary, encoding, length work and batching (TXT-*).

The pretrained sub-word tokenizer is replaced by a corpus vocabulary job:
whitespace tokens are counted with a partial-aggregated groupBy, the top-V
tokens get ids, and texts are encoded by joining their first ``max_length``
token positions against that (size-bounded, broadcast) vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefsight.functions import hash_key
from prefsight.operators.indexing import global_index

# The reference's rendering of a (prompt, response) pair.
RENDER_PREFIX = "Prompt: "
RENDER_SEPARATOR = "\n\nResponse: "

PAD_ID, UNK_ID = 0, 1
# Whitespace class spelled out so the JVM and RE2 (the oracle) agree.
WS_CLASS = "[ \\t\\n\\r\\f\\x0B]+"
MAX_VOCAB = 200_000  # broadcast bound for the vocabulary table


def render(prompt: Column, response: Column) -> Column:
    """TXT-1: ``Prompt: {p}\\n\\nResponse: {r}``."""
    return F.concat(F.lit(RENDER_PREFIX), prompt, F.lit(RENDER_SEPARATOR), response)


def render_pairs(df: DataFrame, keep=("pair_id",)) -> DataFrame:
    return df.select(*keep, render(F.col("prompt"), F.col("chosen")).alias("chosen_text"),
                     render(F.col("prompt"), F.col("rejected")).alias("rejected_text"))


def tokens(text: Column) -> Column:
    """Whitespace tokens without empty strings."""
    return F.filter(F.split(text, WS_CLASS), lambda x: F.length(x) > 0)


def texts_long(df: DataFrame, key_col="pair_id", fields=("prompt", "chosen", "rejected")):
    """One row per (key, field, text) -- the corpus the vocabulary is built on.

    A single scan emits the fields through one generator (a union of one
    select per field would evaluate the input plan once per field)."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return df.select(F.col(key_col).alias("key"), F.inline(rows))


def build_vocabulary(corpus: DataFrame, text_col="text", size: int = 5000) -> DataFrame:
    """TXT-2: top-``size`` tokens by (count desc, token asc) with ids from 2.

    Counting is a partial aggregate; the top-V cut is TakeOrderedAndProject
    (each task keeps V rows), so only V rows are ranked in the final step."""
    if size > MAX_VOCAB:
        raise ValueError(f"vocabulary size {size} exceeds the broadcast bound {MAX_VOCAB}")
    counts = corpus.select(F.explode(tokens(F.col(text_col))).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.col("count").desc(), F.col("token").asc()).limit(size)
    # numbering runs over at most ``size`` (<= MAX_VOCAB) rows, so a window
    # without partitioning is bounded by the vocabulary, not by the corpus
    w = Window.orderBy(F.col("count").desc(), F.col("token").asc())
    return top.select("token", (F.row_number().over(w) + 1).cast("int").alias("token_id"), "count")


def encode_positions(corpus: DataFrame, vocab: DataFrame, key_cols=("key", "field"),
                     text_col="text", max_length: int = 512) -> DataFrame:
    """Token ids of the first ``max_length`` positions, one row per position; a text
    without tokens keeps one row with a null position."""
    head = F.slice(tokens(F.col(text_col)), 1, max_length)
    pos = corpus.select(*key_cols, F.posexplode_outer(head).alias("pos", "token"))
    j = pos.join(F.broadcast(vocab.select("token", "token_id")), "token", "left")
    return j.select(*key_cols, "pos", F.when(F.col("pos").isNotNull(), F.coalesce("token_id", F.lit(UNK_ID))).alias("token_id"))


def encode(corpus: DataFrame, vocab: DataFrame, key_cols=("key", "field"), text_col="text",
           max_length: int = 512) -> DataFrame:
    """TXT-2: fixed-length ids (truncate, pad with 0) and the 1/0 attention mask.

    The per-text collect is bounded by ``max_length`` positions."""
    key_cols = list(key_cols)
    p = encode_positions(corpus, vocab, key_cols, text_col, max_length)
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id"))  # collect_list leaves nulls out
    g = p.groupBy(*key_cols).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    n = F.size("_s")
    ids = F.concat(F.transform("_s", lambda s: s["token_id"]), F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
    return g.select(*key_cols, ids.alias("input_ids"), mask.alias("attention_mask"))


def length_filter(df: DataFrame, max_length: int = 512) -> DataFrame:
    """TXT-3: keep pairs with len(prompt) + min(len(chosen), max_length) < max_length
    in whitespace tokens (strict; rejected not counted; clip on chosen only)."""
    lp = F.size(tokens(F.col("prompt")))
    lc = F.size(tokens(F.col("chosen")))
    keep = (lp + F.least(lc, F.lit(max_length))) < max_length
    return df.withColumn("prompt_tokens", lp).withColumn("chosen_tokens", lc).filter(keep)


def length_profile(df: DataFrame, key_col="pair_id", fields=("prompt", "chosen", "rejected")):
    """TXT-4: count / mean / sample std / min / quartiles / max of character
    lengths per field (pandas ``describe``); exact quartiles, no value buffer."""
    from prefsight.operators.margins import exact_quantiles
    long = texts_long(df, key_col, fields).select(
        "key", "field", F.length("text").cast("double").alias("length"))
    basic = long.groupBy("field").agg(
        F.count(F.lit(1)).alias("count"), F.avg("length").alias("mean"),
        F.stddev_samp("length").alias("std"), F.min("length").alias("min"),
        F.max("length").alias("max"))
    q = exact_quantiles(long, ["field"], "length")
    return basic.join(q, "field").select("field", "count", "mean", "std", "min", "p25", "p50",
                                         "p75", "max")


def shuffle_batches(df: DataFrame, key_col: str, batch_size: int, seed: int = 42,
                    drop_last: bool = True) -> DataFrame:
    """TXT-5: keyed-hash shuffle, then batch_id = position // batch_size; the
    last partial batch is dropped when ``drop_last``."""
    h = df.withColumn("_h", hash_key(seed, key_col))
    idx = global_index(h, ["_h", key_col], "position").drop("_h")
    out = idx.withColumn("batch_id", (F.col("position") / batch_size).cast("bigint"))
    if drop_last:
        n = df.count()
        out = out.filter(F.col("batch_id") < F.lit(n // batch_size))
    return out
