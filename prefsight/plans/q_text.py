"""TXT-* queries over v_text_pairs (whole document texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefsight.operators import text as tx
from prefsight.plans import sql_fn as S
from prefsight.plans.registry import query
from prefsight.sources import views as V

VOCAB = 5000
MAX_LEN = 512
_CORPUS = """
SELECT pair_id AS key, 'prompt' AS field, prompt AS text FROM v_text_pairs
UNION ALL SELECT pair_id, 'chosen', chosen FROM v_text_pairs
UNION ALL SELECT pair_id, 'rejected', rejected FROM v_text_pairs
"""
_VOCAB_SQL = f"""
SELECT token, CAST(rk + 1 AS INTEGER) AS token_id, count FROM (
  SELECT token, count, row_number() OVER (ORDER BY count DESC, token) AS rk FROM (
    SELECT token, count(*) AS count FROM (SELECT unnest({S.tokens('text')}) AS token FROM corpus)
    GROUP BY token)) WHERE rk <= {VOCAB}
"""


@query("txt_render", """
SELECT pair_id, 'Prompt: ' || prompt || chr(10) || chr(10) || 'Response: ' || chosen AS chosen_text,
       'Prompt: ' || prompt || chr(10) || chr(10) || 'Response: ' || rejected AS rejected_text
FROM v_text_pairs
""")
def txt_render(t):
    """TXT-1: the rendered model inputs of both sides."""
    return tx.render_pairs(V.v_text_pairs(t))


@query("txt_vocab", f"WITH corpus AS ({_CORPUS}) {_VOCAB_SQL}")
def txt_vocab(t):
    """TXT-2: corpus vocabulary, top 5000 whitespace tokens with ids."""
    return tx.build_vocabulary(tx.texts_long(V.v_text_pairs(t)), size=VOCAB)


@query("txt_encode", f"""
WITH corpus AS ({_CORPUS}), vocab AS ({_VOCAB_SQL}),
toks AS (SELECT key, field, {S.tokens('text')} AS tk FROM corpus),
pos AS (SELECT key, field, unnest(tk) AS token, generate_subscripts(tk, 1) AS pos FROM toks),
ids AS (SELECT p.key, p.field, p.pos, coalesce(v.token_id, 1) AS token_id
        FROM pos p LEFT JOIN vocab v ON v.token = p.token WHERE p.pos <= {MAX_LEN})
SELECT c.key, c.field, CAST(count(i.pos) AS INTEGER) AS n_tokens,
       CAST(coalesce(sum(i.token_id), 0) AS BIGINT) AS id_sum,
       CAST(coalesce(sum(CASE WHEN i.token_id = 1 THEN 1 ELSE 0 END), 0) AS INTEGER) AS n_unk,
       CAST(coalesce(sum(i.token_id * i.pos), 0) AS BIGINT) AS id_weighted
FROM corpus c LEFT JOIN ids i ON i.key = c.key AND i.field = c.field
GROUP BY c.key, c.field
""")
def txt_encode(t):
    """TXT-2: fixed-length (512) encoding of every text; summarised by mask
    length, id sums and unknown-token count so the check sees every id."""
    corpus = tx.texts_long(V.v_text_pairs(t)).checkpoint()  # read by the vocabulary and the encoding
    vocab = tx.build_vocabulary(corpus, size=VOCAB)
    enc = tx.encode(corpus, vocab, max_length=MAX_LEN)
    ids, mask = F.col("input_ids"), F.col("attention_mask")
    weighted = F.aggregate(F.zip_with(ids, F.sequence(F.lit(1), F.lit(MAX_LEN)),
                                      lambda a, b: (a * b).cast("bigint")),
                           F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return enc.select(
        "key", "field", F.aggregate(mask, F.lit(0), lambda acc, x: acc + x).alias("n_tokens"),
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("id_sum"),
        F.size(F.filter(ids, lambda x: x == tx.UNK_ID)).alias("n_unk"),
        weighted.alias("id_weighted"))


@query("txt_length_filter", f"""
SELECT pair_id, CAST(len({S.tokens('prompt')}) AS INTEGER) AS prompt_tokens,
       CAST(len({S.tokens('chosen')}) AS INTEGER) AS chosen_tokens
FROM v_text_pairs
WHERE len({S.tokens('prompt')}) + least(len({S.tokens('chosen')}), {MAX_LEN}) < {MAX_LEN}
""")
def txt_length_filter(t):
    """TXT-3: keep pairs whose prompt + clipped chosen fit in 512 tokens."""
    return tx.length_filter(V.v_text_pairs(t), MAX_LEN).select("pair_id", "prompt_tokens",
                                                               "chosen_tokens")


@query("txt_length_profile", f"""
WITH corpus AS ({_CORPUS}), l AS (SELECT field, CAST(length(text) AS DOUBLE) AS length FROM corpus)
SELECT field, count(*) AS count, avg(length) AS mean, stddev_samp(length) AS std, min(length) AS min,
       quantile_cont(length, 0.25) AS p25, quantile_cont(length, 0.5) AS p50,
       quantile_cont(length, 0.75) AS p75, max(length) AS max
FROM l GROUP BY field
""", rnd=["mean", "std", "min", "p25", "p50", "p75", "max"])
def txt_length_profile(t):
    """TXT-4: character-length profile per field."""
    return tx.length_profile(V.v_text_pairs(t))


@query("txt_batches", f"""
WITH r AS (SELECT pair_id, row_number() OVER (ORDER BY {S.hash_key(42, 'pair_id')}, pair_id) - 1 AS position,
                  count(*) OVER () AS n FROM v_pool)
SELECT pair_id, position, position // 32 AS batch_id FROM r WHERE position // 32 < n // 32
""")
def txt_batches(t):
    """TXT-5: shuffled fixed-size batches of 32, last partial batch dropped."""
    return tx.shuffle_batches(V.v_pool(t), "pair_id", 32).select("pair_id", "position", "batch_id")
