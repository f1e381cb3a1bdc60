"""SRC-* queries: round trips through the sinks, validation, sampling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefsight.functions import hash_key
from prefsight.operators.indexing import global_index
from prefsight.plans import sql_fn as S
from prefsight.plans.registry import query
from prefsight.session import scratch_path
from prefsight.sources import io
from prefsight.sources import views as V

PAIR_SCHEMA = "pair_id bigint, prompt string, chosen string, rejected string, margin double"


@query("src_read_roundtrip", """
SELECT f.format, pair_id, prompt, chosen, rejected, margin
FROM v_text_pairs, (VALUES ('parquet'), ('json'), ('csv')) f(format)
""", rnd=["margin"])
def src_read_roundtrip(t):
    """SRC-1: write v_text_pairs as parquet, JSON lines and CSV, read each back
    through the extension-dispatching reader; texts must survive unchanged."""
    spark = t.spark
    pairs = V.v_text_pairs(t)
    base = scratch_path(spark, "roundtrip")
    parts = []
    for fmt in ("parquet", "json", "csv"):
        path = io.write_dataset(pairs, base, "text_pairs", "train", None, fmt)
        back = io.read_preferences(spark, path, schema=None if fmt == "parquet" else PAIR_SCHEMA)
        parts.append(back.select(F.lit(fmt).alias("format"), "pair_id", "prompt", "chosen",
                                 "rejected", F.col("margin").cast("double").alias("margin")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("src_validate", """
SELECT pair_id, CASE
  WHEN prompt IS NULL OR length(prompt) = 0 THEN 'prompt must be a non-empty string'
  WHEN chosen IS NULL OR length(chosen) = 0 THEN 'chosen must be a non-empty string'
  WHEN rejected IS NULL OR length(rejected) = 0 THEN 'rejected must be a non-empty string'
  END AS error
FROM v_reject
""")
def src_validate(t):
    """SRC-3: validation with quarantine; error is NULL for accepted rows."""
    return io.tag_errors(V.v_reject(t)).select("pair_id", "error")


@query("src_rename", """
SELECT pair_id, history AS prompt, human_ref_A AS chosen, human_ref_B AS rejected FROM v_ab
""")
def src_rename(t):
    """SRC-4: map source columns onto prompt / chosen / rejected."""
    return io.select_standard(V.v_ab(t), {"pair_id": "pair_id", "history": "prompt",
                                          "human_ref_A": "chosen", "human_ref_B": "rejected"})


@query("src_lookup", """
SELECT pair_id, prompt, chosen, rejected, margin FROM v_text_pairs ORDER BY pair_id LIMIT 1 OFFSET 3
""", rnd=["margin"])
def src_lookup(t):
    """SRC-5: the pair at position 3 in key order."""
    pairs = V.v_text_pairs(t)
    place = io.lookup(global_index(pairs.select("pair_id"), ["pair_id"], "position"), "position", 3)
    return pairs.join(F.broadcast(place.select("pair_id")), "pair_id").select(
        "pair_id", "prompt", "chosen", "rejected", "margin")


@query("src_sample", f"""
SELECT pair_id, prompt FROM v_pool ORDER BY {S.hash_key(42, 'pair_id')}, pair_id LIMIT 1000
""")
def src_sample(t):
    """SRC-6: exact-size (1000) seeded sample of the pool."""
    return io.sample_exact(V.v_pool(t), 1000, "pair_id", 42).select("pair_id", "prompt")


@query("src_split", f"""
SELECT pair_id, CASE WHEN u < 0.8e0 THEN 'train' WHEN u < 0.9e0 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT pair_id, ({S.hash_key(42, 'pair_id')} % 1000000) / 1000000.0e0 AS u FROM v_pool)
""")
def src_split(t):
    """SRC-7: deterministic 0.8 / 0.1 / 0.1 split by keyed hash."""
    return io.split(V.v_pool(t), "pair_id").select("pair_id", "split")


@query("src_write", f"""
SELECT f.file, f.format, count(*) AS rows, CAST(sum(length(prompt) + length(chosen) + length(rejected)) AS BIGINT) AS chars,
       sum(margin) AS margin_sum, CAST(bit_xor({S.hash_key(0, 'prompt', 'chosen', 'rejected')}) AS BIGINT) AS content
FROM v_text_pairs, (VALUES ('text_pairs_train.parquet', 'parquet'), ('text_pairs_train.json', 'json'),
                           ('text_pairs_train.csv', 'csv')) f(file, format)
GROUP BY f.file, f.format
""", rnd=["margin_sum"])
def src_write(t):
    """SRC-8 / SRC-12: write the whole table in three formats under the dataset
    naming rule; reports rows, characters and a content hash of what is read back."""
    spark = t.spark
    base = scratch_path(spark, "datasets")
    pairs = V.v_text_pairs(t).select("pair_id", "prompt", "chosen", "rejected", "margin").checkpoint()
    rows = []
    for fmt in ("parquet", "json", "csv"):
        path = io.write_dataset(pairs, base, "text_pairs", "train", None, fmt)
        back = io.read_preferences(spark, path, schema=None if fmt == "parquet" else PAIR_SCHEMA)
        rows.append(back.select(F.lit(path.rsplit("/", 1)[-1]).alias("file"), F.lit(fmt).alias("format"), "margin",
                                (F.length("prompt") + F.length("chosen") + F.length("rejected")).alias("n"),
                                hash_key(0, "prompt", "chosen", "rejected").alias("h")))
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.groupBy("file", "format").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").cast("bigint").alias("chars"),
        F.sum("margin").alias("margin_sum"), F.bit_xor("h").alias("content"))


@query("src_json_roundtrip", """
SELECT pair_id, prompt, chosen, rejected, margin, CAST(0 AS INTEGER) AS metadata_size FROM v_text_pairs
""", rnd=["margin"])
def src_json_roundtrip(t):
    """SRC-9: pairs -> JSON objects -> pairs (missing metadata -> empty map)."""
    js = io.pairs_to_json(V.v_text_pairs(t), "pair_id")
    back = io.pairs_from_json(js, keep=["pair_id"])
    return back.select("pair_id", "prompt", "chosen", "rejected", "margin",
                       F.size("metadata").alias("metadata_size"))


def _list_sql(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_PROMPT_SQL = f"{_list_sql(io.DEMO_PROMPTS)}[{S.hash_key(42, 'o_orderkey', chr(39) + 'prompt' + chr(39))} % 10 + 1]"
_TOPIC_SQL = "replace(replace(replace(lower(prompt), '?', ''), 'what is ', ''), 'how does ', '')"


@query("src_demo", f"""
WITH p AS (SELECT o_orderkey, {_PROMPT_SQL} AS prompt,
                  {_list_sql(io.DEMO_GOOD)}[{S.hash_key(42, 'o_orderkey', "'good'")} % 3 + 1] AS g,
                  {_list_sql(io.DEMO_BAD)}[{S.hash_key(42, 'o_orderkey', "'bad'")} % 3 + 1] AS b
           FROM orders)
SELECT o_orderkey AS pair_id, prompt, replace(g, '{{topic}}', {_TOPIC_SQL}) AS chosen,
       replace(b, '{{topic}}', {_TOPIC_SQL}) AS rejected FROM p
""")
def src_demo(t):
    """SRC-10: one reproducible demo pair per order key."""
    return io.demo_pairs(t.orders, "o_orderkey")


@query("cmp_store", """
SELECT optimizer, count(*) AS runs, avg(final_val_accuracy) AS mean_accuracy FROM v_runs GROUP BY optimizer
""", rnd=["mean_accuracy"])
def cmp_store(t):
    """SRC-11: write run results, write them all again and one optimizer a third time,
    and read back one copy of each run."""
    spark = t.spark
    path = scratch_path(spark, "results")
    runs = V.v_runs(t)
    io.write_results(runs.withColumn("final_val_accuracy", F.lit(-1.0)), path)  # replaced below
    io.write_results(runs, path)
    io.write_results(runs.where("optimizer = 'adam'"), path)
    return io.load_results(spark, path).groupBy("optimizer").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("final_val_accuracy").alias("mean_accuracy"))
