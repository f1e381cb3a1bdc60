"""Preference-data sources and sinks (SRC-*).

Readers dispatch on the path's extension and rename the three text columns
(and an optional margin) to the standard names; writers follow the dataset
naming rule.  Validation never raises per row: bad rows go to a reject table
with a reason, good rows continue.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from prefsight.functions import hash_key

STANDARD = ("prompt", "chosen", "rejected")

# CSV texts hold newlines and doubled quotes (RFC 4180, as pandas writes them).
# The writer must not trim leading / trailing whitespace of texts.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_preferences(spark: SparkSession, path: str, prompt_col="prompt", chosen_col="chosen",
                     rejected_col="rejected", margin_col: str | None = "margin",
                     multi_line: bool = False, schema=None) -> DataFrame:
    """SRC-1: read parquet / json / jsonl / csv by extension; anything else raises.

    ``.json`` is read as JSON lines (what our sink writes); pass
    ``multi_line=True`` for one JSON document per file."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if suffix == ".parquet":
        df = reader.parquet(path)
    elif suffix in (".json", ".jsonl"):
        df = reader.option("multiLine", str(multi_line).lower()).json(path)
    elif suffix == ".csv":
        df = reader.options(**CSV_OPTIONS).csv(path)
    else:
        raise ValueError(f"Unsupported format: {suffix}")
    mapping = {prompt_col: "prompt", chosen_col: "chosen", rejected_col: "rejected"}
    require_columns(df, list(mapping))
    if margin_col and margin_col in df.columns:
        mapping[margin_col] = "margin"
    return select_standard(df, mapping, keep_others=True)


def require_columns(df: DataFrame, required) -> None:
    """SRC-2: raise ValueError naming every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def select_standard(df: DataFrame, mapping: dict, keep_others: bool = False) -> DataFrame:
    """SRC-4: rename source columns to the standard names (select + alias)."""
    require_columns(df, list(mapping))
    cols = [F.col(src).alias(dst) for src, dst in mapping.items()]
    if keep_others:
        cols += [F.col(c) for c in df.columns if c not in mapping and c not in mapping.values()]
    return df.select(*cols)


def _bad_text(c: str):
    return F.col(c).isNull() | (F.length(F.col(c)) == 0)


def tag_errors(df: DataFrame) -> DataFrame:
    """SRC-3: add ``error`` (NULL for a valid pair, else the first reason).

    NULL or empty texts are rejected (whitespace-only is accepted, as in the
    reference); a margin that is present but not numeric is rejected."""
    reasons = [F.when(_bad_text(c), F.lit(f"{c} must be a non-empty string")) for c in STANDARD]
    if "margin" in df.columns:
        m = F.col("margin")
        numeric = m.try_cast("double") if hasattr(m, "try_cast") else F.expr("try_cast(margin AS double)")
        reasons.append(F.when(m.isNotNull() & numeric.isNull(), F.lit("margin must be numeric")))
    return df.withColumn("error", F.coalesce(*reasons))


def validate_pairs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-3: split into (valid, rejected-with-reason) -- two filters of one
    tagged frame (write both from ``foreachBatch`` or cache when reused)."""
    tagged = tag_errors(df)
    valid = tagged.filter(F.col("error").isNull()).drop("error")
    if "margin" in df.columns:
        valid = valid.withColumn("margin", F.col("margin").cast("double"))
    return valid, tagged.filter(F.col("error").isNotNull())


def lookup(df: DataFrame, key_col: str, key) -> DataFrame:
    """SRC-5: the pair with a given key; margin is NULL without a margin column."""
    out = df.filter(F.col(key_col) == F.lit(key))
    if "margin" not in out.columns:
        out = out.withColumn("margin", F.lit(None).cast("double"))
    return out


def sample_exact(df: DataFrame, n: int | None, key_col: str, seed: int = 42) -> DataFrame:
    """SRC-6: exactly n rows chosen by a keyed hash order (all rows when the table
    is not larger than n, or n is None/0).

    Rows get their place in the order of (hash, key) on keys alone, spread over
    range partitions, and the table is joined with the first n places; n may be
    as large as the table."""
    from prefsight.operators.indexing import global_index
    if not n:
        return df
    places = global_index(df.select(key_col, hash_key(seed, key_col).alias("_h")), ["_h", key_col], "_place")
    return df.join(places.filter(F.col("_place") < n).select(key_col), key_col, "left_semi")


def split_column(key_col: str, seed: int = 42, fractions=(0.8, 0.1, 0.1),
                 names=("train", "validation", "test")):
    """SRC-7: deterministic split label from a keyed hash bucket in [0, 1)."""
    u = (F.pmod(hash_key(seed, key_col), F.lit(1_000_000)) / F.lit(1_000_000.0))
    bounds, acc = [], 0.0
    for f in fractions[:-1]:
        acc += f
        bounds.append(acc)
    expr = None
    for b, name in zip(bounds, names):
        expr = F.when(u < F.lit(b), F.lit(name)) if expr is None else expr.when(u < F.lit(b), F.lit(name))
    return expr.otherwise(F.lit(names[len(bounds)]))


def split(df: DataFrame, key_col: str, seed: int = 42, fractions=(0.8, 0.1, 0.1)) -> DataFrame:
    return df.withColumn("split", split_column(key_col, seed, fractions))


def dataset_filename(name: str, split_name: str, max_samples: int | None, fmt: str) -> str:
    """SRC-8 naming rule: ``{name}_{split}[_{n//1000}k]`` plus the exact count
    when n is not a multiple of 1000 (so n < 1000 does not read as 0k)."""
    stem = f"{name}_{split_name}"
    if max_samples:
        stem += f"_{max_samples // 1000}k"
        if max_samples % 1000:
            stem += f"{max_samples % 1000}"
    ext = {"parquet": "parquet", "json": "json", "csv": "csv"}.get(fmt, "csv")
    return f"{stem}.{ext}"


def write_dataset(df: DataFrame, out_dir: str, name: str, split_name: str = "train",
                  max_samples: int | None = None, fmt: str = "parquet",
                  mode: str = "overwrite") -> str:
    """SRC-8 / SRC-12: write parquet, JSON lines (under .json) or CSV."""
    path = f"{out_dir.rstrip('/')}/{dataset_filename(name, split_name, max_samples, fmt)}"
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.options(**CSV_OPTIONS).csv(path)
    return path


PAIR_JSON_SCHEMA = ("prompt string, chosen string, rejected string, margin double, "
                    "metadata map<string,string>")


def pairs_to_json(df: DataFrame, key_col: str | None = None) -> DataFrame:
    """SRC-9: one JSON object per pair (prompt, chosen, rejected, margin, metadata)."""
    md = F.col("metadata") if "metadata" in df.columns else F.create_map().cast(
        MapType(StringType(), StringType()))
    margin = F.col("margin") if "margin" in df.columns else F.lit(None).cast("double")
    obj = F.to_json(F.struct("prompt", "chosen", "rejected", margin.alias("margin"),
                             md.alias("metadata")))
    keep = [key_col] if key_col else []
    return df.select(*keep, obj.alias("json"))


def pairs_from_json(df: DataFrame, json_col: str = "json", keep=()) -> DataFrame:
    """SRC-9: parse back; missing margin -> NULL, missing metadata -> empty map."""
    p = F.from_json(F.col(json_col), PAIR_JSON_SCHEMA)
    return df.select(*keep, p.alias("_p")).select(
        *keep, "_p.prompt", "_p.chosen", "_p.rejected", "_p.margin",
        F.coalesce(F.col("_p.metadata"), F.create_map().cast(MapType(StringType(), StringType())))
        .alias("metadata"))


# The demo-dataset prompts and answer patterns of the reference.
DEMO_PROMPTS = [
    "What is machine learning?",
    "Explain quantum computing.",
    "How does photosynthesis work?",
    "What causes earthquakes?",
    "Describe the water cycle.",
    "What is artificial intelligence?",
    "How do vaccines work?",
    "Explain climate change.",
    "What is blockchain?",
    "How does the internet work?",
]
DEMO_GOOD = [
    "{topic} is a complex process that involves multiple factors. Let me explain in detail...",
    "Great question! {topic} can be understood by breaking it down into key components...",
    "To understand {topic}, we need to consider the underlying principles...",
]
DEMO_BAD = [
    "I don't know much about {topic}.",
    "{topic} is complicated. Google it.",
    "That's a hard question about {topic}. Maybe ask someone else.",
]


def demo_pairs(keys: DataFrame, key_col: str, seed: int = 42) -> DataFrame:
    """SRC-10: one synthetic demo pair per key row; keyed hashes replace the
    unseeded random choices, so the result is reproducible."""
    def pick(options, salt):
        arr = F.array(*[F.lit(o) for o in options])
        return F.element_at(arr, (F.pmod(hash_key(seed, key_col, F.lit(salt)),
                                         F.lit(len(options))) + 1).cast("int"))
    prompt = pick(DEMO_PROMPTS, "prompt")
    topic = F.replace(F.replace(F.replace(F.lower(prompt), F.lit("?"), F.lit("")),
                                F.lit("what is "), F.lit("")), F.lit("how does "), F.lit(""))
    good = F.replace(pick(DEMO_GOOD, "good"), F.lit("{topic}"), topic)
    bad = F.replace(pick(DEMO_BAD, "bad"), F.lit("{topic}"), topic)
    return keys.select(F.col(key_col).alias("pair_id"), prompt.alias("prompt"),
                       good.alias("chosen"), bad.alias("rejected"))


#: What names one run in the results store.
RUN_KEYS = ("optimizer", "seed")


def write_results(runs: DataFrame, path: str, mode: str = "upsert") -> str:
    """SRC-11: results store with one folder per run (optimizer, seed).

    Writing a run again replaces its folder and leaves the others (dynamic partition
    overwrite), so a comparison can be rerun or resumed; ``mode="append"`` adds rows."""
    if mode == "upsert":
        writer = runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = runs.write.mode(mode)
    writer.partitionBy(*RUN_KEYS).parquet(path)
    return path


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a store; the seed is an integer, the optimizer a string."""
    runs = spark.read.parquet(path)
    return runs.withColumn("optimizer", F.col("optimizer").cast("string")).withColumn("seed", F.col("seed").cast("int"))
