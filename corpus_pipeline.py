"""The corpus pipeline: four stages over ``documents``.

1. ``toxicity``: documents that the multiple-instance model rejects go.
2. ``ngram_join``: one document of each group of near copies stays, the one with
   the least id; rows that repeat an id count as copies.
3. ``decontaminate``: documents that hold a window of a benchmark item go.
4. ``merge_dropout``: the rest is encoded, with its piece ids.

Each stage gets what its predecessor kept, written as Parquet and reread, and all
but the last return the columns of ``documents``.  A null or empty text is not
toxic, has no copies and no windows, and stays with no pieces; a null id is no
copy of anything.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefsight.llm.op5_toxicity import score_toxicity, train_toxicity
from prefsight.llm.op6_merge_dropout import encode_pieces
from prefsight.llm.op8_decontaminate import decontaminate
from prefsight.llm.op10_ngram_join import BROADCAST_ROWS, ngram_components
from prefsight.llm.queries import table, toxicity_held_out
from prefsight.session import checkpointed, ensure_checkpoint_dir, scratch_path


def _set_aside(docs: DataFrame, results: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns that have names of results renamed, and their new names."""
    names = {c: f"__input_{i}" for i, c in enumerate(docs.columns) if c in results}
    return docs.withColumnsRenamed(names) if names else docs, names


def _restored(rows: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``docs``, with those set aside under their own names again."""
    return rows.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold of rejection, with all their columns.

    A null or empty text scores 0 and stays; rows that repeat another are judged alike;
    no rows give no rows.  Columns named like a score keep their values."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), ~toxicity_held_out())
    rows, names = _set_aside(docs, ("score", "predicted", "offending"))
    return _restored(score_toxicity(rows, model, keep=rows.columns).where("predicted = 0"), docs, names)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard 0.8 or more connect, with all its columns.

    The least id of a group stays.  A null id or a text without words is in no group and
    stays; of rows that repeat an id the first in the order of their columns stays; no
    rows give no rows.  Columns of any other name are only carried."""
    ensure_checkpoint_dir(spark)
    found = checkpointed(ngram_components(docs).where("doc_id is not null").groupBy("doc_id").agg(
        F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")))

    def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
        small = ids.count() <= BROADCAST_ROWS
        return rows.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti")
    kept = without(docs, found.where("component_id <> doc_id").select("doc_id"))
    repeated = found.where("component_id = doc_id and n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    # Rows that repeat an id: the first in the order of their columns.
    again = kept.join(repeated, "doc_id", "left_semi")
    order = F.struct(*(F.col(c) for c in docs.columns))
    one = again.groupBy("doc_id").agg(F.min(order).alias("r")).select("r.*")
    return without(kept, repeated).union(one.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window, with all their columns.

    A null or empty text has no window and stays; repeated rows are judged alike; no
    rows give no rows.  Columns named like a count keep their values."""
    rows, names = _set_aside(docs, ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    rows = rows.withColumn("__body", F.col("text"))
    checked = decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=[c for c in rows.columns if c != "text"])
    return _restored(checked.where("not contaminated").withColumnRenamed("__body", "text"), docs, names)


def merge_dropout(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns with n_pieces, piece_ids and lossless of the text.

    A null or empty text has no pieces; repeated rows get the same ones; no rows give no
    rows.  A column with the name of a result is returned as ``<name>_input``."""
    results = ("n_pieces", "piece_ids", "lossless")
    rows = docs.withColumnsRenamed({c: f"{c}_input" for c in docs.columns if c in results})
    return encode_pieces(rows, keep=rows.columns)


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("decontaminate", decontamination),
          ("merge_dropout", merge_dropout)]

#: A trained classifier and a keyed dropout are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
