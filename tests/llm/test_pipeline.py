from pyspark.sql import functions as F

import corpus_pipeline as P
from prefsight.llm import op6_merge_dropout as M
from prefsight.llm import queries as Q
from prefsight.llm.op5_toxicity import score_toxicity, train_toxicity

from .test_op8_op10 import brute8, brute10


def test_stages_keep_what_they_should(spark, sf):
    docs = Q.table(spark, sf, "documents")
    rows = [r.asDict() for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in Q.table(spark, sf, "benchmark").collect()]
    model = train_toxicity(docs, Q.table(spark, sf, "labels"), ~Q.toxicity_held_out())
    bad = {r["doc_id"] for r in score_toxicity(docs, model, keep=["doc_id"]).where("predicted = 1").collect()}
    kept = [r for r in rows if r["doc_id"] not in bad]
    leaders = {i for i, _, c in brute10([(r["doc_id"], r["text"]) for r in kept]) if i == c}
    kept = [r for r in kept if r["doc_id"] in leaders]
    kept = [r for r in kept if not brute8(r["text"], items)[4]]
    got = {r["doc_id"]: r for r in P.run(spark, sf).collect()}
    assert got.keys() == {r["doc_id"] for r in kept} and 0 < len(got) < len(rows)
    pieces = M.Pieces(M.read_model())
    for r in kept:
        mine = got[r["doc_id"]]
        assert all(mine[c] == r[c] for c in r) and mine["lossless"]
        assert M.decode(pieces, mine["piece_ids"]) == (r["text"] or "")


def test_stages_on_edge_cases(spark, sf, texts):
    rows = [(i, t, "en", "s", 1) for i, t in texts[-15:]] + [(None, "no id here", "en", "s", 1), (None, "no id here", "en", "s", 1),
                                                              (1_000_004, "one two  THREE", "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids.count(None) == 2 and ids.count(1_000_004) == 1 and 1_000_005 not in ids and 10**6 in ids
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert docs.where(F.col("doc_id") == 1_000_004).first()["lang"] == "en"


def test_stages_keep_columns_named_like_results(spark, sf):
    names = ["score", "predicted", "offending", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
             "component_id", "n_shingles"]
    body = " ".join(f"word{i}" for i in range(40))
    rows = [(1, body, *["mine"] * len(names), 5), (2, "other words here", *["yours"] * len(names), 6), (3, None, *[None] * len(names), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names) + ", n_pieces int")
    for _, stage in P.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)
    last = P.STAGES[3][1](spark, docs, sf)
    assert {r["doc_id"]: (r["n_pieces_input"], r["score"]) for r in last.collect()} == {1: (5, "mine"), 2: (6, "yours"), 3: (7, None)}
