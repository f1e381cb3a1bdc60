"""Toxicity by multiple-instance learning over sentences.

A text is a bag of sentences; only the bag has a label.  A sentence scores
``s = sigmoid(b + sum of the weights of its features)`` and the text is toxic if
any sentence is (noisy-or): ``1 - prod(1 - s)``.  Weights are trained on the
labels of texts by gradient descent through the noisy-or; a positive text sends
its gradient to the sentences that explain it, which are then found by ``s``.

Features are words and their beginnings (``PREFIXES`` bytes), so that inflected and
compounded forms count.  The fit uses at most ``per_class`` labelled texts of
each class (the lowest hashes of the id) and keeps the ``n_features`` features
whose rates differ most between them; every text is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefsight.llm import kernels as K

PER_CLASS = 4_000
N_FEATURES = 20_000
THRESHOLD = 0.7
#: A sentence is offending if its own score is at least this.
SENTENCE_THRESHOLD = 0.5
PREFIXES = (4, 5, 6, 7, 8, 10)
#: Least root of the likelihood ratio (a z-score) of a feature that is used.
SIGNIFICANT = 4.5
STEPS = 150
L2 = 3e-6
_STOPS = np.zeros(256, bool)
_STOPS[[10, 13, 33, 46, 63]] = True


def sentence_features(texts: list[bytes]):
    """Distinct (sentence, feature) pairs of a chunk, and the sentences.

    Returns ``(sentence, feature, text_of, begin, end)``: two arrays of pairs, then
    for each sentence with a word its text and its place in that text.
    Sentences end at ``.``, ``!``, ``?`` or a line break.
    """
    word, start, size, prefixes, buf, offsets = K.word_spans(texts, K.ALNUM_WORDS, PREFIXES)
    stop = _STOPS[buf]
    stop[offsets[1:] - 1] = True
    number = np.cumsum(stop)[start]
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(word) else np.empty(0, int)
    sentence = np.zeros(len(word), np.int64)
    sentence[first[1:]] = 1
    sentence = np.cumsum(sentence)
    text_of = np.searchsorted(offsets, start[first], side="right") - 1
    last = np.append(first[1:], len(word))[:len(first)] - 1
    begin, end = start[first] - offsets[text_of], start[last] + size[last] - offsets[text_of]
    pairs_s, pairs_f = [sentence], [word]
    for k, (at, value) in prefixes.items():
        pairs_s.append(sentence[at])
        pairs_f.append(K.keyed(value, k))
    return np.concatenate(pairs_s), np.concatenate(pairs_f), text_of, begin, end


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


class Model:
    """Selected features (sorted), their weights and the bias; no features: score 0."""

    def __init__(self, features=None, weights=None, bias: float = -np.inf):
        self.features = np.empty(0, np.uint64) if features is None else features
        self.weights = np.empty(0) if weights is None else weights
        self.bias = bias
        self.bitmap = K.member_bitmap(self.features)

    def sentences(self, texts: list[bytes]):
        """(score, text, begin, end) of every sentence, as arrays."""
        sentence, feature, text_of, begin, end = sentence_features(texts)
        pos, at = K.member(feature, self.features, self.bitmap)
        s, f = _distinct(sentence[pos], at)
        z = self.bias + np.bincount(s, weights=self.weights[f], minlength=len(text_of))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700))) * (self.bias > -np.inf), text_of, begin, end


def noisy_or(score: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - score) of each group; 0 for a group without scores."""
    return -np.expm1(np.bincount(group, weights=np.log1p(-np.minimum(score, 1 - 1e-12)), minlength=n))


def _chunks(texts: list[bytes]):
    """Slices of the texts of about a chunk's bytes."""
    done = 0
    while done < len(texts):
        size, take = 0, done
        while take < len(texts) and (take == done or size + len(texts[take]) < K.CHUNK_BYTES):
            size, take = size + len(texts[take]) + 1, take + 1
        yield done, texts[done:take]
        done = take


def select_features(texts: list[bytes], label: np.ndarray, n_features: int) -> np.ndarray:
    """Features whose rate differs most between the classes, by likelihood ratio.

    A feature counts once a text and needs three texts.
    """
    names, pos, both = np.empty(0, np.uint64), np.empty(0), np.empty(0)
    for start, part in _chunks(texts):
        sentence, feature, text_of, _, _ = sentence_features(part)
        t, f = _distinct(text_of[sentence] + start, feature)
        all_names, at = np.unique(np.concatenate([names, f]), return_inverse=True)
        pos = np.bincount(at, weights=np.concatenate([pos, label[t]]), minlength=len(all_names))
        both = np.bincount(at, weights=np.concatenate([both, np.ones(len(t))]), minlength=len(all_names))
        names = all_names
    share = min(max(float(label.mean()), 1e-9), 1 - 1e-9) if len(label) else 0.5

    def part_of(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-300) / expected)
    z = np.sqrt(np.maximum(0, 2 * (part_of(pos, both * share) + part_of(both - pos, both * (1 - share)))))
    z[both < 3] = 0
    best = np.argsort(-z, kind="stable")[:n_features]
    return np.sort(names[best[z[best] >= SIGNIFICANT]])


def fit(texts: list[bytes], label: np.ndarray, weight: np.ndarray, n_features: int = N_FEATURES) -> Model:
    """Noisy-or likelihood by full-batch Adam; ``weight`` is each text's weight."""
    names = select_features(texts, label, n_features)
    if not len(names):
        return Model()
    bitmap, n_sentences = K.member_bitmap(names), 0
    parts, texts_of = [], []
    for start, part in _chunks(texts):
        sentence, feature, text_of, _, _ = sentence_features(part)
        pos, at = K.member(feature, names, bitmap)
        parts.append(_distinct(sentence[pos] + n_sentences, at))
        texts_of.append(text_of + start)
        n_sentences += len(text_of)
    s, f = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    text_of = np.concatenate(texts_of)
    theta = np.zeros(len(names) + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(s, weights=theta[f], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        bag = np.clip(noisy_or(p, text_of, len(texts)), 1e-9, 1 - 1e-9)
        push = np.where(label == 1, (1 - bag) / bag, -1.0) * weight / total
        g = push[text_of] * p
        grad = np.append(np.bincount(f, weights=g[s], minlength=len(names)) - L2 * theta[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-10)
    return Model(names, theta[:-1], float(theta[-1]))


def _fit_group(table: pa.Table, n_features: int) -> pa.Table:
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    texts = [t or b"" for t in table["text"].cast(pa.binary()).take(pa.array(order)).to_pylist()]
    label = table["toxic"].to_numpy()[order].astype(np.int64)
    weight = table["weight"].to_numpy()[order]
    model = fit(texts, label, weight, n_features)
    return pa.table({"features": pa.array([model.features.tobytes()], pa.binary()),
                     "weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": pa.array([model.bias])})


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column, *, per_class: int = PER_CLASS,
                   n_features: int = N_FEATURES) -> Model:
    """Fit on at most ``per_class`` texts of either label among rows where ``train`` holds.

    Labels other than 0 and 1 and null ids are left out; an id with both labels
    counts as 1.  Without rows of both classes the model scores 0.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
             .where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic")))
    mine = docs.where(train).select(F.col("doc_id").cast("long").alias("id")).distinct().join(known, "id")
    sizes = {r["toxic"]: r["n"] for r in mine.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    total, picked = sum(sizes.values()), None
    for toxic, n in sizes.items():
        part = (mine.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(per_class)
                .withColumn("weight", F.lit(n / total / min(n, per_class))))
        picked = part if picked is None else picked.union(part)
    # At most 2 x per_class ids are broadcast and as many texts reach the fitting task.
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(picked), "id")
    row = (chosen.withColumn("one", F.lit(1)).groupBy("one")
           .applyInArrow(lambda t: _fit_group(t.drop_columns(["one"]), n_features),
                         "features binary, weights binary, bias double").first())
    return Model(np.frombuffer(row["features"], np.uint64), np.frombuffer(row["weights"]), row["bias"])


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model, threshold: float, n_keep: int):
    for batch, texts in K.text_chunks(batches, "__text"):
        score, text_of, begin, end = model.sentences(texts)
        whole = noisy_or(score, text_of, len(texts))
        found: list[list[str]] = [[] for _ in texts]
        for j in np.flatnonzero(score >= SENTENCE_THRESHOLD):
            t = text_of[j]
            found[t].append(texts[t][begin[j]:end[j]].decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(n_keep)), pa.array(whole),
             pa.array((whole >= threshold).astype(np.int32)), pa.array(found, pa.list_(pa.string()))],
            names=[*batch.schema.names[:n_keep], "score", "predicted", "offending"])


def score_toxicity(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of every row with score, predicted and its offending sentences.

    score is the noisy-or over the sentences of the whole text, predicted is 1 if
    it is at least ``threshold``, and offending lists the sentences whose own score
    is at least SENTENCE_THRESHOLD, in order.  A null, empty or wordless text has
    score 0.  Repeated rows score alike; no rows give no rows.  Other columns are
    not read; result columns replace columns of ``keep`` with their names.
    """
    K.small_batches(docs.sparkSession)
    keep = [c for c in keep if c not in ("score", "predicted", "offending")]
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]),
                        "score double, predicted int, offending array<string>"])
    return rows.mapInArrow(lambda it: _score_rows(it, shared.value, threshold, len(keep)), schema)
