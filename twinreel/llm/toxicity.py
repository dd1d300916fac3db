"""Toxicity by multiple-instance learning: sentences are scored, a document is toxic if any of its sentences is.

A sentence's probability is a logistic function of the words in it; a document's is
the noisy-or of its sentences'.  The weights are fitted on document labels alone, by
full-batch proximal gradient steps on the noisy-or likelihood, so the gradient of a
toxic document goes to the sentences that explain it.  Afterwards the same weights
locate the offending sentences.

Defined results: null and empty texts have one empty sentence and score as the bias
says; repeated rows score alike; without usable labels every score is 0.  Only the
text is an input of a score.  The fit uses a bounded sample of labelled rows
(SAMPLE); every document is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinreel.llm.common import bounded_batches

#: Labelled documents that the model is fitted on, at most: those with the smallest hash of doc_id.
SAMPLE = 8_000
#: A word is a feature if at least so many of the sample's documents have it.
LEAST_DOCS = 4
#: Features kept: those whose presence tells most about the label.
FEATURES = 2_000
STEPS, RATE, L1 = 400, 0.5, 0.3
STEM = 5
THRESHOLD = 0.3
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W_]+")


def sentences(text: str | None) -> list[str]:
    return SENTENCE.split(text or "")


def features(sentence: str) -> set[str]:
    """The words, and the stems (first STEM letters, marked) of longer ones."""
    words = set(WORD.findall(sentence.lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def sentence_scores(self, text: str | None) -> list[float]:
        get = self.weights.get
        z = [self.bias + sum(get(w, 0.0) for w in features(s) if w in self.weights) for s in sentences(text)]
        return (1.0 / (1.0 + np.exp(-np.array(z)))).tolist()

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences; sentences without a feature share one value."""
        hot = self.weights.keys()
        parts = sentences(text)
        z = [sum(self.weights[w] for w in found) for s in parts if (found := features(s) & hot)] if hot else []
        quiet = len(parts) - len(z)
        log_none = -np.logaddexp(0, np.array(z) + self.bias).sum() - quiet * np.logaddexp(0, self.bias)
        return float(-np.expm1(log_none))


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """A model from (text, label) pairs."""
    if not rows or not any(y for _, y in rows):
        return Model(-40.0, {})
    y = np.array([float(bool(v)) for _, v in rows])
    have, pos = Counter(), Counter()
    for (text, _), label in zip(rows, y):
        words = set().union(*map(features, sentences(text)))
        have.update(words)
        if label:
            pos.update(words)
    n, n_pos = len(rows), y.sum()

    def gain(w: str) -> float:
        """Log-likelihood ratio of the label given the word's presence."""
        a, b, c, d = pos[w], have[w] - pos[w], n_pos - pos[w], n - n_pos - have[w] + pos[w]
        e = lambda x, r, k: x * np.log(max(x, 1e-12) * n / max(r * k, 1e-12)) if x > 0 else 0.0
        return e(a, a + b, n_pos) + e(b, a + b, n - n_pos) + e(c, c + d, n_pos) + e(d, c + d, n - n_pos)

    able = [w for w, k in have.items() if k >= LEAST_DOCS]
    vocab = {w: i for i, w in enumerate(sorted(able, key=lambda w: (-gain(w), w))[:FEATURES])}
    # one entry for each (sentence, feature), sentences in document order
    doc, word_at, sent_at, k = [], [], [], 0
    for i, (text, _) in enumerate(rows):
        for s in sentences(text):
            doc.append(i)
            at = [vocab[w] for w in features(s) if w in vocab]
            word_at += at
            sent_at += [k] * len(at)
            k += 1
    doc, word_at, sent_at = np.array(doc), np.array(word_at, np.int64), np.array(sent_at, np.int64)
    rate = n_pos / n
    bias = float(np.log(max(rate / max(1.0, len(doc) / n), 1e-4)) - 1.0)
    w, square, bias_square = np.zeros(len(vocab)), np.full(len(vocab), 1e-6), 1e-6
    for _ in range(STEPS):
        z = np.bincount(sent_at, w[word_at], len(doc)) + bias
        p = 1 / (1 + np.exp(-z))
        log_none = np.bincount(doc, -np.logaddexp(0, z), n)
        none = np.exp(np.minimum(log_none, -1e-9))
        # d(-log likelihood)/dz: p for clean documents, -p * none / (1 - none) for toxic ones
        g = p * np.where(y[doc] > 0, -(none / (1 - none))[doc], 1.0)
        grad, grad_bias = np.bincount(word_at, g[sent_at], len(vocab)), g.sum()
        square += grad**2
        bias_square += grad_bias**2
        step = RATE / np.sqrt(square)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        bias = min(bias - RATE / np.sqrt(bias_square) * grad_bias, -3.0)
    return Model(float(bias), {x: float(w[i]) for x, i in vocab.items() if w[i] != 0})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """The model for these labels, from documents that are not held out."""
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "text", "toxic").collect()  # at most SAMPLE ids, so the broadcast is bounded
    rows = sorted({r["doc_id"]: r for r in sorted(rows, key=lambda r: r["text"] or "")}.values(), key=lambda r: r["doc_id"])
    return fit([(r["text"], r["toxic"]) for r in rows])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = np.array([m.score(t) for t in b.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    bounded_batches(spark)
    kinds = dict(docs.select("doc_id").dtypes)
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence_no (from 1), sentence, score of the sentences that reach the threshold."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = [(d.as_py(), i + 1, s, p) for d, t in zip(b.column("doc_id"), b.column("text").to_pylist()) for i, (s, p) in enumerate(zip(sentences(t), m.sentence_scores(t))) if p >= threshold]
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column("doc_id").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], ["doc_id", "sentence_no", "sentence", "score"])

    bounded_batches(spark)
    kinds = dict(docs.select("doc_id").dtypes)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, sentence_no int, sentence string, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, their columns unchanged."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    bounded_batches(spark)
    return docs.mapInArrow(run, docs.schema)
