"""Toxicity by multiple-instance learning.

A document is a bag of sentences, its label says whether any of them is toxic. A linear model scores each
sentence from its words and word beginnings; a document's probability is the noisy-or of its
sentences', 1 - prod(1 - p). Only document labels train the sentence model, and the trained model then
points at the offending sentences. Features are 64-bit hashes; the model holds those that occur in
at least SEEN_IN documents of the sample and in clearly more toxic than other ones (MIN_Z), MAX_FEATURES at most.

The model is fitted in one task on at most SAMPLE_ROWS labelled documents per class, chosen and held out
as in quality_model. A null or empty text has no sentence and scores 0. Repeated rows get equal
scores; ids and other columns are no input. Without labelled rows of both classes nothing is learned: all score below 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm import hashing
from opslens.llm.quality_model import fitted, held_out, labelled_sample

SAMPLE_ROWS = 2000
FILTER_BITS = 22
BEGINNINGS = (4, 5, 6)
SEEN_IN = 4
MIN_Z = 4.0
MAX_FEATURES = 1 << 15
ROUNDS = 200
THRESHOLD = 0.7
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
NO_LETTER = np.array([not (97 <= c <= 122 or c >= 128) for c in range(256)])
STOPS = np.isin(np.arange(256), list(b".!?\n"))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: feature hashes with the sentence of each, then document and start byte per sentence."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = hashing.spans(NO_LETTER[data])
    stops = np.flatnonzero(STOPS[data])
    sentence = np.searchsorted(stops, starts)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    number, of = [], []
    for cut in (0, *BEGINNINGS):
        some = np.arange(len(starts)) if not cut else np.flatnonzero(ends - starts >= cut)
        stop = ends[some] if not cut else starts[some] + cut
        h = hashing.span_hashes(data, starts[some], stop) ^ np.uint64(cut * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        number.append(hashing.mix(h))
        of.append(sentence[some])
    used, sentence = np.unique(np.concatenate(of), return_inverse=True)
    at = np.concatenate(([0], stops[:-1] + 1))[used] if len(used) else np.zeros(0, np.int64)
    doc = np.searchsorted(begins, at, "right") - 1
    return np.concatenate(number), sentence, doc, at - begins[doc]


class Model:
    """Sorted feature hashes, a weight each, and a bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.keys, self.weights, self.bias = keys, weights, bias
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def known(self, number: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and sentence of the model's features, each once per sentence."""
        some = np.flatnonzero(self.maybe[(number >> np.uint64(64 - FILTER_BITS)).astype(np.int32)])
        if not len(some) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, number[some]), len(self.keys) - 1)
        hit = self.keys[at] == number[some]
        pair = np.unique(sentence[some[hit]] * len(self.keys) + at[hit])
        return pair % len(self.keys), pair // len(self.keys)

    def scores(self, index: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Probability of each of n sentences."""
        z = np.bincount(sentence, weights=self.weights[index], minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


UNTRAINED = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def telling(number: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features that clearly more toxic documents have."""
    order = np.lexsort((doc, number))
    number, doc = number[order], doc[order]
    once = np.concatenate(([True], (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])))[: len(number)]
    keys, begin = np.unique(number[once], return_index=True)
    toxic = np.add.reduceat(label[doc[once]], begin)
    seen = np.diff(np.append(begin, once.sum()))
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    share = seen / len(label)
    z = (toxic / n1 - (seen - toxic) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    good = np.flatnonzero((seen >= SEEN_IN) & (z >= MIN_Z))
    return np.sort(keys[good[np.argsort(-z[good], kind="stable")[:MAX_FEATURES]]])


def fit_texts(texts: list[bytes], label: np.ndarray) -> Model:
    """Weights and bias by full-batch Adam on the noisy-or's log loss; classes weigh the same."""
    if len(set(label.tolist())) < 2:
        return UNTRAINED
    parts, s0 = [], 0
    for i, j in hashing.text_groups(texts):
        number, sentence, doc, _ = features(texts[i:j])
        parts.append((number, sentence + s0, doc + i))
        s0 += len(doc)
    number, sentence, doc = (np.concatenate(x) for x in zip(*parts))
    keys = telling(number, doc[sentence], label.astype(np.int64))
    model = Model(keys, np.zeros(len(keys)), -4.0)
    index, sentence = model.known(number, sentence)
    weight = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for step in range(1, ROUNDS + 1):
        p = model.scores(index, sentence, len(doc))
        whole = np.clip(noisy_or(p, doc, len(texts)), 1e-9, 1 - 1e-9)
        pull = np.where(label == 1, -(1 - whole) / whole, 1.0) * weight
        slope = pull[doc] * p
        grad = np.append(np.bincount(index, weights=slope[sentence], minlength=len(keys)) + 1e-6 * model.weights, slope.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        model.weights -= move[:-1]
        model.bias -= move[-1]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """The model, fitted in a task; what comes back are at most MAX_FEATURES hashes with weights, and a bias."""

    def train(texts: list[bytes], label: np.ndarray) -> pa.RecordBatch:
        found = fit_texts([t.translate(LOWER) for t in texts], label)
        return pa.record_batch([pa.array([found.keys.tobytes()]), pa.array([found.weights.tobytes()]), pa.array([found.bias])],
                               names=["keys", "weights", "bias"])

    found = fitted(labelled_sample(docs, labels, label, rows), train, "keys binary, weights binary, bias double")
    if found is None:
        return UNTRAINED
    return Model(np.frombuffer(found["keys"], np.uint64), np.frombuffer(found["weights"], np.float64), found["bias"])


def with_score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the byte where the most toxic sentence starts, with its score."""
    known = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))
    schema = "doc_id long, held_out boolean, score double, worst_start long, worst_score double"

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*known.value)
        for batch in stream:
            texts = [(t.as_py() or "").encode().translate(LOWER) for t in batch.column("text")]
            for i, j in hashing.text_groups(texts):
                number, sentence, doc, at = features(texts[i:j])
                p = scorer.scores(*scorer.known(number, sentence), len(doc))
                order = np.lexsort((at, -p, doc))
                first = order[np.unique(doc[order], return_index=True)[1]]
                start, worst = np.full(j - i, -1, np.int64), np.zeros(j - i)
                start[doc[first]], worst[doc[first]] = at[first], p[first]
                part = batch.slice(i, j - i)
                yield pa.record_batch([
                    part.column("doc_id"), part.column("held_out"), pa.array(np.clip(noisy_or(p, doc, j - i), 0, 1)),
                    pa.array(start, mask=start < 0), pa.array(worst, mask=start < 0),
                ], names=["doc_id", "held_out", "score", "worst_start", "worst_score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInArrow(batches, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return with_score(docs, fit(docs, labels))
