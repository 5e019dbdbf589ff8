"""Quality score by compression with two zstandard dictionaries.

One dictionary is trained on good labelled text, one on bad. A text is cut into pieces of PIECE bytes, every
piece is compressed with both, and the normalised difference of the compressed sizes, (bad - good) over
(bad + good + STEADY), says which kind of text it is more like; STEADY keeps short texts near zero. A logistic
curve over that difference and the text's overall compression ratio (texts that repeat themselves shrink to
nothing with either dictionary), fitted on labelled texts that neither dictionary has seen and set to the
labels' own frequency, turns it into a probability.

The model is fitted in one task on at most SAMPLE_ROWS labelled documents per class (those with the smallest
MD5 of their doc_id; of a repeated doc_id the text with the smallest MD5), of at most SAMPLE_BYTES each. Labels of rows
in the held-out fold are never read. A null or empty text
compresses to nothing and scores what the curve gives for no difference and no compression. Repeated rows get equal
scores; ids and other columns are no input. Without labelled rows of both classes all score the share of good labels,
a half if there are none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.llm.common import whole

SAMPLE_ROWS = 2000
SAMPLE_BYTES = 1 << 16
PIECE = 2048
DICT_BYTES = 64 * 1024
LEVEL = 3
THRESHOLD = 0.5
STEADY = 64


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, label, text of at most `rows` documents per class from outside the held-out fold, one text per doc_id."""
    known = labels.filter(~held_out(F.col("doc_id"))).filter("doc_id IS NOT NULL")
    pick = [
        known.filter(F.col(label) == k).select(F.col("doc_id").alias("_id"), F.lit(k).alias("label"))
        .distinct().orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(rows)
        for k in (0, 1)
    ]
    found = docs.join(F.broadcast(union_all(*pick)), F.col("doc_id") == F.col("_id")).select(  # at most 2 * rows ids
        "doc_id", "label", whole(F.col("text").cast("string")).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.md5("text")).alias("text"))


def fitted(sample: DataFrame, train, schema: str) -> Row | None:
    """What train(texts, labels) gives in the one task that the sample, and nothing before it, is brought to."""

    def fit_all(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(stream)
        if batches:
            rows = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("label", "ascending")])
            yield train([t.encode() for t in rows["text"].to_pylist()], rows["label"].to_numpy())

    return sample.repartition(1).mapInArrow(fit_all, schema).first()


def pieces(text: bytes) -> list[bytes]:
    return [text[i:i + PIECE] for i in range(0, len(text), PIECE)]


class Compressors:
    def __init__(self, good: bytes, bad: bytes) -> None:
        self.both = []
        for content in (bad, good):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False))

    def measures(self, text: bytes) -> tuple[float, float]:
        """The difference, above zero if the good dictionary compresses the text better, and log compression ratio."""
        cut = pieces(text)
        bad, good = (sum(len(c.compress(p)) for p in cut) for c in self.both)
        return (bad - good) / (bad + good + STEADY), float(np.log((bad + good + STEADY) / (2 * len(text) + STEADY)))


def dictionary(texts: list[bytes]) -> bytes:
    samples = [p for t in texts for p in pieces(t)]
    size = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-DICT_BYTES:].ljust(8, b" ")


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Slopes and offset by Newton's method; classes weigh the same, a small penalty keeps slopes finite."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    design = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 0.05 * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    slope = w[:-1] / scale
    return np.append(slope, w[-1] - slope @ centre)


def curve(model: dict, measures: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(measures @ model["curve"][:-1] + model["curve"][-1], -30, 30)))


def untrained(odds: float) -> dict:
    """Scores the share of good labels, whatever the text."""
    return {"good": b" " * 8, "bad": b" " * 8, "curve": np.array([0.0, 0.0, np.log(odds)])}


def fit_texts(texts: list[bytes], label: np.ndarray, odds: float = 1.0) -> dict:
    """Every second text of a class builds the dictionaries, the others the curve; odds: how many good rows a bad one has."""
    turn = np.zeros(len(label), int)
    for k in (0, 1):
        turn[label == k] = np.arange((label == k).sum()) % 2
    if len(set(label.tolist())) < 2:
        return untrained(odds)
    pick = lambda k, t: [x for x, a, b in zip(texts, label, turn) if a == k and b == t]
    model = {"good": dictionary(pick(1, 0)), "bad": dictionary(pick(0, 0))}
    other = turn == 1 if len(set(label[turn == 1].tolist())) == 2 else turn >= 0
    both = Compressors(model["good"], model["bad"])
    x = np.array([both.measures(t) for t, o in zip(texts, other) if o])
    model["curve"] = logistic(x, label[other])
    model["curve"][-1] += np.log(odds)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> dict:
    """The model, fitted in a task; what comes back are two dictionaries and three numbers."""
    seen = labels.filter(~held_out(F.col("doc_id"))).agg(
        F.count_if(F.col(label) == 1).alias("good"), F.count_if(F.col(label) == 0).alias("bad")).first()
    odds = (seen["good"] + 1) / (seen["bad"] + 1)

    def train(texts: list[bytes], label: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([pickle.dumps(fit_texts(texts, label, odds))])], names=["model"])

    found = fitted(labelled_sample(docs, labels, label, rows), train, "model binary")
    return pickle.loads(found["model"]) if found else untrained(odds)


def with_score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        both = Compressors(m["good"], m["bad"])
        for batch in stream:
            x = np.array([both.measures((t.as_py() or "").encode()) for t in batch.column("text")]).reshape(-1, 2)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(curve(m, x))],
                                  names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInArrow(batches, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return with_score(docs, fit(docs, labels))
