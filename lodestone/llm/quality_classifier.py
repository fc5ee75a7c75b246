"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A document becomes a sparse vector: unigrams and bigrams of its words and of
their shapes are hashed to 2^18 columns and weighted by their share of the
text. Training sees a bounded sample of labelled documents in one streaming
task; scoring is one pass of sparse dot products with the weights shipped as
a fixed-size array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, read_table
from .hashing import mix, word_hashes

BITS = 18
#: Labelled documents that training takes at most, those of the smallest xxhash64(doc_id); the bound of the fit.
SAMPLE_ROWS = 6000
EPOCHS = 4
THRESHOLD = 0.7
FOLDS, HELD_OUT_FOLD = 4, 2

_KIND = np.full(256, 4, np.uint8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 symbol, 5 byte of a longer character
_KIND[[32, *range(9, 14)]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
#: Marks inside prose; a word of letters that ends in one of them keeps the shape of plain text.
_KIND[[ord(c) for c in ".,;:'\"?()-"]] = 6


def shape_text(text: bytes) -> bytes:
    """The text with each character replaced by its class, runs collapsed: words become shapes."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return b""
    kind = _KIND[raw]
    keep = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 4)])
    return np.frombuffer(b" aA0#a.", np.uint8)[kind[keep]].tobytes()


def features(texts: list[bytes | None], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the distinct columns and their values; a text without words has the bias column only."""
    texts = [t or b"" for t in texts]
    up = np.uint64(64 - bits)
    for words, shapes in zip(word_hashes(texts), word_hashes([shape_text(t) for t in texts], fold=False), strict=True):
        n = len(words)
        if n == 0:
            yield np.zeros(1, np.int64), np.ones(1)
            continue
        again = (words[1:] == words[:-1]).astype(np.uint64)
        grams = [words, mix(words[:-1] * np.uint64(3) + words[1:])]
        seen = [mix(shapes + np.uint64(11)), mix(shapes[:-1] * np.uint64(5) + shapes[1:]), mix(again + np.uint64(977))]
        columns = np.concatenate([*grams, *seen])
        weights = np.concatenate([np.full(len(x), s / n) for x, s in zip([*grams, *seen], (1, 1, 4, 4, 4), strict=True)])
        at, where = np.unique((columns >> up).astype(np.int64), return_inverse=True)
        yield np.concatenate([[0], at]), np.concatenate([[1.0], np.bincount(where, weights)])


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) for logistic loss."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, importance: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x * importance
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> bytes:
    """Weights as float32 bytes, learnt from at most sample_rows labelled rows.

    The sample is the labelled ids of the smallest hash, so it does not depend on
    partitioning. Rows whose id or label is null teach nothing; where no
    labelled row has a text, all weights are 0 and every score is 0.5.
    """
    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    )
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("_text")).where(F.col("_text").isNotNull())
    sample = rows.join(F.broadcast(ids), "_id").repartition(1).sortWithinPartitions(F.xxhash64("_id", F.lit(1)), "_id", "_text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Ftrl(bits), []
        for batch in batches:
            for (at, x), y in zip(features(batch.column("_text").to_pylist(), bits), batch.column("_y").to_pylist(), strict=True):
                held.append((at.astype(np.int32), x.astype(np.float32), y))
        ones = sum(y for *_, y in held)
        scale = {1: len(held) / max(1, 2 * ones), 0: len(held) / max(1, 2 * (len(held) - ones))}
        for _ in range(epochs):
            for at, x, y in held:
                model.learn(at, x, y, min(scale[y], 10.0))
        yield pa.RecordBatch.from_pydict({"w": [model.weights().astype(np.float32).tobytes()]})

    found = sample.mapInArrow(fit, "w binary").collect()
    return bytes(found[0].w) if found else np.zeros(1 << bits, np.float32).tobytes()


def score(docs: DataFrame, weights: bytes, id_column: str = "doc_id", bits: int = BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, carried columns) for each row; whole texts, null and empty ones by the bias alone."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits floats, whatever the input
    names = [id_column, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shipped.value, np.float32).astype(np.float64)
        for batch in batches:
            logits = [w[at] @ x for at, x in features(batch.column("_text").to_pylist(), bits)]
            p = 1 / (1 + np.exp(-np.clip(np.array(logits, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p)], [*names, "score"])

    kept = docs.select(*names, F.col("text").cast("binary").alias("_text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in kept.select(*names).dtypes)
    return kept.mapInArrow(run, f"{kinds}, score double")


def held_out():
    return crc_mod("doc_id", FOLDS) == HELD_OUT_FOLD


def fit_on_training_fold(docs: DataFrame, labels: DataFrame) -> bytes:
    """Weights learnt without the held-out fold."""
    return train(docs, labels.where(~F.coalesce(held_out(), F.lit(True))))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. A null doc_id counts as held out."""
    docs = read_table(spark, sf_dir, "documents")
    weights = fit_on_training_fold(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, weights).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
