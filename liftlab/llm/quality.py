"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Words and word pairs of a text, and the words' shapes (case and closing signs)
and pairs of shapes, are hashed to 2 ** BITS features; every occurrence counts
1 / sqrt(number of features of the text). Training runs in
rounds: each of a fixed number of shards reads its labelled rows in small
batches and applies follow-the-regularised-leader updates to its own copy of
the state (z, n); the copies are averaged into the next round's start. Scoring
is one pass of sparse dot products with the broadcast weights (4 bytes x 2 ** BITS).

The fit uses at most about TRAIN_ROWS labelled rows, chosen by a hash of their
id; scoring covers every row and every text in full.

Defined cases. Null, empty and blank texts have no features and get the score
of the bias alone. Rows without a label, and labels without a row, are not
trained on. A document with several labels trains on their mean. Repeated rows are scored
alike. Without any labelled row, every score is 0.5. An empty table gives an empty
result. Only doc_id, text and the label are read; other columns never enter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlab.llm.common import chunks, coded_words, stored, table

BITS = 18
TRAIN_ROWS = 30_000
SHARDS = 8
ROUNDS = 3
BATCH = 16
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.001, 0.01
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_START, _AGAIN = np.uint64(1), np.uint64(2)
_SIGNS = re.compile(r"[\W_]*\Z")


def shape(word: str) -> str:
    """What a word looks like: its case and the signs at its end."""
    return ("A" if word.isupper() else "a") + _SIGNS.search(word).group()


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all occurrences, text by text, and each text's bounds.

    Four per word: the word, the pair with the word before, its shape, and the
    pair of shapes. A word repeated at once is one feature, whichever word it is.
    """
    code, bounds, names = coded_words(texts, lower=False)
    names = [w.decode() for w in names]
    lead = bounds[:-1][np.diff(bounds) > 0]  # a text's first word
    out = np.empty((len(code), 4), dtype=np.int64)
    shift = np.uint64(64 - bits)
    hashes = (np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in names], dtype=np.uint64),
              np.array([xxhash.xxh3_64_intdigest(shape(w), 1) for w in names], dtype=np.uint64))
    for k, by_code in enumerate(hashes):
        h = by_code[code]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[lead] = _START
        pair = np.where(h == before, _AGAIN, h) if k == 0 else h
        out[:, 2 * k] = (h * _MIX[0]) >> shift
        out[:, 2 * k + 1] = ((np.where(pair == _AGAIN, _AGAIN, before) * _MIX[1])
                             ^ (pair * _MIX[0] + _MIX[1])) * _MIX[0] >> shift
    return out.reshape(-1), 4 * bounds


def dots(weights: np.ndarray, feature: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of a text's weights over the square root of their number, per text."""
    total = np.concatenate([[0.0], np.cumsum(weights[feature], dtype=np.float64)])
    n = np.diff(bounds)
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.sqrt(np.maximum(n, 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class State:
    """FTRL-proximal state; the last feature is the bias."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls, bits: int = BITS) -> State:
        return cls(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def update(self, feature: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> None:
        """One step on a batch of texts."""
        bias = len(self.z) - 1
        count = np.diff(bounds)
        used, at = np.unique(feature, return_inverse=True)
        w = self.weights(used)
        p = sigmoid(dots(w, at, bounds) + self.weights(np.array([bias]))[0])
        per = (p - label) / np.sqrt(np.maximum(count, 1))
        g = np.bincount(at, np.repeat(per, count), len(used)) / len(label)
        used, g = np.append(used, bias), np.append(g, np.mean(p - label))
        w = np.append(w, self.weights(np.array([bias])))
        n = self.n[used]
        self.z[used] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[used] = n + g * g


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, shards: int = SHARDS,
        rounds: int = ROUNDS, bits: int = BITS) -> np.ndarray:
    """Weights (the last one is the bias) from rows (doc_id, text, label)."""
    spark = labelled.sparkSession
    order = F.xxhash64(F.lit("order"), "doc_id", "text")
    train = stored(labelled.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                                   F.col("label").cast("double").alias("label"))
                   .repartition(shards, "doc_id").sortWithinPartitions(order), "quality-train")
    state = State.empty(bits)
    for _ in range(rounds):
        start = spark.sparkContext.broadcast((state.z.astype(np.float32), state.n.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z, n = start.value
            own, rows = State(z.astype(np.float64), n.astype(np.float64)), 0
            for b in batches:
                for c in chunks(b, 0):
                    f, ends = features(c.column(0), bits)
                    y = c.column(1).to_numpy()
                    rows += len(y)
                    for i in range(0, len(y), BATCH):
                        e = ends[i:i + BATCH + 1]
                        own.update(f[e[0]:e[-1]], e - e[0], y[i:i + BATCH])
            if rows:
                yield pa.record_batch([pa.array([own.z.astype("<f4").tobytes()], pa.binary()),
                                       pa.array([own.n.astype("<f4").tobytes()], pa.binary())],
                                      names=["z", "n"])

        # At most ``shards`` rows of 8 bytes per feature reach the driver.
        copies = (train.select("text", "label").coalesce(shards)
                  .mapInArrow(run, "z binary, n binary").collect())
        start.unpersist()
        if not copies:
            break
        state = State(*(np.mean([np.frombuffer(r[k], "<f4") for r in copies], axis=0,
                                dtype=np.float64) for k in ("z", "n")))
    return state.weights().astype(np.float32)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str = "quality",
                  train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) for at most about ``train_rows`` labelled documents.

    The sample is drawn from the labels by a hash of the id, so it is small
    enough to be sent to the documents whatever their number.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        "doc_id").agg(F.avg(label).alias("label"))
    n = one.count()
    if n > train_rows:
        share = F.xxhash64(F.lit("sample"), "doc_id").cast("double") / 2.0 ** 64 + 0.5
        one = one.where(share < train_rows / n)
    one = stored(one, "quality-labels")
    return docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")


def with_score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row."""
    w = docs.sparkSession.sparkContext.broadcast(weights)
    bits = int(len(weights) - 1).bit_length() - 1

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        b = pa.record_batch([pa.array(texts, pa.large_string(), from_pandas=True)], names=["text"])
        out = []
        for c in chunks(b, 0):
            f, ends = features(c.column(0), bits)
            out.append(sigmoid(dots(w.value, f, ends) + w.value[-1]))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(column, score("text"))


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learnt from: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    weights = fit(labelled_rows(docs, labels))
    scored = with_score(docs, weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
