"""Quality classifier: supervised subword embeddings.

A text's features are its words and the 3- and 4-byte sequences in and at the edges of words, hashed; a word that repeats the one
before it is written as a mark of its own. Each feature has a learned vector;
a text is the average of its features' vectors and of PRIOR zeros (a short text says little), and a softmax layer gives the label. Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. For two labels the layer's difference, applied to every vector once,
leaves one number a feature, so a text of any length is scored by one pass of lookups.

Null and empty texts have no features and get the score of the bias alone; repeated rows score alike; an empty table gives no
rows. Without labelled rows of both kinds the score is the share of label 1, or one half. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fold, kind, labelled_sample, map_batches, table, texts, utf8

BITS, DIM, EPOCHS, RATE = 18, 8, 6, 0.4
THRESHOLD = 0.5
#: Zero vectors that each average includes.
PRIOR = 100
#: Written for a word that repeats the one before it.
SAME = b"\x01\x01"
#: Bytes of text that are hashed at once: a bound on memory, longer texts take several pieces.
PIECE = 1 << 20
_MIX = np.uint32(0x9E3779B1)
_SALTS = {0: np.uint32(0x85EBCA6B), 3: np.uint32(0xC2B2AE35), 4: np.uint32(0x27D4EB2F)}


def features(data: bytes) -> np.ndarray:
    """Hashed features of a text with spaces around it, one entry for each occurrence."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    space = a == 32
    out = []
    two = (a[:-1] * np.uint32(257) + a[1:]) * _MIX
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) + a[2:] * np.uint32(0x2C1B3C6D)
    out.append((three ^ _SALTS[3])[~space[1:-1]])
    if len(a) > 3:
        four = (three[:-1] * _MIX ^ (three[:-1] >> np.uint32(13))) + a[3:] * np.uint32(0x297A2D39)
        out.append((four ^ _SALTS[4])[~(space[1:-2] | space[2:-1])])
    # words: a sum over their bytes, each weighted by its place
    at = np.flatnonzero(~space)
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        weight = (place.astype(np.uint32) * np.uint32(2) + np.uint32(1)) * _MIX
        out.append(np.add.reduceat((a[at] + np.uint32(7)) * weight ^ (weight >> np.uint32(11)), first, dtype=np.uint32) ^ _SALTS[0])
    h = np.concatenate(out)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (h ^ (h >> np.uint32(15))) & np.uint32((1 << BITS) - 1)


def pieces(text: str | None, size: int = PIECE) -> Iterator[bytes]:
    """The text's words in pieces cut at spaces, with one space around each."""
    words = utf8(text).split()
    data = b" ".join([b"", *words[:1], *(SAME if a == b else b for a, b in zip(words, words[1:])), b""])
    start = 0
    while len(data) - start > size:
        cut = data.rfind(b" ", start + 1, start + size)
        cut = cut if cut > start else start + size
        yield data[start : cut + 1]
        start = cut
    yield data[start:]


def train(sample: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """One number for each feature, and the bias."""
    y = np.array(labels)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    bias = np.array([0.0, np.log(share / (1 - share))])
    rng = np.random.default_rng(seed)
    v = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    if len(set(labels)) < 2:
        return np.zeros(1 << BITS, np.float32), float(bias[1])
    bags = []
    for text in sample:
        ids, n = np.unique(np.concatenate([features(p) for p in pieces(text)]), return_counts=True)
        bags.append((ids, (n / (n.sum() + PRIOR)).astype(np.float32)))
    w = np.zeros((2, DIM), np.float32)
    weight = len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))  # both labels weigh alike
    weight, bias = np.sqrt(weight), bias * 0.5
    for e in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, n = bags[k]
            step = rate * (1 - e / epochs) * weight[y[k]]
            hidden = n @ v[ids]
            z = w @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = w.T @ p
            w -= (step * np.outer(p, hidden)).astype(np.float32)
            bias -= 0.1 * step * p
            v[ids] -= (step * 20 * np.outer(n, back)).astype(np.float32)
    return v @ (w[1] - w[0]), float(bias[1] - bias[0])


def logit(text: str | None, values: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for piece in pieces(text):
        f = features(piece)
        total, n = total + float(values[f].sum(dtype=np.float64)), n + len(f)
    return total / (n + PRIOR) + bias


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text). The model is one number for each of 2 ** BITS features, whatever the input."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batch: pa.RecordBatch) -> dict:
        z = np.array([logit(t, *held.value) for t in texts(batch)])
        return {"score": 1 / (1 + np.exp(-np.clip(z, -50, 50)))}

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind(docs)}, score double", apply)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(*labelled_sample(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), "quality"))
    out = score(docs, model)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
