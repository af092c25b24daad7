"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and the character n-grams of words (with their ends) are hashed
to buckets; every bucket has a learned vector; a document is the average of its vectors, followed by
a softmax over the labels. Vectors and softmax are trained together by plain numpy stochastic gradient
descent. For two labels the softmax of an average is the logistic function of an average of one number
per bucket, so scoring needs one float per bucket and one pass over the text.

Training reads a sample of ``train_rows`` labelled documents (those with the smallest hashes of their
ids) with all features of their whole texts. The sample is a table, and so are the weights after each epoch;
an epoch is one task that streams the sample, in an order of its own, through the weights. So Python holds
the weights (``BUCKETS * DIMENSIONS`` numbers) and a few rows, however long the texts are, and the driver gets the
finished model alone: one number per bucket. A bucket that no sampled document has weighs nothing. Scoring
reads every whole text, in pieces, so a worker's memory does not grow with a text's length.

Defined results: null and empty texts have no features and get the score of the bias; without
labels of both kinds every score is the share of label 1 among them (0.5 without labels); null labels
are left out; a document with several labels takes the smallest; of equal rows one is learned from; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import stored, tidy

BUCKETS = 1 << 17
DIMENSIONS = 16
NGRAMS = (3, 4)  # bytes of the character n-grams
EPOCHS = 8
LEARNING_RATE = 0.5
TRAIN_ROWS = 6_000
PARTS = 64  # rows that hold the weights
KEEP_AT = 0.7
PIECE_CHARS = 1 << 19
FOLDS, HELD_OUT = 4, 2

_BASE = np.uint32(0x01000193)
_POWERS = np.cumprod(np.full(64, 0x9E3779B1, np.uint32), dtype=np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end between words where they can."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = text.rfind(" ", at, at + PIECE_CHARS)
        cut = at + PIECE_CHARS if cut <= at else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def feature_buckets(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's features, with repeats, piece by piece."""
    last = None
    for piece in _pieces(text or ""):
        raw = np.frombuffer(b" " + piece.encode() + b" ", np.uint8)
        blank = _BLANK[raw]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            continue
        symbol = np.where(blank, np.uint32(32), raw).astype(np.uint32)
        # words: position-weighted sums of their bytes
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        inside = np.flatnonzero(~blank)
        weight = _POWERS[(inside - starts[owner]) & 63]
        words = _mix(np.add.reduceat(_mix(symbol[inside] + np.uint32(1)) * weight,
                                     np.searchsorted(inside, starts), dtype=np.uint32))
        yield words % np.uint32(BUCKETS)
        left = words if last is None else np.append(last, words)
        yield _mix(left[:-1] * np.uint32(31) + left[1:]) % np.uint32(BUCKETS)
        last = words[-1]
        # n-grams that lie in one word, its two ends included
        for n in NGRAMS:
            if len(raw) < n:
                continue
            h = np.full(len(raw) - n + 1, n, np.uint32)
            whole = np.ones(len(h), bool)
            for k in range(n):
                h = h * _BASE + symbol[k:len(symbol) - n + 1 + k]
                if 0 < k < n - 1:
                    whole &= ~blank[k:len(blank) - n + 1 + k]
            yield _mix(h[whole]) % np.uint32(BUCKETS)


def train_features(text: str | None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their counts; of more than ``most``, if given, those that hash lowest."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in feature_buckets(text):
        counts += np.bincount(part, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    if most is not None and len(found) > most:
        order = _mix(found.astype(np.uint32) * np.uint32(0x85EBCA6B))
        found = np.sort(found[np.argpartition(order, most)[:most]])
    return found.astype(np.int32), counts[found].astype(np.int32)


@dataclass
class QualityModel:
    """What scoring needs: one number per bucket and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for part in feature_buckets(text):
            total += float(self.weights[part].sum(dtype=np.float64))
            n += len(part)
        margin = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


Row = tuple[np.ndarray, np.ndarray, int]  # buckets, their counts, the label


@dataclass
class Weights:
    """The state of training."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    steps: int = 0

    @classmethod
    def start(cls, seed: int = 1) -> Weights:
        vectors = np.random.default_rng(seed).uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        return cls(vectors, np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32), np.zeros(BUCKETS, bool))

    def learn(self, rows: Iterable[Row], total: int, rate: float = LEARNING_RATE) -> None:
        """One pass of stochastic gradient descent; the rate falls to zero over ``total`` steps."""
        for buckets, counts, label in rows:
            now = rate * max(0.0, 1 - self.steps / total)
            self.steps += 1
            self.seen[buckets] = True
            share_of = (counts / max(1, counts.sum())).astype(np.float32)
            doc = share_of @ self.vectors[buckets]
            logits = self.out @ doc + self.bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[label] -= 1
            back = error @ self.out
            self.out -= now * error[:, None] * doc
            self.bias -= now * error
            # an average spreads its gradient thinly; scaled by the number of buckets, as each is its own parameter
            self.vectors[buckets] -= now * np.minimum(share_of * len(buckets), 4)[:, None] * back

    def model(self) -> QualityModel:
        weights = np.where(self.seen, self.vectors @ (self.out[1] - self.out[0]), 0)  # the others hold their random start
        return QualityModel(weights.astype(np.float32), float(self.bias[1] - self.bias[0]))

    def packed(self) -> tuple[bytes, bytes]:
        return self.vectors.astype("<f4").tobytes(), b"".join(
            [self.out.astype("<f4").tobytes(), self.bias.astype("<f4").tobytes(), np.int64(self.steps).tobytes(), self.seen.tobytes()])

    @classmethod
    def unpacked(cls, vectors: bytes, rest: bytes) -> Weights:
        out, bias = (np.frombuffer(rest, "<f4", n, at).copy() for n, at in ((2 * DIMENSIONS, 0), (2, 8 * DIMENSIONS)))
        at = 8 * DIMENSIONS + 8
        return cls(np.frombuffer(vectors, "<f4").reshape(BUCKETS, DIMENSIONS).copy(), out.reshape(2, DIMENSIONS), bias,
                   np.frombuffer(rest, bool, BUCKETS, at + 8).copy(), int(np.frombuffer(rest, np.int64, 1, at)[0]))


@tidy
def _epoch(batches: Iterator[pa.RecordBatch], total: int, last: bool) -> Iterator[pa.RecordBatch]:
    """One task: the parts of the weights, if there are any, then the sample; the weights after it, or the model."""
    rows = (row for batch in batches for row in batch.to_pylist())
    parts, ahead = [], []
    for row in rows:
        if row["label"] is not None:
            ahead = [row]
            break
        parts.append(row)
    parts.sort(key=lambda r: r["order"])
    weights = Weights.unpacked(*(b"".join(r[c] for r in parts) for c in ("buckets", "counts"))) if parts else Weights.start()
    weights.learn(((np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4"), r["label"])
                   for r in chain(ahead, rows)), total)
    a, b = (weights.model().weights.tobytes(), np.float64(weights.model().bias).tobytes()) if last else weights.packed()
    step = -(-len(a) // PARTS)
    for i in range(PARTS):  # small rows: one of all weights would ask for large buffers all the way
        yield pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int64()), pa.array([None], pa.int32()), pa.array([a[i * step:(i + 1) * step]], pa.binary()),
             pa.array([b if i == 0 else b""], pa.binary())], names=["order", "label", "buckets", "counts"])


def of_one_label(share: float) -> QualityModel:
    """Without both labels there is nothing to learn: every score is the share of label 1."""
    safe = np.clip(share, 1e-6, 1 - 1e-6)
    return QualityModel(np.zeros(BUCKETS, np.float32), float(np.log(safe / (1 - safe))))


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from; a null id is in none."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


@tidy
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [train_features(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("order"), batch.column("label"), pa.array([b.astype("<i4").tobytes() for b, _ in found], pa.binary()),
             pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], names=["order", "label", "buckets", "counts"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Learn from a bounded sample of the labelled rows outside the held-out fold."""
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
              .groupBy("_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(train_rows))

    # at most train_rows rows, whatever the input: a bounded broadcast
    known = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
             .join(F.broadcast(chosen), F.col("id") == F.col("_id"))
             .select(F.xxhash64("id", "text").alias("order"), "label", "text"))
    # an id may be in many rows: the sample ends at the order of its last row
    last = known.select("order").distinct().orderBy("order").limit(train_rows).agg(F.max("order")).first()[0]
    row = "order long, label int, buckets binary, counts binary"
    sample = stored(known.where(F.col("order") <= F.lit(last)).mapInArrow(_featured, row).dropDuplicates(["order"]), "quality-sample")
    n, share = sample.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not n or not 0 < share < 1:
        return of_one_label(share if n else 0.5)
    rows = sample
    for epoch in range(EPOCHS):
        # the weights first, as they have no label; then the sample, every time in another order
        ordered = rows.coalesce(1).sortWithinPartitions(F.col("label").isNotNull(), F.xxhash64("order", F.lit(epoch)), "order")
        weights = stored(ordered.mapInArrow(lambda b, last=epoch == EPOCHS - 1: _epoch(b, EPOCHS * n, last), row),
                         "quality-weights", batch_rows=32)
        rows = weights.unionByName(sample)
    model = sorted(weights.collect(), key=lambda r: r.order)  # PARTS rows of BUCKETS numbers in all
    return QualityModel(np.frombuffer(b"".join(r.buckets for r in model), "<f4"),
                        float(np.frombuffer(model[0].counts, "<f8")[0]))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 per whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out_col, scores(F.col(text_col).cast("string")))


def accepted(score_col: str = "score", at: float = KEEP_AT) -> Column:
    return F.col(score_col) >= F.lit(at)
