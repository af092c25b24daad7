"""Hashes sent packed: many to a row, one row per (chunk of a task's documents, bucket of hashes).

``sizes`` balances the two. With N hashes in all, chunks and buckets of ``sqrt(PER_ROW * N)`` give rows of
``PER_ROW`` hashes, so a row's own cost does not count, and both a task's chunk and a bucket's group stay far
below a task's memory: 250,000 hashes at least, 31 million at 100 TB.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, PER_ROW = 250_000, 64
BYTES_PER_WORD = 6


def sizes(texts: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(hashes of a chunk, number of buckets) for the words of a table's texts, from their counted bytes."""
    total = (texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // BYTES_PER_WORD
    chunk = max(LEAST, math.isqrt(PER_ROW * total))
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunk, max(-(-total // chunk), 2 * partitions)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits byte by byte in planes: the high planes of small ones are zeros, which compress away."""
    return np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(places: np.ndarray) -> bytes:
    """Ascending numbers, as the planes of their gaps."""
    return planes(np.diff(places, prepend=0))


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw).astype(np.int64))
