"""Keyed token-bucket admission over an event log (T1, batch form).

Semantics (per key, events in (time, id) order): the bucket starts full; between
events it refills at ``rate`` tokens per second up to ``burst`` tokens; an event is
admitted when at least one token is available and then costs one token; a denied
event costs nothing. All arithmetic is in integer microseconds (a token is worth
``1e6 / rate`` µs, the bucket holds ``burst`` tokens), so every engine agrees bit
for bit.

Plan, built for a key that holds a third of all events:

1. Events are hash-partitioned by (key, time bucket), so a hot key is as many tasks as it has
   buckets, and sorted inside. Every (key, bucket) is summarised as the map from the
   level before its first decision to the level after its last: a few intervals on which the level
   is either moved by a constant or set to one (an event shifts, clamps at the capacity, and takes a
   token above one).
2. The summaries, one row per (key, bucket), are walked per key: each map is applied once, to
   give every bucket its entry level.
3. Every (key, bucket) is folded from its entry level, all in parallel.

Both passes over the events read batches and keep the state of one bucket; no group is held as a
list, nothing goes to the driver. A bucket of one event, the common case of sparse keys, needs
no map: its summary has NULLs for one, and a batch's buckets of that kind are summarised and
folded together as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.time import epoch_micros

# fixed values: the reference's admission rate and burst per client
RATE_PER_SECOND = 2
BURST = 4
IDLE_EVICT_SECONDS = 180
US = 1_000_000
BUCKET_US = 600 * US


def costs(rate_per_second: float = RATE_PER_SECOND, burst: int = BURST) -> tuple[int, int]:
    """(cost of one token, bucket capacity) in microseconds."""
    cost = int(round(US / rate_per_second))
    return cost, cost * burst


class LevelMap:
    """Level before a run of decisions -> level after it, on [0, capacity].

    ``pieces`` are (first level, moves, value): from that level on the result is the level plus
    ``value`` if it moves, else ``value``.
    """

    def __init__(self, cost: int, capacity: int):
        self.cost, self.capacity = cost, capacity
        self.pieces = [(0, True, 0)]

    def _split(self, at_result: int) -> Iterator[tuple[int, int, bool, int]]:
        """(first, last, moves, value) pieces, cut so that results below ``at_result`` stand apart."""
        ends = [p[0] - 1 for p in self.pieces[1:]] + [self.capacity]
        for (lo, moves, value), hi in zip(self.pieces, ends, strict=True):
            border = at_result - value  # first level whose result reaches at_result
            if moves and lo < border <= hi:
                yield lo, border - 1, moves, value
                yield border, hi, moves, value
            else:
                yield lo, hi, moves, value

    def _keep(self, pieces: list[tuple[int, bool, int]]) -> None:
        self.pieces = [p for i, p in enumerate(pieces) if i == 0 or p[1:] != pieces[i - 1][1:]]

    def refill(self, elapsed: int) -> None:
        full = self.capacity - elapsed
        out = []
        for lo, _, moves, value in self._split(full):
            if (lo + value if moves else value) >= full:
                out.append((lo, False, self.capacity))
            else:
                out.append((lo, moves, value + elapsed))
        self._keep(out)

    def decide(self) -> None:
        self._keep([(lo, moves, value - self.cost if (lo + value if moves else value) >= self.cost else value)
                    for lo, _, moves, value in self._split(self.cost)])

    def apply(self, level: int) -> int:
        return apply_pieces([p[0] for p in self.pieces], [p[1] for p in self.pieces],
                            [p[2] for p in self.pieces], level)


def apply_pieces(firsts, moves, values, level: int) -> int:
    at = int(np.searchsorted(np.asarray(firsts), level, "right")) - 1
    return int(values[at]) + (level if moves[at] else 0)


def _texts(column: pd.Series) -> np.ndarray:
    """A text column as objects, None where it is NULL."""
    out = column.to_numpy(dtype=object).copy()
    out[column.isna().to_numpy()] = None
    return out


def _runs(pdf: pd.DataFrame, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the contiguous (key, bucket) runs of a sorted, non-empty batch start, and the places after their ends."""
    buckets = pdf["_b"].to_numpy()
    same = (buckets[1:] == buckets[:-1]) & (keys[1:] == keys[:-1])
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
    return starts, np.concatenate([starts[1:], [len(pdf)]])


def _lone(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs of one event; not the batch's first and last, which may go on in its neighbours."""
    lone = ends - starts == 1
    lone[[0, -1]] = False
    return lone


def _summarise(key: str, cost: int, capacity: int):
    def row(ident, first, last, level):
        firsts, moves, values = (list(x) for x in zip(*level.pieces, strict=True))
        return {key: ident[0], "_b": ident[1], "first_t": first, "last_t": last, "firsts": firsts,
                "moves": moves, "changes": values}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = first = last = level = None
        for pdf in batches:
            if not len(pdf):
                continue
            keys, buckets, ts = _texts(pdf[key]), pdf["_b"].to_numpy(), pdf["_t"].to_numpy(dtype=np.int64)
            starts, ends = _runs(pdf, keys)
            lone = _lone(starts, ends)
            at = starts[lone]
            if len(at):
                yield pd.DataFrame({key: keys[at], "_b": buckets[at], "first_t": ts[at], "last_t": ts[at],
                                    "firsts": None, "moves": None, "changes": None})
            done = []
            for a, z in zip(starts[~lone].tolist(), ends[~lone].tolist(), strict=True):
                ident = keys[a], int(buckets[a])
                if ident != current:
                    if current is not None:
                        done.append(row(current, first, last, level))
                    current, first, last, level = ident, int(ts[a]), None, LevelMap(cost, capacity)
                for t in ts[a:z].tolist():
                    if last is not None:
                        level.refill(max(0, t - last))
                    level.decide()
                    last = t
            if done:
                yield pd.DataFrame(done)
        if current is not None:
            yield pd.DataFrame([row(current, first, last, level)])
    return run


def _walk(key: str, cost: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level, last = object(), 0, 0
        for pdf in batches:
            entries = []
            for k, first, end, firsts, moves, changes in zip(
                    _texts(pdf[key]).tolist(), pdf["first_t"].tolist(), pdf["last_t"].tolist(), pdf["firsts"],
                    pdf["moves"], pdf["changes"], strict=True):
                level = capacity if k != current else min(capacity, level + max(0, first - last))
                current, last = k, end
                entries.append(level)
                if firsts is None:  # one event
                    level -= cost if level >= cost else 0
                else:
                    level = apply_pieces(firsts, moves, changes, level)
            yield pdf[[key, "_b"]].assign(entry=entries)
    return run


def _fold(key: str, event_id: str, cost: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level, last = None, 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            keys, buckets = _texts(pdf[key]), pdf["_b"].to_numpy()
            ts, entry = pdf["_t"].to_numpy(dtype=np.int64), pdf["entry"].to_numpy(dtype=np.int64)
            starts, ends = _runs(pdf, keys)
            lone = _lone(starts, ends)
            # as if every event were the only one of its bucket; longer runs are written over below
            levels = np.minimum(capacity, entry)
            out = levels >= cost
            levels = levels - np.where(out, cost, 0)
            for a, z in zip(starts[~lone].tolist(), ends[~lone].tolist(), strict=True):
                ident = keys[a], int(buckets[a])
                if ident != current:
                    current, level, last = ident, int(entry[a]), int(ts[a])
                for i, t in enumerate(ts[a:z].tolist(), a):
                    level = min(capacity, level + max(0, t - last))
                    last = t
                    ok = level >= cost
                    if ok:
                        level -= cost
                    out[i], levels[i] = ok, level
            yield pdf[[key, event_id]].assign(admitted=out, level_us=levels)
    return run


def token_bucket(events: DataFrame, key: str = "user_id", ts: str = "ts",
                 event_id: str = "event_id", rate_per_second: float = RATE_PER_SECOND,
                 burst: int = BURST, bucket_us: int = BUCKET_US) -> DataFrame:
    """Admission decision for every event: key, event id, admitted, level after (µs)."""
    cost, capacity = costs(rate_per_second, burst)
    kind, id_kind = (events.schema[c].dataType.simpleString() for c in (key, event_id))
    # keys pass as text: pandas would turn whole numbers beside a NULL into floats
    e = events.select(F.col(key).cast("string").alias("_k"), event_id,
                      epoch_micros(F.col(ts), events.schema[ts].dataType).alias("_t")) \
        .withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    order = ["_k", "_b", "_t", event_id]
    laid = e.repartition("_k", "_b")
    summaries = laid.sortWithinPartitions(*order).mapInPandas(
        _summarise("_k", cost, capacity),
        "_k string, _b long, first_t long, last_t long, firsts array<long>, moves array<boolean>, changes array<long>")
    entries = summaries.repartition("_k").sortWithinPartitions("_k", "_b").mapInPandas(
        _walk("_k", cost, capacity), "_k string, _b long, entry long") \
        .withColumnsRenamed({"_k": "_key", "_b": "_bucket"})
    placed = laid.join(entries, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")))
    return placed.select(*order, "entry").sortWithinPartitions(*order).mapInPandas(
        _fold("_k", event_id, cost, capacity), f"_k string, {event_id} {id_kind}, admitted boolean, level_us bigint") \
        .select(F.col("_k").cast(kind).alias(key), event_id, "admitted", "level_us")
