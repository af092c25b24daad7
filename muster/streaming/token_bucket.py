"""Keyed token bucket on Structured Streaming (T1 stream form + T2 idle eviction).

``groupBy(key).applyInPandasWithState`` keeps per key only (level µs, last event µs).
Inside a micro-batch the key's events are taken in (time, id) order; an event older
than the stored last time refills nothing (zero elapsed time), as the reference's
limiter does for a clock that went backwards.

Every event gets a decision, however late. Spark drops rows behind the watermark of a
stateful operator, so the watermarked column runs ``NEVER_LATE`` ahead of the event time and the
watermark's delay takes it back: the watermark is the largest event time seen, and only an event
older than that by a century could be behind it.

Idle eviction (T2): state is dropped once the key has been idle (by event time,
watermark-driven) for ``max(idle_evict_s, capacity)``. Past the capacity a bucket is
full again, so eviction only bounds memory: it changes no decision on events newer than the
evicted state, and an event still older than that meets a full bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from muster.functions.time import epoch_micros
from muster.operators.ratelimit import BURST, IDLE_EVICT_SECONDS, RATE_PER_SECOND, US, costs
from muster.session import checkpoint_dir


NEVER_LATE_DAYS = 36_500
SLICE = 100_000  # decisions handed back at once


def _bucket_fn(key: str, event_id: str, cost: int, capacity: int, idle_us: int):
    def fn(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # of the key's events only the times and ids are held (16 bytes each), to order them
        parts = [(pdf["_t"].to_numpy(dtype=np.int64), pdf[event_id].to_numpy()) for pdf in pdfs]
        ts, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, ts))
        ts, ids = ts[order], ids[order]
        level, last = state.get if state.exists else (capacity, int(ts[0]))
        for at in range(0, len(ts), SLICE):
            part = ts[at:at + SLICE].tolist()
            out = np.empty(len(part), dtype=bool)
            lv = np.empty(len(part), dtype=np.int64)
            for i, t in enumerate(part):
                if t > last:
                    level = min(capacity, level + t - last)
                    last = t
                ok = level >= cost
                if ok:
                    level -= cost
                out[i], lv[i] = ok, level
            yield pd.DataFrame({key: [k[0]] * len(part), event_id: ids[at:at + SLICE],
                                "admitted": out, "level_us": lv})
        state.update((int(level), int(last)))
        # a key whose events are all long past is idle already: evict it in the next batch
        state.setTimeoutTimestamp(max((last + idle_us) // 1000, state.getCurrentWatermarkMs() + 1))
    return fn


def token_bucket_stream(stream: DataFrame, key: str = "user_id", ts: str = "ts",
                        event_id: str = "event_id", rate_per_second: float = RATE_PER_SECOND,
                        burst: int = BURST, idle_evict_s: int = IDLE_EVICT_SECONDS) -> DataFrame:
    """Streaming admission decisions (append mode), one per event: key, event id, admitted, level."""
    cost, capacity = costs(rate_per_second, burst)
    idle_us = max(idle_evict_s * US, capacity)
    s = (stream.select(key, ts, event_id)
         .withColumn("_t", epoch_micros(F.col(ts), stream.schema[ts].dataType))
         .withColumn("_ets", F.timestamp_micros(F.col("_t") + F.lit(NEVER_LATE_DAYS * 86_400 * US)))
         .withWatermark("_ets", f"{NEVER_LATE_DAYS} days"))
    kt = stream.schema[key].dataType.simpleString()
    it = stream.schema[event_id].dataType.simpleString()
    return s.groupBy(key).applyInPandasWithState(
        _bucket_fn(key, event_id, cost, capacity, idle_us),
        f"{key} {kt}, {event_id} {it}, admitted boolean, level_us bigint",
        "level long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(spark: SparkSession, source: str, schema, transform,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Drive a stream of Parquet files (a folder, or a glob over files or folders) to completion (``availableNow``)
    into a Parquet sink in the shared checkpoint folder, and read the sink back.

    By default a micro-batch takes all files that are there; a limit is the caller's choice.
    """
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (transform(reader.parquet(source)).writeStream.format("parquet")
         .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/out")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{base}/out")
