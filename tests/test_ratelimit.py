"""Token bucket: hand cases and a brute-force fold on a small fixture, batch and stream."""

import os
import tempfile

from muster_helpers import ts

from muster.operators.ratelimit import costs, token_bucket


def brute_force(events, rate, burst):
    cost, cap = costs(rate, burst)
    out, state = {}, {}
    for key, t, eid in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        us = int(t.timestamp() * 1_000_000) if hasattr(t, "timestamp") else t
        if key not in state:
            level, last = cap, us
        else:
            level, last = state[key]
            level = min(cap, level + max(0, us - last))
            last = max(last, us)
        ok = level >= cost
        if ok:
            level -= cost
        state[key] = (level, last)
        out[eid] = ok
    return out


def decide(spark, events, rate=2, burst=4):
    df = spark.createDataFrame(events, "user_id bigint, ts timestamp_ntz, event_id bigint")
    return {r.event_id: r.admitted for r in token_bucket(df, rate_per_second=rate,
                                                         burst=burst).collect()}


def t0(sec: float):
    return ts("2024-01-01 00:00:00") + __import__("datetime").timedelta(seconds=sec)


def test_burst_then_refill_boundary(spark):
    ev = [(1, t0(0), i) for i in range(6)] + [(1, t0(0.5), 10), (1, t0(0.999999), 11),
                                              (1, t0(1.0), 12)]
    got = decide(spark, ev)
    assert [got[i] for i in range(6)] == [True] * 4 + [False] * 2
    assert (got[10], got[11], got[12]) == (True, False, True)


def test_long_gap_refills_and_keys_are_independent(spark):
    ev = [(1, t0(0), 1), (1, t0(0), 2), (2, t0(0), 3), (1, t0(0), 4), (1, t0(0), 5),
          (1, t0(0), 6), (1, t0(3600), 7), (2, t0(0.1), 8)]
    got = decide(spark, ev)
    assert got == {1: True, 2: True, 4: True, 5: True, 6: False, 7: True, 3: True, 8: True}


def test_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    ev, eid = [], 0
    for key in range(5):
        t = 0.0
        for _ in range(300 if key == 0 else 40):  # key 0 is hot
            t += rnd.choice([0.01, 0.2, 0.4, 0.6, 3.0, 30.0])
            ev.append((key, t0(round(t, 6)), eid))
            eid += 1
    assert decide(spark, ev) == brute_force(ev, 2, 4)


def test_stream_equals_batch(spark):
    from muster.streaming.token_bucket import run_to_table, token_bucket_stream
    ev = [(k, t0(i * 0.3 + k), k * 1000 + i) for k in range(3) for i in range(50)]
    df = spark.createDataFrame(ev, "user_id bigint, ts timestamp_ntz, event_id bigint")
    src = tempfile.mkdtemp(prefix="muster-stream-src-")
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, "events"))
    out = run_to_table(spark, os.path.join(src, "events"), df.schema, lambda s: token_bucket_stream(s))
    got = {r.event_id: r.admitted for r in out.collect()}
    assert got == brute_force(ev, 2, 4)


def test_every_late_event_gets_a_decision(spark):
    """Files out of order, months apart: rows out = rows in, a late event refills nothing."""
    from muster.streaming.token_bucket import run_to_table, token_bucket_stream
    src = tempfile.mkdtemp(prefix="muster-late-src-")
    schema = "user_id bigint, ts timestamp_ntz, event_id bigint"
    starts = [86_400 * 90, 0, 86_400 * 30, 86_400 * 90 + 1]
    for i, start in enumerate(starts):
        ev = [(k, t0(start + j * 0.1), 100 * i + 10 * k + j) for k in range(2) for j in range(3)]
        spark.createDataFrame(ev, schema).coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
        path = os.path.join(src, f"part{i}")
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.utime(os.path.join(path, name), (1e9 + i * 100, 1e9 + i * 100))  # arrival order
    out = run_to_table(spark, os.path.join(src, "*"), schema, lambda s: token_bucket_stream(s),
                       max_files_per_trigger=1)
    got = {r.event_id: r.admitted for r in out.collect()}
    assert out.count() == 24 and len(got) == 24
    # the second file comes after the first emptied three of four tokens: one is left, nothing refills
    assert [got[100 + j] for j in range(3)] == [True, False, False]


def test_level_map_equals_the_fold():
    import random

    from muster.operators.ratelimit import LevelMap
    rnd = random.Random(3)
    most = 0
    for _ in range(60):
        cost = rnd.choice([1, 7, 10])
        capacity = cost * rnd.randrange(1, 6)
        level_map, gaps = LevelMap(cost, capacity), [rnd.randrange(0, 3 * cost) for _ in range(rnd.randrange(0, 80))]
        level_map.decide()
        for gap in gaps:
            level_map.refill(gap)
            level_map.decide()
        most = max(most, len(level_map.pieces))
        for level in range(capacity + 1):
            want = level - cost if level >= cost else level
            for gap in gaps:
                want = min(capacity, want + gap)
                want -= cost if want >= cost else 0
            assert level_map.apply(level) == want
    assert most <= 12  # a few pieces, however many events


def test_a_hot_key_is_folded_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from muster.operators.ratelimit import token_bucket
    n = 6_000  # ten events a second of one key at two tokens a second: one unbroken run
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("event_id"),
                               F.timestamp_add("MICROSECOND", F.col("id") * 100_000,
                                               F.expr("TIMESTAMP_NTZ '2024-01-01'")).alias("ts"))
    got = token_bucket(df, bucket_us=20_000_000)
    ev = [(1, t0(i / 10), i) for i in range(n)]
    assert {r.event_id: r.admitted for r in got.collect()} == brute_force(ev, 2, 4)
    spread = df.withColumn("b", F.floor(F.col("event_id") / 200)).repartition(16, "user_id", "b")
    assert spread.groupBy(F.spark_partition_id()).count().count() > 8


def test_null_keys_and_buckets_of_one_event(spark):
    ev = [(None, t0(i * 0.1), i) for i in range(10)] + [(5, t0(i * 4000.0), 100 + i) for i in range(4)]
    got = decide(spark, ev)
    assert [got[i] for i in range(10)] == [True] * 4 + [False] + [True] + [False] * 4
    assert all(got[100 + i] for i in range(4))


def test_buckets_of_one_event_need_no_map(monkeypatch):
    import pandas as pd

    from muster.operators import ratelimit as R
    made = []

    class Counted(R.LevelMap):
        def __init__(self, *a):
            made.append(a)
            super().__init__(*a)

    monkeypatch.setattr(R, "LevelMap", Counted)
    # key None and text keys, a bucket of three events within a batch, one that goes on in the next batch
    ev = [(None, b, b * 100) for b in range(50)] + [("7", 1, 5), ("7", 1, 6), ("7", 1, 7), ("7", 2, 100)] \
        + [("8", b, b * 100) for b in range(60)] + [("9", 3, 300), ("9", 3, 301)]
    pdf = pd.DataFrame(ev, columns=["_k", "_b", "_t"])
    out = pd.concat(R._summarise("_k", 10, 40)(iter([pdf[:20], pdf[20:20], pdf[20:115], pdf[115:]])))
    assert len(made) < 10
    got = {(None if pd.isna(k) else k, b): (first, last, firsts is None)
           for k, b, first, last, firsts in zip(out["_k"], out["_b"], out["first_t"], out["last_t"], out["firsts"])}
    assert len(got) == len(out) == 50 + 2 + 60 + 1
    assert got[("7", 1)] == (5, 7, False) and got[("9", 3)] == (300, 301, False) and got[("8", 9)] == (900, 900, True)
