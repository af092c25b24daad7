"""Version-checked updates in sequence: the outcome of running a batch of requests one after another.

``mutate.optimistic_update`` compares a batch with the table as it stands before. Here a request sees what
the requests before it have done: the versions 1, 2, 3 of one row in one batch all apply, and a value of a unique key
that one request gives up can be taken by a later one.

Rows without a common value of a unique key do not touch each other, so all ids are folded in parallel, a
task streaming its ids in order with one row's state. What couples ids is who holds a value when: a request
is blocked if another id holds the value it wants. That is found in rounds. Each round folds the ids with the
blocked requests of the round before and derives the time line of every contested value; the time lines tell
which requests are blocked. A request's outcome depends on earlier requests alone, so after as many rounds
as the longest chain of hand-overs nothing changes any more, and what stands then is the sequential result.
Only values that two ids hold or want, and the ids that hold or want them, take part in the rounds.

A hot value's time line is split by ranges of the sequence number, with what is held before each range carried
over; it is never one task. A hot id is one stream (its requests depend on each other), in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.session import pin

RANGES = 64  # pieces of a value's time line

_OUTCOMES = ("updated", "conflict", "duplicate", "violation")


def _fold(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Requests sorted by id and sequence: outcome, version after, and the values held before each."""
    current, version, values = object(), 0, []
    names = ["outcome", "version", *[f"held{i}" for i in range(held)]]
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("id", "stored", "expected", "broken", "blocked")}
        new, old = ([batch.column(f"{kind}{i}").to_pylist() for i in range(held)] for kind in ("new", "old"))
        out: list[list] = [[] for _ in names]
        for r in range(batch.num_rows):
            if cols["id"][r] != current:
                current, version, values = cols["id"][r], cols["stored"][r], [o[r] for o in old]
            for i in range(held):
                out[2 + i].append(values[i])
            expected = cols["expected"][r]
            if expected is not None and expected != version:
                out[0].append(1)
            elif cols["broken"][r]:
                out[0].append(3)
            elif cols["blocked"][r]:
                out[0].append(2)
            else:
                out[0].append(0)
                version += 1
                values = [n[r] for n in new]
            out[1].append(version)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("seq"), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()),
             *[pa.array(c, pa.string()) for c in out[2:]]], names=["id", "seq", *names])


def _value(columns, prefix: str = "") -> Column:
    """A unique key's value as one string; NULL if a part is NULL."""
    parts = [F.col(f"{prefix}{c}") for c in columns]
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(whole, F.to_json(F.array(*[p.cast("string") for p in parts])))


def _folded(requests: DataFrame, blocked: DataFrame, held: int) -> DataFrame:
    kinds = dict(requests.dtypes)
    rows = requests.join(blocked.withColumn("blocked", F.lit(True)), "seq", "left").withColumn(
        "blocked", F.coalesce("blocked", F.lit(False)))
    schema = ", ".join([f"id {kinds['id']}", f"seq {kinds['seq']}", "outcome int", "version int",
                        *[f"held{i} string" for i in range(held)]])
    return rows.repartition("id").sortWithinPartitions("id", "seq").mapInArrow(lambda b: _fold(b, held), schema)


def _blocked(folded: DataFrame, requests: DataFrame, base_holds: DataFrame, i: int, width: int) -> DataFrame:
    """seq of the requests that want a value which another id holds at their time."""
    done = folded.join(requests.select("seq", F.col(f"new{i}").alias("want")), "seq")
    had = F.col(f"held{i}")
    took = (F.col("outcome") == 0) & ~F.coalesce(had == F.col("want"), had.isNull() & F.col("want").isNull())
    moves = done.where(took).select("seq", F.explode(F.array(
        F.struct(had.alias("value"), F.lit(-1).alias("d")), F.struct(F.col("want").alias("value"), F.lit(1).alias("d")))).alias("m"))
    none = F.lit(None).cast("boolean")
    events = (base_holds.select("value", F.lit(None).cast("long").alias("seq"), F.lit(1).alias("d"), none.alias("own"))
              .unionByName(moves.select("m.value", "seq", "m.d", none.alias("own")))
              .unionByName(done.select(F.col("want").alias("value"), "seq", F.lit(0).alias("d"),
                                       F.coalesce(had == F.col("want"), F.lit(False)).alias("own"))).where("value is not null")
              .withColumn("range", F.coalesce(F.floor(F.col("seq") / width), F.lit(-1)).cast("long")))
    per = events.groupBy("value", "range").agg(F.sum("d").alias("net"))
    earlier = Window.partitionBy("value").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("before", F.coalesce(F.sum("net").over(earlier), F.lit(0))).drop("net")
    # a request sees what was moved before it, not its own move
    so_far = Window.partitionBy("value", "range").orderBy("seq", F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = events.join(before, ["value", "range"]).withColumn("held", F.sum("d").over(so_far) + F.col("before"))
    return held.where(F.col("own").isNotNull() & (F.col("held") > F.col("own").cast("int"))).select("seq")


def update_sequence(base: DataFrame, patches: DataFrame, columns, key: str = "id", expected_col: str = "expected_version",
                    seq_col: str = "seq", unique_keys=(), violations=None):
    """Full updates applied in the order of ``seq`` (integers from 0, unique). Returns ``(new_base, report)``.

    A request applies if its row exists, its expected version is the row's version at that time (NULL: any),
    it breaks no constraint (``violations`` as in ``mutate.optimistic_update``), and no other row then
    holds a value of a unique key it writes (``unique_keys`` within ``columns``; NULLs are exempt). Report: key, seq,
    expected version, outcome (updated / conflict / duplicate / not_found / a violation) and the row's version
    after the request. The rows of the report and the snapshot keep the base's types.
    """
    keys = [k for k in unique_keys if k != (key,) and all(c in columns for c in k)]
    stored = base.select(F.col(key).alias("_k"), F.col("version").alias("_stored"),
                         *[_value(k).alias(f"_old{i}") for i, k in enumerate(keys)])
    p = patches.join(stored, patches[key] == stored["_k"], "left").drop("_k")
    p = violations(p) if violations else p.withColumn("_violation", F.lit(None).cast("string"))
    p = pin(p)
    known = p.where("_stored is not null")
    requests = known.select(
        F.col(key).alias("id"), F.col(seq_col).cast("long").alias("seq"), F.col("_stored").alias("stored"),
        F.col(expected_col).alias("expected"), F.col("_violation").isNotNull().alias("broken"),
        *[c for i, k in enumerate(keys) for c in (_value(k).alias(f"new{i}"), F.col(f"_old{i}").alias(f"old{i}"))])
    nothing = requests.select("seq").limit(0)
    blocked = nothing
    if keys:
        wants = [requests.select("id", F.col(f"new{i}").alias("value"), F.lit(i).alias("k")) for i in range(len(keys))]
        all_wants = reduce(DataFrame.unionByName, wants).where("value is not null")
        holds = reduce(DataFrame.unionByName, [
            base.select(F.col(key).alias("id"), _value(k).alias("value"), F.lit(i).alias("k")) for i, k in enumerate(keys)])
        wanted = all_wants.select("value", "k").distinct()
        holds = holds.join(wanted, ["value", "k"], "left_semi")
        contested = pin(all_wants.unionByName(holds).groupBy("value", "k").agg(F.min("id").alias("a"), F.max("id").alias("b"))
                        .where("a <> b").select("value", "k"))
        holds = pin(holds.join(contested, ["value", "k"], "left_semi"))
        touched = reduce(DataFrame.unionByName, [
            requests.select("id", F.col(f"{kind}{i}").alias("value"), F.lit(i).alias("k"))
            for i in range(len(keys)) for kind in ("new", "old")])
        playing = pin(requests.join(touched.join(contested, ["value", "k"], "left_semi").select("id").distinct(), "id", "left_semi"))
        last = playing.agg(F.max("seq")).first()[0]
        width, mark = max(1, ((last or 0) + RANGES) // RANGES), None
        while last is not None:
            folded = pin(_folded(playing, blocked, len(keys)))
            found = reduce(DataFrame.unionByName, [
                _blocked(folded, playing, holds.where(F.col("k") == i).select("value"), i, width) for i in range(len(keys))])
            blocked = pin(found.distinct())
            now = blocked.agg(F.count(F.lit(1)), F.sum(F.xxhash64("seq").cast("decimal(38,0)"))).first()
            if tuple(now) == mark:
                break
            mark = tuple(now)
    outcome = F.element_at(F.array(*[F.lit(o) for o in _OUTCOMES]), F.col("outcome") + 1)
    folded = _folded(requests, blocked, len(keys)).select(F.col("seq").alias("_seq"), outcome.alias("_outcome"),
                                                          F.col("version").alias("_version"))
    done = pin(p.join(folded, p[seq_col] == folded["_seq"], "left"))
    report = done.select(
        key, seq_col, expected_col,
        F.when(F.col("_outcome").isNull(), "not_found").when(F.col("_outcome") == "violation", F.col("_violation"))
        .otherwise(F.col("_outcome")).alias("outcome"), F.col("_version").cast("int").alias("version"))
    winners = done.where("_outcome = 'updated'").groupBy(F.col(key).alias("_pk")).agg(
        F.max_by(F.struct(*[F.col(c).alias(f"_new_{c}") for c in columns]), F.col(seq_col)).alias("_p"),
        F.max("_version").alias("_version")).select("_pk", "_version", "_p.*")
    merged, hit = base.join(winners, base[key] == winners["_pk"], "left"), F.col("_pk").isNotNull()
    names = {**{c: F.col(f"_new_{c}") for c in columns}, "version": F.col("_version")}
    new_base = merged.select(*chain(
        F.when(hit, names[c].cast(base.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
        for c in base.columns))
    return new_base, report
