"""Updates in sequence against running them one by one; hand-overs, swaps and cycles."""

import random

import pytest

from muster.operators.sequence import update_sequence

BASE = "id string, email string, number int, version int"
PATCH = "id string, seq long, expected_version int, email string, number int"


def one_by_one(base, patches, keys):
    state = {i: {"email": e, "number": n, "version": v} for i, e, n, v in base}
    report = []
    for i, seq, expected, email, number in sorted(patches, key=lambda p: p[1]):
        new = {"email": email, "number": number}
        row = state.get(i)
        if row is None:
            report.append((i, seq, "not_found", None))
            continue
        if expected is not None and expected != row["version"]:
            outcome = "conflict"
        elif any(all(new[c] is not None for c in k) and any(o != i and all(r[c] == new[c] for c in k) for o, r in state.items())
                 for k in keys):
            outcome = "duplicate"
        else:
            outcome = "updated"
            row.update(new, version=row["version"] + 1)
        report.append((i, seq, outcome, row["version"]))
    return sorted((i, r["email"], r["number"], r["version"]) for i, r in state.items()), sorted(report, key=repr)


def run(spark, base, patches, keys):
    snapshot, report = update_sequence(spark.createDataFrame(base, BASE), spark.createDataFrame(patches, PATCH),
                                       ["email", "number"], unique_keys=keys)
    return (sorted((r.id, r.email, r.number, r.version) for r in snapshot.collect()),
            sorted(((r.id, r.seq, r.outcome, r.version) for r in report.collect()), key=repr))


def check(spark, base, patches, keys=(("email",),)):
    got = run(spark, base, patches, keys)
    assert got == one_by_one(base, patches, keys)
    return {(i, s): o for i, s, o, _ in got[1]}


def test_versions_of_one_row_chain(spark):
    base = [("a", "a@x", 1, 1)]
    out = check(spark, base, [("a", s, s + 1, f"a{s}@x", s) for s in range(3)] + [("a", 5, 2, "late@x", 9), ("z", 6, None, "z@x", 0)])
    assert [out["a", s] for s in range(3)] == ["updated"] * 3 and out["a", 5] == "conflict" and out["z", 6] == "not_found"


def test_a_freed_address_is_taken(spark):
    base = [("a", "one@x", 1, 1), ("b", "two@x", 2, 1)]
    out = check(spark, base, [("b", 0, None, "one@x", 2), ("a", 1, None, "free@x", 1), ("b", 2, None, "one@x", 2), ("a", 3, None, "one@x", 1)])
    assert [out[k] for k in (("b", 0), ("a", 1), ("b", 2), ("a", 3))] == ["duplicate", "updated", "updated", "duplicate"]


def test_swap_and_cycle_over_a_spare_value(spark):
    base = [(n, f"{n}@x", i, 1) for i, n in enumerate("abc")]
    swap = [("a", 0, None, "b@x", 0), ("a", 1, None, "spare@x", 0), ("b", 2, None, "a@x", 1), ("a", 3, None, "b@x", 0)]
    out = check(spark, base, swap)
    assert [out[k] for k in (("a", 0), ("a", 1), ("b", 2), ("a", 3))] == ["duplicate", "updated", "updated", "updated"]
    cycle = [("a", 0, 1, "spare@x", 0), ("b", 1, 1, "a@x", 1), ("c", 2, 1, "b@x", 2), ("a", 3, 2, "c@x", 0)]
    assert set(check(spark, base, cycle).values()) == {"updated"}
    stuck = [("a", 0, 1, "b@x", 0), ("b", 1, 1, "c@x", 1), ("c", 2, 1, "a@x", 2)]
    assert set(check(spark, base, stuck).values()) == {"duplicate"}


def test_a_long_chain_of_hand_overs(spark):
    """Each request waits for the one before it: as many rounds as hand-overs."""
    base = [(f"u{i}", f"{i}@x", i, 1) for i in range(12)]
    chain = [("u0", 0, None, "spare@x", 0)] + [(f"u{i}", i, None, f"{i - 1}@x", i) for i in range(1, 12)]
    assert set(check(spark, base, chain).values()) == {"updated"}
    assert set(check(spark, base, chain[1:]).values()) == {"duplicate"}


@pytest.mark.parametrize("seed", range(4))
def test_random_batches(spark, seed):
    rnd = random.Random(seed)
    base = [(f"u{i}", rnd.choice([f"m{i}@x", f"m{i}@x", None]), i if i % 4 else None, rnd.randint(1, 3)) for i in range(25)]
    patches = [(f"u{rnd.choice([0, 0, 0, *range(27)])}", s, rnd.choice([None, None, 1, 2, 3, 4]),
                rnd.choice(["hot@x", "hot@x", None, *[f"m{i}@x" for i in range(25)]]), rnd.choice([None, *range(25)]))
               for s in rnd.sample(range(100_000), 160)]
    check(spark, base, patches)
    check(spark, base, patches, (("email",), ("email", "number")))


def test_violations_null_keys_and_empty_batches(spark):
    from pyspark.sql import functions as F
    base = [("a", None, 1, 1), ("b", None, 2, 1)]
    assert set(check(spark, base, [("a", 0, None, None, 3), ("b", 1, None, None, 3)]).values()) == {"updated"}
    df = spark.createDataFrame(base, BASE)
    judge = lambda p: p.withColumn("_violation", F.when(F.col("number") < 0, "check_violation"))
    patches = spark.createDataFrame([("a", 0, None, "x@x", -1), ("b", 1, None, "x@x", 5), ("a", 2, 1, "y@x", 6)], PATCH)
    snapshot, report = update_sequence(df, patches, ["email", "number"], unique_keys=[("email",)], violations=judge)
    assert [r.outcome for r in report.orderBy("seq").collect()] == ["check_violation", "updated", "updated"]
    assert snapshot.schema == df.schema and snapshot.where("version = 2").count() == 2
    snapshot, report = update_sequence(df, patches.limit(0), ["email", "number"], unique_keys=[("email",)])
    assert report.collect() == [] and snapshot.count() == 2
