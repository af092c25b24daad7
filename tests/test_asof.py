"""As-of join and access at each request's own time."""

import datetime as dt
import random

import pytest

from muster.functions.tokens import token_hash
from muster.operators.access import access_asof
from muster.operators.asof import asof_join

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def sides():
    rnd = random.Random(2)
    left = [(i, rnd.choice(["hot", "hot", "hot", "a", "b", None, "only left"]), at(rnd.randint(0, 24 * 20) / 2)) for i in range(500)]
    left += [(900, "a", None), (901, "hot", at(-1000)), (902, "hot", at(10_000)), (902, "hot", at(10_000))]
    right = [(rnd.choice(["hot", "a", "b", "only right", None]), at(rnd.randint(-50, 24 * 20) / 2), n, rnd.choice([True, False, None]))
             for n in range(120)] + [("a", None, 500, True)]
    return left, right


def brute(left, right, tie=True):
    out = []
    for i, k, t in left:
        known = [(rt, n, v) for rk, rt, n, v in right if k is not None and rk == k and t is not None and rt is not None and rt <= t]
        best = max(known, key=lambda x: (x[0], x[1]), default=(None, None, None))
        out.append((i, k, t, best[2], best[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows,bucket", [(500_000, 86_400), (7, 86_400), (3, 3_600), (500_000, 10**9)])
def test_equals_brute_force(spark, sides, hot_rows, bucket):
    left, right = sides
    ldf = spark.createDataFrame(left, "id long, k string, t timestamp_ntz")
    rdf = spark.createDataFrame(right, "k string, since timestamp_ntz, n long, v boolean")
    got = asof_join(ldf, rdf, "k", "t", "since", ["v", "n"], tie="n", bucket_seconds=bucket, hot_rows=hot_rows)
    assert got.columns == ["id", "k", "t", "v", "n"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right)


def test_a_hot_key_is_many_groups(spark):
    """A third of the rows in one bucket of one key are dealt over salts."""
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) AS k", "timestamp_ntz'2024-01-01 10:00:00' AS t")
    right = spark.createDataFrame([("hot", at(1), 1)], "k string, since timestamp_ntz, v int")
    got = asof_join(left, right, "k", "t", "since", ["v"], hot_rows=50)
    assert got.where("v = 1").count() == 1000 and got.count() == 3000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_empty_sides_and_clashes(spark, sides):
    ldf = spark.createDataFrame(sides[0], "id long, k string, t timestamp_ntz")
    none = spark.createDataFrame([], "k string, since timestamp_ntz, v int")
    assert {r.v for r in asof_join(ldf, none, "k", "t", "since", ["v"]).collect()} == {None}
    assert asof_join(ldf.limit(0), none, "k", "t", "since", ["v"]).collect() == []
    with pytest.raises(ValueError, match="k"):
        asof_join(ldf, none, "k", "t", "since", ["k"])


def test_access_at_the_time_of_the_request(spark):
    text = {n: n * 26 for n in "ABCDE"}
    tokens = spark.createDataFrame(
        [(text["A"], "u1", "authentication", at(0), at(24)), (text["B"], "u2", "authentication", at(0), at(24)),
         (text["C"], "u1", "activation", at(0), at(24)), (text["D"], "u3", "authentication", at(0), at(24))],
        "token string, user_id string, scope string, issued_at timestamp_ntz, expiry timestamp_ntz") \
        .withColumn("hash", token_hash("token"))
    versions = spark.createDataFrame([("u1", at(-5), False), ("u1", at(10), True), ("u1", at(20), False), ("u2", at(5), None)],
                                     "user_id string, valid_from timestamp_ntz, activated boolean")
    b = "Bearer "
    cases = [  # header, guarded, hour, outcome
        (b + text["A"], True, 0, "inactive"), (b + text["A"], True, -1, "invalid_token"), (b + text["A"], True, 10, "allowed"),
        (b + text["A"], True, 23, "inactive"), (b + text["A"], True, 24, "invalid_token"), (b + text["A"], False, 1, "allowed"),
        (b + text["B"], True, 4, "invalid_token"), (b + text["B"], True, 6, "inactive"), (b + text["C"], True, 12, "invalid_token"),
        (b + text["D"], True, 12, "invalid_token"), (b + text["E"], True, 12, "invalid_token"), (None, True, 1, "unauthenticated"),
        (None, False, 1, "allowed"), ("", None, 1, "unauthenticated"), ("Basic x", False, 1, "invalid_token"),
        (b + "short", False, 1, "invalid_token"), (b, False, 1, "invalid_token")]
    req = spark.createDataFrame([(i, h, g, at(t)) for i, (h, g, t, _) in enumerate(cases)],
                                "id int, auth_header string, guarded boolean, at timestamp_ntz")
    got = {r.id: r for r in access_asof(req, tokens, versions).collect()}
    assert [got[i].outcome for i in range(len(cases))] == [c[3] for c in cases]
    assert got[2].user_id == "u1" and got[2].status == 200 and got[6].user_id is None and got[0].status == 403
