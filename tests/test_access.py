"""Token lookup (the reference's user-for-token test) and access decisions."""

import pytest
from muster_helpers import rows, ts

from muster.operators import access as A

NOW = "2024-01-15 12:00:00"
TOK = "A" * 26


@pytest.fixture()
def world(spark):
    users = spark.createDataFrame(
        [("u1", "a@b.org", "admin", True, 1, ts("2024-01-01 00:00:00")),
         ("u2", "c@d.org", "viewer", False, 1, ts("2024-01-01 00:00:00"))],
        "id string, email string, role string, activated boolean, version int, "
        "created_at timestamp_ntz")
    reqs = spark.createDataFrame(
        [(TOK, "u1", "authentication", ts("2024-01-15 00:00:00")),
         ("B" * 26, "u1", "authentication", ts("2024-01-01 00:00:00")),  # expired
         ("C" * 26, "u2", "authentication", ts("2024-01-15 00:00:00")),
         ("D" * 26, "u2", "activation", ts("2024-01-15 00:00:00"))],
        "token string, user_id string, scope string, issued_at timestamp_ntz")
    return users, A.register_tokens(reqs)


def test_expiry_rounds_to_second(spark):
    df = spark.createDataFrame([("t", "u", "password-reset", ts("2024-01-01 00:00:00.600000"))],
                               "token string, user_id string, scope string, issued_at timestamp_ntz")
    assert A.register_tokens(df).collect()[0].expiry == ts("2024-01-01 00:45:01")


def test_token_user_join(spark, world):
    users, tokens = world
    presented = spark.createDataFrame([(1, TOK), (2, "B" * 26), (3, "D" * 26), (4, "Z" * 26)],
                                      "rid int, token string")
    got = A.token_user_join(presented, tokens, users, "authentication", NOW)
    assert rows(got, "rid", "user_email") == [(1, "a@b.org")]


def test_access_decisions(spark, world):
    users, tokens = world
    reqs = spark.createDataFrame(
        [(1, None, True), (2, None, False), (3, "Bearer " + TOK, True), (4, "Token " + TOK, False),
         (5, "Bearer " + TOK + " x", True), (6, "Bearer short", True), (7, "Bearer " + "B" * 26, True),
         (8, "Bearer " + "C" * 26, True), (9, "Bearer " + "C" * 26, False), (10, "Bearer", True)],
        "rid int, auth_header string, guarded boolean")
    got = dict(rows(A.access_decision(reqs, tokens, users, NOW), "rid", "outcome"))
    assert got == {1: "unauthenticated", 2: "allowed", 3: "allowed", 4: "invalid_token",
                   5: "invalid_token", 6: "invalid_token", 7: "invalid_token", 8: "inactive",
                   9: "allowed", 10: "invalid_token"}


def test_redeem_activates_once_and_removes_tokens(spark, world):
    users, tokens = world
    presented = spark.createDataFrame([("D" * 26,), ("C" * 26,)], "token string")
    new_users, new_tokens, rep = A.redeem_tokens(presented, tokens, users, NOW)
    assert sorted(rows(rep, "token", "outcome")) == [("C" * 26, "invalid_token"),
                                                    ("D" * 26, "activated")]
    u2 = new_users.where("id = 'u2'").collect()[0]
    assert (u2.activated, u2.version) == (True, 2)
    assert new_tokens.where("scope = 'activation'").count() == 0


def test_same_token_presented_twice_activates_once(spark, world):
    users, tokens = world
    presented = spark.createDataFrame([(1, "D" * 26), (2, "D" * 26)], "rid int, token string")
    _, _, rep = A.redeem_tokens(presented, tokens, users, NOW, order_col="rid")
    assert sorted(rows(rep, "rid", "outcome")) == [(1, "activated"), (2, "invalid_token")]
