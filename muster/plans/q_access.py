"""Registered queries: token registration, token → user join, access decisions, redemption."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from muster.operators import access as A
from muster.plans.catalog import ORACLE, query
from muster.functions.ids import key_uuid
from muster.plans.oracle_sql import AS_OF, TOKEN, uid, with_tables
from muster.plans.standins import AS_OF as AS_OF_TEXT
from muster.plans.standins import StandIns
from muster.schemas import SCOPE_AUTHENTICATION
from muster.session import checkpoint_dir
from muster.streaming.access import read_decisions, run_access_stream


@query("register_tokens", with_tables("tokens") + "SELECT hash, user_id, scope, expiry FROM tokens")
def register_tokens(t):
    """M7: one token per event; expiry = issue time + scope lifetime, to the nearest second."""
    return A.register_tokens(t.token_requests).select("hash", "user_id", "scope", "expiry")


@query("token_user_join", with_tables("tokens", "users") + f"""
    SELECT e.event_id, u.id AS user_id, u.email AS user_email, u.role AS user_role,
           u.activated AS user_activated, u.version AS user_version,
           u.created_at AS user_created_at
    FROM (SELECT event_id, {TOKEN} AS token FROM events) e
    JOIN tokens k ON k.hash = sha256(e.token)
    JOIN users u ON u.id = k.user_id
    WHERE k.scope = 'authentication' AND k.expiry > {AS_OF}""")
def token_user_join(t):
    """Every event presents its token as an authentication token at the fixed time."""
    presented = t.raw("events").select("event_id", StandIns.token_text().alias("token"))
    out = A.token_user_join(presented, t.tokens, t.users, SCOPE_AUTHENTICATION, AS_OF_TEXT)
    return out.select("event_id", "user_id", "user_email", "user_role", "user_activated",
                      "user_version", "user_created_at")


@query("access_decision", with_tables("requests", "tokens", "users") + f""",
    r AS (SELECT request_id, auth_header, guarded,
                 string_split(auth_header, ' ') AS parts FROM requests),
    s AS (SELECT *, CASE
            WHEN auth_header IS NULL OR auth_header = '' THEN 'anonymous'
            WHEN len(parts) <> 2 OR parts[1] <> 'Bearer' THEN 'invalid_token'
            WHEN parts[2] = '' OR strlen(parts[2]) <> 26 THEN 'invalid_token'
            ELSE 'lookup' END AS state FROM r),
    j AS (SELECT s.*, u.id AS uid, u.activated FROM s
          LEFT JOIN tokens k ON s.state = 'lookup' AND k.hash = sha256(s.parts[2])
               AND k.scope = 'authentication' AND k.expiry > {AS_OF}
          LEFT JOIN users u ON u.id = k.user_id),
    o AS (SELECT request_id, auth_header, guarded, uid AS user_id, CASE
            WHEN state = 'invalid_token' THEN 'invalid_token'
            WHEN state = 'lookup' AND uid IS NULL THEN 'invalid_token'
            WHEN state = 'anonymous' AND coalesce(guarded, TRUE) THEN 'unauthenticated'
            WHEN uid IS NOT NULL AND coalesce(guarded, TRUE) AND NOT coalesce(activated, FALSE)
              THEN 'inactive'
            ELSE 'allowed' END AS outcome FROM j)
    SELECT request_id, auth_header, guarded, user_id, outcome,
           CASE outcome WHEN 'allowed' THEN 200 WHEN 'invalid_token' THEN 401
                WHEN 'unauthenticated' THEN 401 WHEN 'inactive' THEN 403 END AS status
    FROM o""")
def access_decision(t):
    """J2 over the request log derived from events."""
    return A.access_decision(t.requests, t.tokens, t.users, AS_OF_TEXT)


@query("access_asof", with_tables("tokens") + f""",
    issued AS (SELECT sha256({TOKEN}) AS hash, ts AS issued_at FROM events),
    live AS (SELECT k.*, i.issued_at FROM tokens k JOIN issued i USING (hash) WHERE k.scope = 'authentication'),
    v AS (SELECT {uid('user_id')} AS user_id, ts AS valid_from, value >= 20 AS activated, event_id FROM events
          WHERE event_type IN ('signup', 'error')),
    r AS (SELECT event_id AS request_id, ts AS requested_at, event_type <> 'view' AS guarded, CASE WHEN value >= 5 THEN
            'Bearer ' || lpad(CAST(event_id - event_id % 3 AS VARCHAR), 26, 'A') END AS auth_header FROM events),
    j AS (SELECT r.*, k.user_id AS uid FROM r LEFT JOIN live k ON k.hash = sha256(substr(r.auth_header, 8))
          AND k.issued_at <= r.requested_at AND r.requested_at < k.expiry),
    w AS (SELECT j.request_id, arg_max(v.activated, (v.valid_from, v.event_id)) AS active
          FROM j JOIN v ON v.user_id = j.uid AND v.valid_from <= j.requested_at GROUP BY j.request_id),
    o AS (SELECT j.request_id, j.requested_at, CASE WHEN active IS NOT NULL THEN j.uid END AS user_id, CASE
            WHEN auth_header IS NULL AND guarded THEN 'unauthenticated' WHEN auth_header IS NULL THEN 'allowed'
            WHEN active IS NULL THEN 'invalid_token' WHEN guarded AND NOT active THEN 'inactive' ELSE 'allowed' END AS outcome
          FROM j LEFT JOIN w USING (request_id))
    SELECT request_id, requested_at, user_id, outcome, CASE outcome WHEN 'allowed' THEN 200 WHEN 'inactive' THEN 403 ELSE 401 END AS status
    FROM o""")
def access_asof(t):
    """J2 at each request's own time: a request presents the token of an event shortly before it; signup and
    error events are versions of their user."""
    requests, versions = _asof_log(t)
    return A.access_asof(requests, A.token_periods(t.token_requests), versions, at_col="requested_at",
                         version_tie="event_id").select(
        "request_id", "requested_at", "user_id", "outcome", "status")


def _asof_log(t):
    e = t.raw("events")
    token = F.lpad((F.col("event_id") - F.col("event_id") % 3).cast("string"), 26, "A")
    requests = e.select(F.col("event_id").alias("request_id"), F.col("ts").alias("requested_at"),
                        (F.col("event_type") != "view").alias("guarded"),
                        F.when(F.col("value") >= 5, F.concat(F.lit("Bearer "), token)).alias("auth_header"))
    versions = e.where(F.col("event_type").isin("signup", "error")).select(
        key_uuid("user_id").alias("user_id"), F.col("ts").alias("valid_from"),
        (F.col("value") >= 20).alias("activated"), "event_id")
    return requests, versions


@query("access_stream", ORACLE["access_asof"])
def access_stream(t):
    """J1/J2 on Structured Streaming: the same log and tokens as two streams of files. Each ends with a mark of
    a far later time that moves the watermark past the last request; the marks are no requests of the log."""
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/access-{uuid.uuid4().hex}"
    requests, versions = _asof_log(t)
    tokens = A.token_periods(t.token_requests)
    mark = F.expr("timestamp_ntz'9000-01-01 00:00:00'")
    end = t.spark.range(1)
    last = {"requests": end.select(F.lit(-1).cast("bigint").alias("request_id"), mark.alias("requested_at"), F.lit(True).alias("guarded"),
                                   F.concat(F.lit("Bearer "), F.repeat(F.lit("-"), 26)).alias("auth_header")),
            "tokens": end.select(F.lit("-").alias("hash"), F.lit("-").alias("user_id"), F.lit(SCOPE_AUTHENTICATION).alias("scope"),
                                 mark.alias("issued_at"), mark.alias("expiry"))}
    streams = {}
    for name, df in (("requests", requests), ("tokens", tokens)):
        df.unionByName(last[name]).write.parquet(f"{folder}/{name}")
        streams[name] = t.spark.readStream.schema(df.schema).parquet(f"{folder}/{name}")
    run = run_access_stream(streams["requests"], streams["tokens"], lambda: versions, f"{folder}/out",
                            at_col="requested_at", version_tie="event_id")
    run.awaitTermination()
    if run.exception() is not None:
        raise RuntimeError(str(run.exception()))
    return read_decisions(t.spark, f"{folder}/out").where("request_id >= 0").select(
        "request_id", "requested_at", "user_id", "outcome", "status")


_METHOD = "CASE event_type WHEN 'click' THEN 'GET' WHEN 'purchase' THEN 'POST' WHEN 'view' THEN 'PATCH' ELSE 'DELETE' END"
_PATH = ("CASE user_id % 4 WHEN 0 THEN concat('/v1/officers/', user_id) WHEN 1 THEN '/v1/users' "
         "WHEN 2 THEN concat('/v1/users/', user_id) ELSE '/v1/nothing' END")
_HEADER = ("CASE WHEN value < 20 THEN NULL WHEN value < 30 THEN 'Basic x' "
           "ELSE concat('Bearer ', {token}) END")


@query("route_access", with_tables("tokens", "users") + f"""
    , q AS (SELECT event_id AS request_id, {_METHOD} AS method, {_PATH} AS path, {_HEADER.format(token=TOKEN)} AS h,
                   user_id % 4 AS kind FROM events),
    j AS (SELECT q.*, u.id AS uid, u.activated,
                 CASE WHEN kind = 3 THEN NULL WHEN kind = 1 AND method = 'GET' THEN TRUE
                      WHEN kind = 1 AND method = 'POST' THEN FALSE
                      WHEN kind = 2 AND method IN ('GET', 'PATCH', 'DELETE') THEN FALSE
                      WHEN kind = 0 AND method = 'GET' THEN FALSE
                      WHEN kind = 0 AND method IN ('PATCH', 'DELETE') THEN TRUE END AS guarded
          FROM q LEFT JOIN tokens k ON k.hash = sha256(substr(q.h, 8)) AND q.h LIKE 'Bearer %'
               AND k.scope = 'authentication' AND k.expiry > {AS_OF}
          LEFT JOIN users u ON u.id = k.user_id),
    o AS (SELECT request_id, method, path, CASE
            WHEN h IS NOT NULL AND uid IS NULL THEN 'invalid_token'
            WHEN kind = 3 THEN 'not_found' WHEN guarded IS NULL THEN 'method_not_allowed'
            WHEN guarded AND h IS NULL THEN 'unauthenticated' WHEN guarded AND NOT activated THEN 'inactive'
            ELSE 'allowed' END AS outcome FROM j)
    SELECT *, CASE outcome WHEN 'allowed' THEN 200 WHEN 'not_found' THEN 404 WHEN 'method_not_allowed' THEN 405
              WHEN 'inactive' THEN 403 ELSE 401 END AS status FROM o""")
def route_access(t):
    """J2 with the route table: every event is a request whose method and path come from its columns."""
    e = t.raw("events").withColumn("_token", StandIns.token_text())
    requests = e.selectExpr("event_id AS request_id", f"{_METHOD} AS method", f"{_PATH} AS path",
                            f"{_HEADER.format(token='_token')} AS auth_header")
    return A.route_access(requests, t.tokens, t.users, AS_OF_TEXT).select(
        "request_id", "method", "path", "outcome", "status")


@query("redeem_tokens", with_tables("tokens") + f""",
    p AS (SELECT event_id, {TOKEN} AS token FROM events),
    r AS (SELECT p.*, k.user_id AS tu FROM p LEFT JOIN tokens k ON k.hash = sha256(p.token)
            AND k.scope = 'activation' AND k.expiry > {AS_OF}),
    f AS (SELECT tu, min(event_id) AS first FROM r WHERE tu IS NOT NULL GROUP BY tu)
    SELECT r.event_id, r.token, CASE WHEN r.event_id = f.first THEN r.tu END AS user_id,
           CASE WHEN r.event_id = f.first THEN 'activated' ELSE 'invalid_token' END AS outcome
    FROM r LEFT JOIN f ON r.tu = f.tu""")
def redeem_tokens(t):
    """M6: every event presents its token; only live activation tokens redeem."""
    presented = t.raw("events").select("event_id", StandIns.token_text().alias("token"))
    _, _, report = A.redeem_tokens(presented, t.tokens, t.users, AS_OF_TEXT,
                                   order_col="event_id")
    return report.select("event_id", "token", "user_id", "outcome")


@query("redeemed_users", with_tables("tokens", "users") + f""",
    p AS (SELECT {TOKEN} AS token FROM events),
    hit AS (SELECT DISTINCT k.user_id FROM p JOIN tokens k ON k.hash = sha256(p.token)
            AND k.scope = 'activation' AND k.expiry > {AS_OF})
    SELECT u.id, CASE WHEN h.user_id IS NOT NULL THEN TRUE ELSE u.activated END AS activated,
           CAST(CASE WHEN h.user_id IS NOT NULL THEN u.version + 1 ELSE u.version END AS INTEGER)
             AS version
    FROM users u LEFT JOIN hit h ON u.id = h.user_id""")
def redeemed_users(t):
    """M6 new users snapshot: redeemed users activated, version + 1."""
    presented = t.raw("events").select("event_id", StandIns.token_text().alias("token"))
    users, _, _ = A.redeem_tokens(presented, t.tokens, t.users, AS_OF_TEXT)
    return users.select("id", "activated", "version")


@query("redeemed_tokens", with_tables("tokens") + f""",
    p AS (SELECT {TOKEN} AS token FROM events),
    hit AS (SELECT DISTINCT k.user_id FROM p JOIN tokens k ON k.hash = sha256(p.token)
            AND k.scope = 'activation' AND k.expiry > {AS_OF})
    SELECT hash, user_id, expiry, scope FROM tokens k
    WHERE NOT (scope = 'activation' AND EXISTS (SELECT 1 FROM hit h WHERE h.user_id = k.user_id))""")
def redeemed_tokens(t):
    """M6 new tokens snapshot: every activation token of an activated user is gone."""
    presented = t.raw("events").select("event_id", StandIns.token_text().alias("token"))
    return A.redeem_tokens(presented, t.tokens, t.users, AS_OF_TEXT)[1].select("hash", "user_id", "expiry", "scope")
