"""Credentials: token registration, token → user join, access decisions, redemption.

Join strategy: tokens and users are unbounded tables, so no broadcast hint is
given; Catalyst picks broadcast only when its size estimate is under
``spark.sql.autoBroadcastJoinThreshold`` and AQE re-plans from real shuffle sizes.
The live-token predicate (scope, expiry) is applied before the join so it reaches
the scan. The token hash is uniformly distributed, so the hash join cannot skew;
the user join can (one user presenting a third of the tokens): AQE's skew-join
split handles that, and the users side has one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.time import as_of_literal, utc_as
from muster.functions.tokens import token_hash
from muster.operators.asof import asof_join
from muster.schemas import ROUTES, SCOPE_ACTIVATION, SCOPE_AUTHENTICATION, TOKEN_LIFETIME_SECONDS, \
    TOKEN_TEXT_BYTES


def token_lifetime_seconds(scope: Column) -> Column:
    expr = None
    for s, secs in TOKEN_LIFETIME_SECONDS.items():
        expr = F.when(scope == s, F.lit(secs)) if expr is None else expr.when(scope == s, F.lit(secs))
    return expr


def round_to_second(ts: Column) -> Column:
    """Timestamp rounded to the nearest whole second (half up), as a TIMESTAMP(0) column stores it."""
    return F.date_trunc("second", F.timestamp_add("MICROSECOND", F.lit(500_000), ts))


def register_tokens(requests: DataFrame, token_col: str = "token", user_col: str = "user_id",
                    scope_col: str = "scope", issued_col: str = "issued_at") -> DataFrame:
    """M7: rows to insert into tokens: hash, owner, scope, expiry = issue time + lifetime."""
    expiry = round_to_second(F.timestamp_add("SECOND", token_lifetime_seconds(F.col(scope_col)),
                                             F.col(issued_col)))
    return requests.select(
        token_hash(F.col(token_col)).alias("hash"),
        F.col(user_col).alias("user_id"),
        expiry.cast("timestamp_ntz").alias("expiry"),
        F.col(scope_col).alias("scope"),
        F.col(token_col).alias("token"))


def live_tokens(tokens: DataFrame, scope: str, as_of) -> DataFrame:
    """tokens of one scope whose expiry is strictly after ``as_of``."""
    # "now" takes the column's type, so a stored instant is compared as an instant in any session zone
    now = utc_as(as_of_literal(as_of), tokens.schema["expiry"].dataType)
    return tokens.where((F.col("scope") == scope) & (F.col("expiry") > now)) \
        .select("hash", F.col("user_id").alias("_token_user"))


USER_COLUMNS = ("id", "email", "role", "activated", "version", "created_at")


def token_user_join(presented: DataFrame, tokens: DataFrame, users: DataFrame, scope: str,
                    as_of, token_col: str = "token") -> DataFrame:
    """The user behind each presented token text (inner join: unknown/expired rows drop)."""
    live = live_tokens(tokens, scope, as_of)
    hashed = presented.withColumn("_hash", token_hash(F.col(token_col)))
    u = users.select(*[F.col(c).alias(f"user_{c}") for c in USER_COLUMNS])
    return (hashed.join(live, hashed["_hash"] == live["hash"])
            .join(u, F.col("_token_user") == F.col("user_id"))
            .drop("_hash", "hash", "_token_user"))


def with_route(requests: DataFrame, method_col: str = "method", path_col: str = "path") -> DataFrame:
    """Adds ``route`` (method and path of the route table, NULL if none) and ``guarded``.

    A path matches literally, else with its last part as an id.
    """
    guards = F.create_map(*[x for (m, p), g in ROUTES.items() for x in (F.lit(f"{m} {p}"), F.lit(g))])
    exact = F.concat_ws(" ", method_col, path_col)
    by_id = F.regexp_replace(exact, r"^(\S+ /v1/[^/]+)/[^/]+$", "$1/:id")
    route = F.when(F.map_contains_key(guards, exact), exact).when(F.map_contains_key(guards, by_id), by_id)
    return requests.withColumn("route", route).withColumn("guarded", F.try_element_at(guards, F.col("route")))


def route_access(requests: DataFrame, tokens: DataFrame, users: DataFrame, as_of, header_col: str = "auth_header",
                 method_col: str = "method", path_col: str = "path") -> DataFrame:
    """J2 with the route table: a bad token is refused before routing, as every request is authenticated
    first; then a request without a route is ``not_found`` (404) or, if the path has other methods,
    ``method_not_allowed`` (405); then the guard decides."""
    routed = with_route(requests, method_col, path_col)
    paths = sorted({p for _, p in ROUTES})
    path = F.col(path_col)
    known = path.isin(paths) | F.regexp_replace(path, r"^(/v1/[^/]+)/[^/]+$", "$1/:id").isin(paths)
    decided = access_decision(routed.withColumn("guarded", F.coalesce("guarded", F.lit(False))), tokens, users, as_of,
                              header_col)
    missing = F.col("route").isNull() & (F.col("outcome") != "invalid_token")
    outcome = F.when(missing & known, "method_not_allowed").when(missing, "not_found").otherwise(F.col("outcome"))
    status = F.when(missing & known, 405).when(missing, 404).otherwise(F.col("status"))
    return decided.withColumns({"outcome": outcome, "status": status})


# fixed values: access outcomes and their HTTP status
ACCESS_STATUS = {"allowed": 200, "invalid_token": 401, "unauthenticated": 401, "inactive": 403}


def access_decision(requests: DataFrame, tokens: DataFrame, users: DataFrame, as_of,
                    header_col: str = "auth_header", guarded_col: str = "guarded") -> DataFrame:
    """Outcome per request, checks in the reference's order.

    no header → anonymous; not exactly ``Bearer <token>`` → invalid_token; token text
    not 26 bytes → invalid_token; no live authentication token → invalid_token; then
    on guarded routes anonymous → unauthenticated and not activated → inactive.
    """
    h = F.col(header_col)
    parts = F.split(h, " ", -1)
    tok = F.try_element_at(parts, F.lit(2))
    state = (F.when(h.isNull() | (h == ""), F.lit("anonymous"))
             .when((F.size(parts) != 2) | (F.try_element_at(parts, F.lit(1)) != "Bearer"),
                   "invalid_token")
             .when((tok == "") | (F.octet_length(tok) != TOKEN_TEXT_BYTES), "invalid_token")
             .otherwise("lookup"))
    req = requests.withColumn("_state", state) \
        .withColumn("_hash", F.when(F.col("_state") == "lookup", token_hash(tok)))
    live = live_tokens(tokens, SCOPE_AUTHENTICATION, as_of)
    u = users.select(F.col("id").alias("_uid"), F.col("activated").alias("_activated"))
    # rows without a token match nothing; a key of their own spreads them over the partitions
    alone = F.concat(F.lit("-"), F.xxhash64(*requests.columns).cast("string"))
    req = req.withColumn("_key", F.coalesce("_hash", alone))
    joined = req.join(live, req["_key"] == live["hash"], "left")
    joined = joined.withColumn("_user_key", F.coalesce("_token_user", F.col("_key")))
    joined = joined.join(u, F.col("_user_key") == F.col("_uid"), "left").drop("_key", "_user_key")
    found = F.col("_uid").isNotNull()
    guarded = F.coalesce(F.col(guarded_col), F.lit(True))
    outcome = (F.when(F.col("_state") == "invalid_token", "invalid_token")
               .when((F.col("_state") == "lookup") & ~found, "invalid_token")
               .when((F.col("_state") == "anonymous") & guarded, "unauthenticated")
               .when(found & guarded & ~F.coalesce(F.col("_activated"), F.lit(False)), "inactive")
               .otherwise("allowed"))
    status = F.create_map(*[x for k, v in ACCESS_STATUS.items() for x in (F.lit(k), F.lit(v))])
    out = joined.withColumn("outcome", outcome).withColumn("user_id", F.col("_uid"))
    return out.withColumn("status", status[F.col("outcome")]) \
        .drop("_state", "_hash", "hash", "_token_user", "_uid", "_activated")


def token_periods(requests: DataFrame, token_col: str = "token", user_col: str = "user_id",
                  scope_col: str = "scope", issued_col: str = "issued_at") -> DataFrame:
    """Registered tokens with the time they were issued: hash, user_id, scope, issued_at, expiry."""
    expiry = round_to_second(F.timestamp_add("SECOND", token_lifetime_seconds(F.col(scope_col)), F.col(issued_col)))
    return requests.select(token_hash(F.col(token_col)).alias("hash"), F.col(user_col).alias("user_id"),
                           F.col(scope_col).alias("scope"), F.col(issued_col).alias("issued_at"),
                           expiry.cast("timestamp_ntz").alias("expiry"))


def access_asof(requests: DataFrame, tokens: DataFrame, versions: DataFrame, header_col: str = "auth_header",
                guarded_col: str = "guarded", at_col: str = "at", version_tie: str | None = None) -> DataFrame:
    """J2 for a log, each request judged at its own time ``at``.

    ``tokens`` have ``issued_at`` and ``expiry``: a token lives from its issue (included) to its expiry
    (excluded). ``versions`` (user_id, valid_from, activated) are what a user was from a time on; a user
    before the first version is unknown, and the token with them: ``invalid_token``. Checks come in the
    order of :func:`access_decision`. The token join is on a unique, uniform hash; the users' versions are
    found by an as-of join, which splits hot users. Adds outcome, status, user_id.
    """
    state, tok = presented(F.col(header_col))
    req = requests.withColumn("_state", state)
    alone = F.concat(F.lit("-"), F.xxhash64(*requests.columns).cast("string"))
    req = req.withColumn("_key", F.when(F.col("_state") == "lookup", token_hash(tok)).otherwise(alone))
    live = tokens.where(F.col("scope") == SCOPE_AUTHENTICATION).select(
        F.col("hash").alias("_key"), F.col("user_id").alias("_owner"), F.col("issued_at").alias("_from"),
        F.col("expiry").alias("_until"))
    held = (F.col("_from") <= F.col(at_col)) & (F.col(at_col) < F.col("_until"))
    owned = req.join(live, "_key", "left").withColumn("_user", F.when(held, F.col("_owner"))) \
        .drop("_key", "_owner", "_from", "_until")
    return decide_asof(owned, versions, guarded_col, at_col, version_tie)


def presented(header: Column) -> tuple[Column, Column]:
    """What an Authorization header is (anonymous, invalid_token, or lookup: a token to be looked up), and its token."""
    parts = F.split(header, " ", -1)
    tok = F.try_element_at(parts, F.lit(2))
    state = (F.when(header.isNull() | (header == ""), F.lit("anonymous"))
             .when((F.size(parts) != 2) | (F.try_element_at(parts, F.lit(1)) != "Bearer"), "invalid_token")
             .when((tok == "") | (F.octet_length(tok) != TOKEN_TEXT_BYTES), "invalid_token").otherwise("lookup"))
    return state, tok


def decide_asof(owned: DataFrame, versions: DataFrame, guarded_col: str, at_col: str,
                version_tie: str | None = None) -> DataFrame:
    """Outcome, status and user_id of requests with their header's ``_state`` and their live token's owner ``_user``."""
    known = asof_join(owned, versions.select(F.col("user_id").alias("_user"), "valid_from",
                                             F.coalesce("activated", F.lit(False)).alias("_active"),
                                             *([version_tie] if version_tie else [])),
                      "_user", at_col, "valid_from", ["_active"], tie=version_tie)
    guarded, found = F.coalesce(F.col(guarded_col), F.lit(True)), F.col("_active").isNotNull()
    outcome = (F.when((F.col("_state") == "invalid_token") | ((F.col("_state") == "lookup") & ~found), "invalid_token")
               .when((F.col("_state") == "anonymous") & guarded, "unauthenticated")
               .when(found & guarded & ~F.col("_active"), "inactive").otherwise("allowed"))
    status = F.create_map(*[x for k, v in ACCESS_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return known.withColumn("user_id", F.when(found, F.col("_user"))).withColumn("outcome", outcome) \
        .withColumn("status", status[F.col("outcome")]).drop("_state", "_user", "_active")


def redeem_tokens(presented: DataFrame, tokens: DataFrame, users: DataFrame, as_of,
                  scope: str = SCOPE_ACTIVATION, token_col: str = "token",
                  order_col: str | None = None):
    """M6: activation by token. Returns ``(new_users, new_tokens, report)``.

    Live tokens of the scope resolve to users. Per user the first presentation (by
    ``order_col``, which must be unique per presented row, e.g. a request id; default
    the token text) activates the user (version + 1); then
    every token of that user in that scope is removed, so a later token of the same
    user finds nothing: ``invalid_token``, as running the requests one by one would.
    The winner per user is a ``min`` aggregate (partial aggregation, safe for a hot user).
    """
    order_col = order_col or token_col
    hashed = presented.withColumn("_hash", token_hash(F.col(token_col)))
    live = live_tokens(tokens, scope, as_of)
    resolved = hashed.join(live, hashed["_hash"] == live["hash"], "left")
    firsts = resolved.where(F.col("_token_user").isNotNull()).groupBy("_token_user") \
        .agg(F.min(order_col).alias("_first"))
    rep = resolved.join(firsts, "_token_user", "left")
    won = F.col(order_col) == F.col("_first")
    redeemed = firsts.select(F.col("_token_user").alias("_rid"))
    hit = users.join(redeemed, users["id"] == redeemed["_rid"], "left")
    is_hit = F.col("_rid").isNotNull()
    new_users = hit.select(*[
        (F.when(is_hit, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "activated"
         else F.when(is_hit, F.col(c) + 1).otherwise(F.col(c)).cast("int").alias(c)
         if c == "version" else F.col(c)) for c in users.columns])
    gone = redeemed.select(F.col("_rid").alias("user_id"), F.lit(scope).alias("scope"))
    new_tokens = tokens.join(gone, ["user_id", "scope"], "left_anti").select(*tokens.columns)
    report = rep.select(
        *presented.columns,
        F.when(won, F.col("_token_user")).alias("user_id"),
        F.when(won, "activated").otherwise("invalid_token").alias("outcome"))
    return new_users, new_tokens, report
