"""Independent DuckDB SQL for every registered query.

The stand-in tables are re-derived here in SQL (CTEs over the driver views), so the
oracle shares no code path with the Spark side beyond the written rules.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-15 12:00:00'"
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def uid(expr: str) -> str:
    return f"('00000000-0000-4000-8000-' || lpad(CAST({expr} AS VARCHAR), 12, '0'))"


def toks(expr: str) -> str:
    """Tokens of a text: runs of letters/digits plus hyphenated compounds, lower-cased."""
    low = f"lower(coalesce({expr}, ''))"
    return (f"list_concat(list_filter(regexp_split_to_array({low}, "
            f"'[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), "
            f"regexp_extract_all({low}, '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)+'))")


def has_all(expr: str, terms: list[str]) -> str:
    if not terms:
        return "FALSE"
    arr = ", ".join(f"'{t}'" for t in terms)
    return f"list_has_all({toks(expr)}, [{arr}])"


LINE_ID = ("concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
           "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
           "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))")

TOKEN = "lpad(CAST(event_id AS VARCHAR), 26, 'A')"
SCOPE = ("CASE WHEN event_type = 'click' THEN 'activation' "
         "WHEN event_type = 'purchase' THEN 'password-reset' ELSE 'authentication' END")
LIFETIME = ("CASE WHEN {s} = 'activation' THEN 259200 WHEN {s} = 'authentication' THEN 86400 "
            "WHEN {s} = 'password-reset' THEN 2700 END")

STANDIN: dict[str, str] = {
    "regions": "SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region",
    "formations": ("SELECT 'F' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, "
                   "'R' || CAST(n_regionkey AS VARCHAR) AS region_id FROM nation"),
    "ranks": "SELECT n_name AS code, n_name AS name FROM nation",
    "postings": "SELECT 'P' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region",
    "users": f"""
        SELECT {uid('c_custkey')} AS id,
               lower(replace(c_name, '#', '.')) ||
                 CASE WHEN c_acctbal < 0 THEN '@example..org' ELSE '@example.org' END AS email,
               sha256(c_name) AS password_hash,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin'
                    WHEN c_mktsegment = 'AUTOMOBILE' THEN 'contributor'
                    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'user' ELSE 'viewer' END AS role,
               {EPOCH} + to_seconds(c_custkey * 60) AS created_at,
               CAST(NULL AS TIMESTAMP) AS last_login_at,
               CAST(c_custkey % 3 + 1 AS INTEGER) AS version,
               c_acctbal >= 0 AS activated
        FROM customer""",
    "officers": f"""
        SELECT {uid('c_custkey')} AS id,
               CASE WHEN c_acctbal >= 0 THEN
                 'REG-' || lpad(CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), 5, '0') END
                 AS regulation_number,
               c_name AS first_name, c_mktsegment AS last_name,
               CASE WHEN c_nationkey = 24 THEN 'other' WHEN c_nationkey % 3 = 0 THEN 'male'
                    WHEN c_nationkey % 3 = 1 THEN 'female' ELSE 'unknown' END AS sex,
               'NATION_' || CAST(c_nationkey AS VARCHAR) AS rank_code,
               'R' || CAST(c_nationkey % 5 AS VARCHAR) AS region_id,
               'F' || CAST(c_nationkey AS VARCHAR) AS formation_id,
               'P' || CAST(c_nationkey AS VARCHAR) AS posting_id,
               {EPOCH} + to_seconds(c_custkey * 60) AS created_at,
               CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS TIMESTAMP) AS archived_at,
               CAST(c_custkey % 3 + 1 AS INTEGER) AS version
        FROM customer""",
    "facilitators": f"""
        SELECT {uid('s_suppkey')} AS id,
               CASE WHEN s_acctbal > 5000 THEN {uid('s_suppkey')} END AS officer_id,
               s_name AS first_name,
               CASE WHEN s_acctbal >= 0 THEN 'NATION_' || CAST(s_nationkey AS VARCHAR) END
                 AS last_name,
               CAST(NULL AS VARCHAR) AS rank_code, CAST(NULL AS VARCHAR) AS posting_id,
               CAST(NULL AS VARCHAR) AS notes,
               CAST(s_suppkey % 3 + 1 AS INTEGER) AS version
        FROM supplier""",
    "courses": f"""
        SELECT {uid('p_partkey')} AS id, p_name AS title,
               CASE WHEN p_type = 'PROMO' THEN 'elective' WHEN p_type = 'LARGE' THEN 'instructor'
                    WHEN p_type = 'ECONOMY' THEN 'other' ELSE 'mandatory' END AS category,
               CAST(p_size / 2.0 AS DECIMAL(4,1)) AS default_credit_hours,
               p_brand AS description,
               {uid('p_partkey // 2')} AS created_by_user_id,
               {EPOCH} + to_seconds(p_partkey * 60) AS created_at,
               CAST(NULL AS TIMESTAMP) AS updated_at,
               CAST(p_partkey % 3 + 1 AS INTEGER) AS version
        FROM part""",
    "sessions": f"""
        SELECT {uid('o_orderkey')} AS id, {uid('o_custkey')} AS course_id,
               o_orderdate AS start_datetime,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW'
                    THEN o_orderdate - INTERVAL 1 HOUR ELSE o_orderdate + INTERVAL 2 HOUR END
                 AS end_datetime,
               CAST(NULL AS VARCHAR) AS region_id, CAST(NULL AS VARCHAR) AS formation_id,
               CAST(NULL AS VARCHAR) AS posting_id,
               CASE WHEN o_orderstatus = 'F' THEN 'Main Hall ' || o_orderpriority
                    WHEN o_orderstatus = 'O' THEN 'Room ' || o_orderpriority END AS location_text,
               CAST(NULL AS VARCHAR) AS facilitator_notes,
               CASE WHEN o_orderstatus = 'O' THEN CAST(1.5 AS DECIMAL(4,1)) END
                 AS credit_hours_override,
               o_orderdate AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at,
               CAST(o_orderkey % 3 + 1 AS INTEGER) AS version
        FROM orders""",
    "import_jobs": f"""
        SELECT {uid('o_orderkey')} AS id, o_orderpriority AS type,
               CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'Running'
                    ELSE 'pending' END AS status,
               CAST(NULL AS VARCHAR) AS error_message,
               {uid('o_custkey')} AS created_by_user_id,
               o_orderdate AS created_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR END AS finished_at,
               1 AS version
        FROM orders""",
    "attendance": f"""
        SELECT {LINE_ID} AS id, {uid('l_partkey // 2')} AS officer_id,
               {uid('l_orderkey')} AS session_id,
               CASE WHEN l_returnflag = 'A' THEN 'attended' WHEN l_returnflag = 'N' THEN 'absent'
                    ELSE 'excused' END AS status,
               CAST(l_quantity AS DECIMAL(4,1)) AS credited_hours,
               l_shipdate AS created_at,
               CAST(l_linenumber % 3 + 1 AS INTEGER) AS version
        FROM lineitem""",
    "session_feedback": f"""
        SELECT {LINE_ID} AS id, {uid('l_orderkey')} AS session_id,
               {uid('l_suppkey')} AS facilitator_id, {uid('l_partkey // 2')} AS officer_id,
               CAST(l_quantity / 10.0 AS DECIMAL(2,1)) AS rating,
               CASE WHEN l_linestatus = 'O' THEN 'open' END AS comments,
               l_shipdate AS created_at, 1 AS version
        FROM lineitem""",
    "session_facilitators": f"""
        SELECT {LINE_ID} AS id, {uid('l_orderkey')} AS session_id,
               {uid('l_suppkey')} AS facilitator_id,
               CASE WHEN l_linenumber = 1 THEN 'lead' END AS role, 1 AS version
        FROM lineitem""",
    "token_requests": f"""
        SELECT {TOKEN} AS token, {uid('user_id')} AS user_id, {SCOPE} AS scope, ts AS issued_at
        FROM events""",
    "tokens": f"""
        SELECT sha256(token) AS hash, user_id,
               date_trunc('second', issued_at + to_seconds({LIFETIME.format(s='scope')})
                          + INTERVAL 500000 MICROSECOND) AS expiry,
               scope
        FROM token_requests""",
    "requests": f"""
        SELECT event_id AS request_id,
               CASE WHEN value < 5 THEN NULL
                    WHEN event_type = 'error' THEN 'Token ' || {TOKEN}
                    WHEN event_type = 'purchase' THEN 'Bearer ' || {TOKEN} || ' extra'
                    WHEN event_type = 'view' THEN 'Bearer ' || substr({TOKEN}, 2, 25)
                    ELSE 'Bearer ' || {TOKEN} END AS auth_header,
               event_type <> 'view' AS guarded
        FROM events""",
}

# stand-ins that read other stand-ins
_DEPENDS = {"tokens": ("token_requests",)}


def with_tables(*names: str) -> str:
    """A WITH clause defining the named stand-in tables (and what they read)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({STANDIN[n]})" for n in order) + "\n"
