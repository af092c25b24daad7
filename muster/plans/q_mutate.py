"""Registered queries: lookups (F5, F6), mutations (M1-M5) and their summary (A3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from muster.functions.ids import key_uuid
from muster.operators import lookup as K
from muster.operators import mutate as M
from muster.operators.validate import RULES
from muster.plans.catalog import query
from muster.plans.oracle_sql import AS_OF, uid, with_tables
from muster.plans.standins import AS_OF as AS_OF_TEXT
from muster.schemas import PATCHABLE, PUBLIC, UPDATABLE

NOT_FOUND_SHIFT = 1_000_000_000  # keys shifted past every stand-in key: a lookup miss


# --- F5 / F6 ---------------------------------------------------------------------------------------
def _pub(table: str, alias: str) -> str:
    return ", ".join(f"{alias}.{c}" for c in PUBLIC[table] if c != "id")


@query("multi_get", with_tables("officers") + f"""
    SELECT k.request_id, k.id, {_pub('officers', 'o')},
           CASE WHEN o.id IS NOT NULL THEN 'found' ELSE 'not_found' END AS outcome
    FROM (SELECT o_orderkey AS request_id, {uid('o_custkey * 2')} AS id FROM orders) k
    LEFT JOIN officers o ON k.id = o.id""")
def multi_get(t):
    """Each order asks for officer 2 x customer key: half the keys do not exist."""
    keys = t.raw("orders").select(F.col("o_orderkey").alias("request_id"),
                                  key_uuid(F.col("o_custkey") * 2).alias("id"))
    return K.multi_get_public(t.officers, "officers", keys)


_EMAIL_ASKED = ("CASE WHEN c_mktsegment = 'BUILDING' THEN upper({e}) ELSE {e} END")
_EMAIL_SQL = ("lower(replace(c_name, '#', '.')) || CASE WHEN c_acctbal < 0 THEN '@example..org' "
              "ELSE '@example.org' END")


@query("multi_get_by_name", with_tables("users") + f"""
    SELECT k.request_id, k.email, u.id, u.role, u.activated, u.created_at, u.last_login_at,
           CASE WHEN u.id IS NOT NULL THEN 'found' ELSE 'not_found' END AS outcome
    FROM (SELECT c_custkey AS request_id, {_EMAIL_ASKED.format(e=_EMAIL_SQL)} AS email
          FROM customer) k
    LEFT JOIN users u ON k.email = u.email""")
def multi_get_by_name(t):
    """Lookup by exact e-mail; upper-cased addresses (one segment) do not match."""
    c = t.raw("customer")
    email = F.concat(F.lower(F.regexp_replace("c_name", "#", ".")),
                     F.when(F.col("c_acctbal") < 0, F.lit("@example..org"))
                     .otherwise(F.lit("@example.org")))
    asked = F.when(F.col("c_mktsegment") == "BUILDING", F.upper(email)).otherwise(email)
    keys = c.select(F.col("c_custkey").alias("request_id"), asked.alias("email"))
    return K.multi_get(t.users, keys, key_col="email",
                       columns=["id", "role", "activated", "created_at", "last_login_at"])


# --- M1: officer patches ------------------------------------------------------------------------
def _officer_patches(t):
    c = t.raw("customer")
    def rows(where, seq, id_expr, expected, reg, first):
        return c.where(where).select(
            id_expr.alias("id"), expected.alias("expected_version"), F.lit(seq).alias("seq"),
            reg.alias("regulation_number"), first.alias("first_name"),
            F.col("c_mktsegment").alias("last_name"), F.lit("unknown").alias("sex"),
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("rank_code"))

    expected = (F.col("c_custkey") % 2 + 1).cast("int")
    a = rows(F.lit(True), 1, key_uuid("c_custkey"), expected, F.lit(None).cast("string"),
             F.upper("c_name"))
    b = rows(F.col("c_nationkey") < 5, 2, key_uuid("c_custkey"), expected,
             F.lit("REG-B"), F.lower("c_name"))
    missing = rows(F.col("c_nationkey") == 3, 1,
                   key_uuid(F.col("c_custkey") + NOT_FOUND_SHIFT), F.lit(None).cast("int"),
                   F.lit("REG-X"), F.col("c_name"))
    return a.unionByName(b).unionByName(missing)


_PATCH_ROW = ("SELECT {id} AS id, {exp} AS expected_version, {seq} AS seq, {reg} AS "
              "regulation_number, {first} AS first_name, c_mktsegment AS last_name, "
              "'unknown' AS sex, 'NATION_' || CAST(c_nationkey AS VARCHAR) AS rank_code "
              "FROM customer WHERE {where}")
_EXP = "CAST(c_custkey % 2 + 1 AS INTEGER)"
_OFFICER_PATCHES_SQL = " UNION ALL ".join([
    _PATCH_ROW.format(id=uid("c_custkey"), exp=_EXP, seq=1, reg="CAST(NULL AS VARCHAR)",
                      first="upper(c_name)", where="TRUE"),
    _PATCH_ROW.format(id=uid("c_custkey"), exp=_EXP, seq=2, reg="'REG-B'",
                      first="lower(c_name)", where="c_nationkey < 5"),
    _PATCH_ROW.format(id=uid(f"c_custkey + {NOT_FOUND_SHIFT}"), exp="CAST(NULL AS INTEGER)",
                      seq=1, reg="'REG-X'", first="c_name",
                      where="c_nationkey = 3"),
])
_M1_CTE = (with_tables("officers") + f""",
    patches AS ({_OFFICER_PATCHES_SQL}),
    j AS (SELECT p.*, o.version AS stored FROM patches p LEFT JOIN officers o ON p.id = o.id),
    w AS (SELECT id, min(seq) AS win FROM j
          WHERE stored IS NOT NULL AND (expected_version IS NULL OR expected_version = stored)
          GROUP BY id),
    rep AS (SELECT j.*, w.win FROM j LEFT JOIN w ON j.id = w.id)
""")

_M1_REPORT_SQL = (_M1_CTE + """
    SELECT id, seq, expected_version,
           CASE WHEN stored IS NULL THEN 'not_found' WHEN seq = win THEN 'updated'
                ELSE 'conflict' END AS outcome,
           CAST(CASE WHEN seq = win THEN stored + 1 ELSE stored END AS INTEGER) AS version
    FROM rep""")


def _m1(t):
    return M.table_update(t.officers, _officer_patches(t), "officers", UPDATABLE["officers"],
                          AS_OF_TEXT, parents={"ranks": t.ranks})


@query("optimistic_update_report", _M1_REPORT_SQL)
def optimistic_update_report(t):
    """M1 report: updated / conflict (stale version or lost in-batch race) / not_found."""
    return _m1(t)[1]


_SNAP_COLS = ("id", "regulation_number", "first_name", "last_name", "sex", "rank_code",
              "updated_at", "version")


@query("optimistic_update", _M1_CTE + f"""
    SELECT o.id,
           CASE WHEN a.id IS NOT NULL THEN a.regulation_number ELSE o.regulation_number END
             AS regulation_number,
           CASE WHEN a.id IS NOT NULL THEN a.first_name ELSE o.first_name END AS first_name,
           CASE WHEN a.id IS NOT NULL THEN a.last_name ELSE o.last_name END AS last_name,
           CASE WHEN a.id IS NOT NULL THEN a.sex ELSE o.sex END AS sex,
           CASE WHEN a.id IS NOT NULL THEN a.rank_code ELSE o.rank_code END AS rank_code,
           CASE WHEN a.id IS NOT NULL THEN {AS_OF} ELSE o.updated_at END AS updated_at,
           CAST(CASE WHEN a.id IS NOT NULL THEN o.version + 1 ELSE o.version END AS INTEGER)
             AS version
    FROM officers o LEFT JOIN (SELECT * FROM rep WHERE seq = win) a ON o.id = a.id""")
def optimistic_update(t):
    """M1 new officer snapshot: winners replace every updatable column (NULL too)."""
    return _m1(t)[0].select(*_SNAP_COLS)


@query("mutation_summary", _M1_CTE + """
    SELECT outcome, count(*) AS row_count FROM (
      SELECT CASE WHEN stored IS NULL THEN 'not_found' WHEN seq = win THEN 'updated'
                  ELSE 'conflict' END AS outcome FROM rep) s GROUP BY outcome""")
def mutation_summary(t):
    """A3: rows per outcome of the officer update batch."""
    return M.mutation_summary(_m1(t)[1])


# --- M2: course patches ---------------------------------------------------------------------------
def _course_patches(t):
    p = t.raw("part")
    upd = p.select(
        key_uuid("p_partkey").alias("id"), F.lit(None).cast("int").alias("expected_version"),
        F.lit(1).alias("seq"), F.lit(None).cast("string").alias("title"),
        F.when(F.col("p_size") > 48, F.lit("other")).alias("category"),
        F.lit(None).cast("decimal(4,1)").alias("default_credit_hours"),
        F.lit("patched").alias("description"))
    miss = p.where(F.col("p_size") == 1).select(
        key_uuid(F.col("p_partkey") + NOT_FOUND_SHIFT).alias("id"),
        F.lit(None).cast("int").alias("expected_version"), F.lit(1).alias("seq"),
        F.lit("x").alias("title"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("decimal(4,1)").alias("default_credit_hours"),
        F.lit(None).cast("string").alias("description"))
    return upd.unionByName(miss)


@query("partial_patch", with_tables("courses") + f""",
    patches AS (
      SELECT {uid('p_partkey')} AS id, CAST(NULL AS INTEGER) AS expected_version, 1 AS seq,
             CAST(NULL AS VARCHAR) AS title,
             CASE WHEN p_size > 48 THEN 'other' END AS category,
             CAST(NULL AS DECIMAL(4,1)) AS default_credit_hours, 'patched' AS description
      FROM part
      UNION ALL
      SELECT {uid(f'p_partkey + {NOT_FOUND_SHIFT}')}, CAST(NULL AS INTEGER), 1, 'x',
             CAST(NULL AS VARCHAR), CAST(NULL AS DECIMAL(4,1)), CAST(NULL AS VARCHAR)
      FROM part WHERE p_size = 1),
    m AS (SELECT p.id, p.seq, p.expected_version, c.id IS NOT NULL AS present, c.version AS stored,
                 coalesce(p.title, c.title) AS title, coalesce(p.category, c.category) AS category,
                 coalesce(p.default_credit_hours, c.default_credit_hours) AS hours
          FROM patches p LEFT JOIN courses c ON p.id = c.id),
    v AS (SELECT *, coalesce(title, '') <> '' AND strlen(coalesce(title, '')) <= 255
                    AND coalesce(category, '') IN ('mandatory', 'elective', 'instructor')
                    AND coalesce(CAST(hours AS DOUBLE), 0) > 0 AS ok FROM m)
    SELECT id, seq, expected_version,
           CASE WHEN NOT present THEN 'not_found' WHEN NOT ok THEN 'invalid' ELSE 'updated' END
             AS outcome,
           CAST(CASE WHEN present AND ok THEN stored + 1 END AS INTEGER) AS version
    FROM v""")
def partial_patch(t):
    """M2: NULL members keep stored values; merged rows re-validated (V2), then M1."""
    _, report = M.partial_patch(t.courses, _course_patches(t), PATCHABLE["courses"],
                                RULES["courses"], AS_OF_TEXT, stamp_updated_at=True)
    return report.select("id", "seq", "expected_version", "outcome", "version")


# --- M3 / M4 ---------------------------------------------------------------------------------------
@query("delete_by_key", with_tables("courses") + f"""
    SELECT k.id, CASE WHEN c.id IS NOT NULL THEN 'deleted' ELSE 'not_found' END AS outcome
    FROM (SELECT {uid('p_partkey * 3')} AS id FROM part WHERE p_type = 'PROMO') k
    LEFT JOIN courses c ON k.id = c.id""")
def delete_by_key(t):
    """M3: delete course 3 x key for every PROMO part; keys past the table are not_found."""
    keys = t.raw("part").where(F.col("p_type") == "PROMO") \
        .select(key_uuid(F.col("p_partkey") * 3).alias("id"))
    return M.delete_by_key(t.courses, keys)[1]


@query("delete_by_predicate", with_tables("tokens") + """
    SELECT hash, user_id, expiry, scope FROM tokens t
    WHERE NOT EXISTS (SELECT 1 FROM tokens d WHERE d.scope = 'activation'
                      AND d.scope = t.scope AND d.user_id = t.user_id
                      AND d.expiry > TIMESTAMP '2024-01-28 00:00:00')""")
def delete_by_predicate(t):
    """M4: remove all activation tokens of every user holding one that expires late."""
    tok = t.tokens
    hit = tok.where((F.col("scope") == "activation") &
                    (F.col("expiry") > F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")))
    return M.delete_by_predicate(tok, hit, ["scope", "user_id"])


# --- M5: delete propagation ------------------------------------------------------------------------
_CASCADE_TABLES = ("courses", "sessions", "attendance", "session_feedback", "session_facilitators")


@query("delete_cascade", with_tables(*_CASCADE_TABLES) + f""",
    k AS (SELECT DISTINCT {uid('p_partkey')} AS root FROM part WHERE p_name = 'red widget'),
    c AS (SELECT c.id, k.root FROM k JOIN courses c ON c.id = k.root),
    s AS (SELECT s.id, c.root FROM sessions s JOIN c ON s.course_id = c.id),
    a AS (SELECT a.id, s.root FROM attendance a JOIN s ON a.session_id = s.id),
    f AS (SELECT f.id, s.root FROM session_feedback f JOIN s ON f.session_id = s.id),
    l AS (SELECT l.id, s.root FROM session_facilitators l JOIN s ON l.session_id = s.id)
    SELECT DISTINCT * FROM (
      SELECT 'courses' AS table_name, id, 'deleted' AS action, root AS root_id FROM c
      UNION ALL SELECT 'sessions', id, 'deleted', root FROM s
      UNION ALL SELECT 'attendance', id, 'deleted', root FROM a
      UNION ALL SELECT 'session_feedback', id, 'deleted', root FROM f
      UNION ALL SELECT 'session_facilitators', id, 'deleted', root FROM l
      UNION ALL SELECT 'courses', root, 'not_found', root FROM k
        WHERE root NOT IN (SELECT id FROM courses)) r""")
def delete_cascade(t):
    """M5 CASCADE: courses titled 'red widget' → their sessions → attendance, feedback, links."""
    keys = t.raw("part").where(F.col("p_name") == "red widget") \
        .select(key_uuid("p_partkey").alias("id"))
    _, report = M.propagate_delete({n: t.table(n) for n in _CASCADE_TABLES}, "courses", keys)
    return report


@query("delete_set_null", with_tables("formations", "officers", "sessions") + """,
    k AS (SELECT DISTINCT 'F' || CAST(n_nationkey AS VARCHAR) AS root FROM nation
          WHERE n_regionkey = 2),
    f AS (SELECT f.id, k.root FROM k JOIN formations f ON f.id = k.root)
    SELECT DISTINCT * FROM (
      SELECT 'formations' AS table_name, id, 'deleted' AS action, root AS root_id FROM f
      UNION ALL SELECT 'officers', o.id, 'set_null', f.root FROM officers o
        JOIN f ON o.formation_id = f.id
      UNION ALL SELECT 'sessions', s.id, 'set_null', f.root FROM sessions s
        JOIN f ON s.formation_id = f.id) r""")
def delete_set_null(t):
    """M5 SET NULL: deleting the formations of region 2 clears officers' formation_id."""
    keys = t.raw("nation").where(F.col("n_regionkey") == 2) \
        .select(F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("id"))
    tables = {n: t.table(n) for n in ("formations", "officers", "sessions")}
    _, report = M.propagate_delete(tables, "formations", keys)
    return report


_RESTRICT_TABLES = ("users", "courses", "import_jobs", "tokens")


@query("delete_restrict", with_tables(*_RESTRICT_TABLES) + """,
    k AS (SELECT DISTINCT u.id AS root FROM users u WHERE u.role = 'admin'),
    b AS (SELECT root FROM k WHERE EXISTS (SELECT 1 FROM courses c WHERE c.created_by_user_id = root)
             OR EXISTS (SELECT 1 FROM import_jobs j WHERE j.created_by_user_id = root)),
    ok AS (SELECT root FROM k WHERE root NOT IN (SELECT root FROM b))
    SELECT DISTINCT * FROM (
      SELECT 'users' AS table_name, root AS id, 'deleted' AS action, root AS root_id FROM ok
      UNION ALL SELECT 'tokens', t.hash, 'deleted', ok.root FROM tokens t
        JOIN ok ON t.user_id = ok.root
      UNION ALL SELECT 'users', root, 'blocked', root FROM b) r""")
def delete_restrict(t):
    """M5 RESTRICT: admins still referenced by courses or import jobs are blocked; the rest
    are deleted with their tokens (CASCADE)."""
    keys = t.users.where(F.col("role") == "admin").select("id")
    _, report = M.propagate_delete({n: t.table(n) for n in _RESTRICT_TABLES}, "users", keys)
    return report


# --- M3 / M5: what is left of every table ------------------------------------------------------------
@query("delete_by_key_snapshot", with_tables("courses") + f"""
    SELECT * FROM courses c WHERE NOT EXISTS (
        SELECT 1 FROM part p WHERE p_type = 'PROMO' AND {uid('p.p_partkey * 3')} = c.id)""")
def delete_by_key_snapshot(t):
    """M3: the courses that are left."""
    keys = t.raw("part").where(F.col("p_type") == "PROMO") \
        .select(key_uuid(F.col("p_partkey") * 3).alias("id"))
    return M.delete_by_key(t.courses, keys)[0]


def _left(tables, ids: dict[str, str], references: dict[str, str]):
    """One row per row that is left: its table, id and the reference that a delete may have cleared."""
    parts = [df.select(F.lit(n).alias("table_name"), F.col(ids.get(n, "id")).alias("id"),
                       F.col(references[n]).alias("reference") if n in references
                       else F.lit(None).cast("string").alias("reference")) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("delete_cascade_snapshot", with_tables(*_CASCADE_TABLES) + f""",
    k AS (SELECT DISTINCT {uid('p_partkey')} AS root FROM part WHERE p_name = 'red widget'),
    s AS (SELECT id FROM sessions WHERE course_id IN (SELECT c.id FROM courses c JOIN k ON c.id = k.root))
    SELECT 'courses' AS table_name, id, CAST(NULL AS VARCHAR) AS reference FROM courses WHERE id NOT IN (SELECT root FROM k)
    UNION ALL SELECT 'sessions', id, course_id FROM sessions WHERE id NOT IN (SELECT id FROM s)
    UNION ALL SELECT 'attendance', id, session_id FROM attendance WHERE session_id NOT IN (SELECT id FROM s)
    UNION ALL SELECT 'session_feedback', id, session_id FROM session_feedback WHERE session_id NOT IN (SELECT id FROM s)
    UNION ALL SELECT 'session_facilitators', id, session_id FROM session_facilitators WHERE session_id NOT IN (SELECT id FROM s)""")
def delete_cascade_snapshot(t):
    """M5 CASCADE: what is left of the five tables."""
    keys = t.raw("part").where(F.col("p_name") == "red widget").select(key_uuid("p_partkey").alias("id"))
    new, _ = M.propagate_delete({n: t.table(n) for n in _CASCADE_TABLES}, "courses", keys)
    return _left(new, {}, {"sessions": "course_id", "attendance": "session_id", "session_feedback": "session_id",
                           "session_facilitators": "session_id"})


@query("delete_set_null_snapshot", with_tables("formations", "officers", "sessions") + """,
    k AS (SELECT 'F' || CAST(n_nationkey AS VARCHAR) AS root FROM nation WHERE n_regionkey = 2)
    SELECT 'formations' AS table_name, id, CAST(NULL AS VARCHAR) AS reference FROM formations WHERE id NOT IN (SELECT root FROM k)
    UNION ALL SELECT 'officers', id, CASE WHEN formation_id NOT IN (SELECT root FROM k) THEN formation_id END FROM officers
    UNION ALL SELECT 'sessions', id, CASE WHEN formation_id NOT IN (SELECT root FROM k) THEN formation_id END FROM sessions""")
def delete_set_null_snapshot(t):
    """M5 SET NULL: formations that are left, and the formation of every officer and session."""
    keys = t.raw("nation").where(F.col("n_regionkey") == 2) \
        .select(F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("id"))
    new, _ = M.propagate_delete({n: t.table(n) for n in ("formations", "officers", "sessions")}, "formations", keys)
    return _left(new, {}, {"officers": "formation_id", "sessions": "formation_id"})


@query("delete_restrict_snapshot", with_tables(*_RESTRICT_TABLES) + """,
    gone AS (SELECT id FROM users u WHERE role = 'admin'
             AND NOT EXISTS (SELECT 1 FROM courses c WHERE c.created_by_user_id = u.id)
             AND NOT EXISTS (SELECT 1 FROM import_jobs j WHERE j.created_by_user_id = u.id))
    SELECT 'users' AS table_name, id, CAST(NULL AS VARCHAR) AS reference FROM users WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'courses', id, created_by_user_id FROM courses
    UNION ALL SELECT 'import_jobs', id, created_by_user_id FROM import_jobs
    UNION ALL SELECT 'tokens', hash, user_id FROM tokens WHERE user_id NOT IN (SELECT id FROM gone)""")
def delete_restrict_snapshot(t):
    """M5 RESTRICT: blocked users stay with all that refers to them."""
    keys = t.users.where(F.col("role") == "admin").select("id")
    new, _ = M.propagate_delete({n: t.table(n) for n in _RESTRICT_TABLES}, "users", keys)
    return _left(new, {"tokens": "hash"}, {"courses": "created_by_user_id", "import_jobs": "created_by_user_id",
                                           "tokens": "user_id"})
