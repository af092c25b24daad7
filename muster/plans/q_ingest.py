"""Registered queries: strict NDJSON ingest (S2), inserts (S3-S5), JSON output (S6),
the import ledger (S7) and the outcome report (C5).

Request bodies are built from driver rows; which defect a body carries is a pure
function of its key (``key % 8``), so the oracle can state every expected outcome
as a CASE without decoding anything.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from muster.functions.ids import key_uuid
from muster.operators import ingest as I
from muster.operators import listing as L
from muster.plans.catalog import ORACLE, query
from muster.plans.oracle_sql import AS_OF, uid, with_tables
from muster.plans.q_listing import LIST_CASES, _list_sql, _meta_sql
from muster.plans.specs import LIST_SPECS
from muster.plans.standins import AS_OF as AS_OF_TEXT
from muster.session import checkpoint_dir
from muster.sources import ndjson as N
from muster.sources import sinks as S
from muster.streaming.insert import read_report, run_insert_stream


# --- officer create bodies ---------------------------------------------------------------------
def officer_lines(t):
    c = t.raw("customer")
    name, seg, nat = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    good = F.concat(F.lit('{"regulation_number":null,"first_name":"'), name,
                    F.lit('","last_name":"'), seg, F.lit('","sex":"male","rank_code":"NATION_'),
                    nat, F.lit('"}'))
    k = F.col("c_custkey") % 8
    line = (F.when(k == 0, good)
            .when(k == 1, F.lit("  \t "))
            .when(k == 2, F.concat(F.lit('{"first_name":"'), name))
            .when(k == 3, F.concat(good, F.lit(" "), good))
            .when(k == 4, F.concat(F.lit('{"first_name":"'), name,
                                   F.lit('","nickname":"x","last_name":5}')))
            .when(k == 5, F.concat(F.lit('{"last_name":'), nat, F.lit(',"nickname":"x"}')))
            .when(k == 6, F.concat(F.lit('{"FIRST_NAME":"'), name, F.lit('","First_Name":null,'
                                   '"last_name":"'), seg, F.lit('","Sex":"female","rank_code":"R'),
                                   nat, F.lit('","first_name":"'), F.lower(name), F.lit('"}')))
            .otherwise(F.concat(F.lit("["), good, F.lit("]"))))
    return c.select(F.col("c_custkey").alias("line_id"), line.alias("value"))


_K = "c_custkey % 8"
_OFFICER_EXPECTED = f"""
    SELECT c_custkey AS line_id,
           CASE {_K} WHEN 1 THEN 'empty' WHEN 2 THEN 'malformed' WHEN 3 THEN 'multiple_values'
                WHEN 4 THEN 'unknown_field:nickname' WHEN 5 THEN 'wrong_type:last_name'
                WHEN 7 THEN 'wrong_type' END AS reject_code,
           CAST(NULL AS VARCHAR) AS regulation_number,
           CASE {_K} WHEN 0 THEN c_name WHEN 6 THEN lower(c_name) END AS first_name,
           CASE WHEN {_K} IN (0, 6) THEN c_mktsegment END AS last_name,
           CASE {_K} WHEN 0 THEN 'male' WHEN 6 THEN 'female' END AS sex,
           CASE {_K} WHEN 0 THEN 'NATION_' || CAST(c_nationkey AS VARCHAR)
                WHEN 6 THEN 'R' || CAST(c_nationkey AS VARCHAR) END AS rank_code
    FROM customer"""


def _decoded_officers(t):
    return N.ingest_ndjson(officer_lines(t), N.INPUTS["officers"])


@query("ndjson_ingest", _OFFICER_EXPECTED)
def ndjson_ingest(t):
    """Decode officer create bodies: typed fields or a reject code per line."""
    return _decoded_officers(t)


@query("ndjson_rejects", f"SELECT line_id, reject_code FROM ({_OFFICER_EXPECTED}) e "
                         "WHERE reject_code IS NOT NULL")
def ndjson_rejects(t):
    """S2 reject report."""
    return N.split_rejects(_decoded_officers(t))[1].select("line_id", "reject_code")


# --- session create bodies (RFC 3339 times) ---------------------------------------------------
def session_lines(t):
    o = t.raw("orders")

    def iso(ts):  # wall-clock text of a timestamp_ntz, independent of the session zone
        return F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))

    start = iso(F.col("o_orderdate"))
    end = iso(F.timestamp_add("SECOND", F.lit(7200), F.col("o_orderdate")))
    k = F.col("o_orderkey") % 4
    start_json = (F.when(k == 0, F.concat(F.lit('"'), start, F.lit('Z"')))
                  .when(k == 1, F.concat(F.lit('"'), F.substring(start, 1, 10), F.lit('"')))
                  .when(k == 2, F.col("o_orderkey").cast("string"))
                  .otherwise(F.concat(F.lit('"'), start, F.lit('+02:00"'))))
    body = F.concat(F.lit('{"course_id":"'), key_uuid("o_custkey"), F.lit('","start_datetime":'),
                    start_json, F.lit(',"end_datetime":"'), end, F.lit('Z","location_text":"'),
                    F.col("o_orderpriority"), F.lit('"}'))
    return o.select(F.col("o_orderkey").alias("line_id"), body.alias("value"))


@query("ndjson_ingest_sessions", f"""
    SELECT o_orderkey AS line_id,
           CASE o_orderkey % 4 WHEN 1 THEN 'bad_time:start_datetime'
                WHEN 2 THEN 'wrong_type:start_datetime' END AS reject_code,
           CASE WHEN o_orderkey % 4 IN (0, 3) THEN {uid('o_custkey')} END AS course_id,
           CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 3 THEN o_orderdate - INTERVAL 2 HOUR
                END AS start_datetime,
           CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_orderdate + INTERVAL 2 HOUR END
             AS end_datetime,
           CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_orderpriority END AS location_text
    FROM orders""")
def ndjson_ingest_sessions(t):
    """S2 with times: RFC 3339 with Z or an offset (normalised to UTC); a date alone or a
    number is rejected."""
    return N.ingest_ndjson(session_lines(t), N.INPUTS["sessions"])


# --- C5 outcome report ----------------------------------------------------------------------------
@query("outcome_report", f"""
    SELECT line_id AS seq, reject_code,
           CASE WHEN reject_code IS NOT NULL THEN 'bad_input' ELSE 'ok' END AS outcome,
           CAST(NULL AS VARCHAR) AS first_error,
           CASE WHEN reject_code IS NOT NULL THEN 400 ELSE 200 END AS status
    FROM ({_OFFICER_EXPECTED}) e""")
def outcome_report(t):
    """C5 per officer body: bad_input (decode) / invalid (rules) / ok, with HTTP status."""
    d = _decoded_officers(t).withColumnRenamed("line_id", "seq")
    return I.outcome_report(d, "officers")


# --- S3 bulk insert of attendance ----------------------------------------------------------------
def attendance_batch(t):
    o = t.raw("orders")
    status = (F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("maybe"))
              .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("excused"))
              .otherwise(F.lit("attended")))
    hours = F.col("o_totalprice").cast("decimal(14,2)") * F.lit(0.002).cast("decimal(4,3)")

    def rows(where, seq):
        return o.where(where).select(
            seq.alias("seq"), F.concat(F.lit("ins-"), seq.cast("string")).alias("id"),
            key_uuid(F.col("o_custkey") * 2).alias("officer_id"),
            key_uuid("o_orderkey").alias("session_id"), status.alias("status"),
            hours.alias("credited_hours"))

    first = rows(F.lit(True), F.col("o_orderkey"))
    again = rows(F.col("o_orderstatus") == "F", F.col("o_orderkey") + 1_000_000_000)
    return first.unionByName(again)


_BATCH_SQL = f"""
    SELECT seq, 'ins-' || CAST(seq AS VARCHAR) AS id, officer_id, session_id, status, credited_hours
    FROM (SELECT o_orderkey AS seq, {uid('o_custkey * 2')} AS officer_id,
                 {uid('o_orderkey')} AS session_id,
                 CASE o_orderpriority WHEN '2-HIGH' THEN 'maybe' WHEN '3-MEDIUM' THEN 'excused'
                      ELSE 'attended' END AS status,
                 CAST(o_totalprice AS DECIMAL(14,2)) * CAST(0.002 AS DECIMAL(4,3)) AS credited_hours
          FROM orders
          UNION ALL
          SELECT o_orderkey + 1000000000, {uid('o_custkey * 2')}, {uid('o_orderkey')},
                 CASE o_orderpriority WHEN '2-HIGH' THEN 'maybe' WHEN '3-MEDIUM' THEN 'excused'
                      ELSE 'attended' END,
                 CAST(o_totalprice AS DECIMAL(14,2)) * CAST(0.002 AS DECIMAL(4,3))
          FROM orders WHERE o_orderstatus = 'F') b"""


@query("bulk_insert", with_tables("attendance", "officers", "sessions") + f""",
    b AS ({_BATCH_SQL}),
    c AS (SELECT b.*,
            status IN ('attended', 'absent', 'excused') AND coalesce(CAST(credited_hours AS DOUBLE), 0) >= 0
              AND coalesce(officer_id, '') <> '' AND coalesce(session_id, '') <> '' AS valid,
            TRY_CAST(credited_hours AS DECIMAL(4,1)) IS NOT NULL AS num_ok,
            EXISTS (SELECT 1 FROM officers o WHERE o.id = b.officer_id)
              AND EXISTS (SELECT 1 FROM sessions s WHERE s.id = b.session_id) AS fk_ok,
            EXISTS (SELECT 1 FROM attendance a WHERE a.officer_id = b.officer_id
                    AND a.session_id = b.session_id) AS held
          FROM b),
    f AS (SELECT officer_id, session_id, min(seq) AS first FROM c
          WHERE valid AND num_ok AND fk_ok GROUP BY officer_id, session_id),
    d AS (SELECT c.*, CASE WHEN NOT valid THEN 'invalid' WHEN NOT num_ok THEN 'numeric_overflow'
                   WHEN NOT fk_ok THEN 'fk_violation'
                   WHEN held OR c.seq <> f.first THEN 'duplicate' ELSE 'created' END AS outcome
          FROM c LEFT JOIN f ON c.officer_id = f.officer_id AND c.session_id = f.session_id)
    SELECT seq, id, outcome,
           CASE outcome WHEN 'created' THEN 201 WHEN 'invalid' THEN 422 WHEN 'duplicate' THEN 422
                ELSE 500 END AS status
    FROM d""")
def bulk_insert(t):
    """S3: every order enrols officer 2 x customer into its session; completed orders are
    submitted twice. Rules, NUMERIC(4,1), both foreign keys and the (officer, session)
    unique key against the base and inside the batch."""
    parents = {"officers": t.officers, "sessions": t.sessions}
    _, report = I.bulk_insert(t.attendance, attendance_batch(t), "attendance", AS_OF_TEXT,
                              parents=parents)
    return report.select("seq", "id", "outcome", "status")


def _inserted_by_stream(t):
    """The batch of ``bulk_insert`` in three parts by sequence number, a micro-batch each; returns the stream's folder."""
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/inserts-{uuid.uuid4().hex}"
    batch = attendance_batch(t)
    # first submissions in two parts by order key, second ones in the third
    last = F.lit(1_000_000_000)
    middle = t.raw("orders").agg(F.expr("cast(avg(o_orderkey) AS bigint)")).scalar()
    parents = {"officers": t.officers, "sessions": t.sessions}
    for part in (F.col("seq") < middle, F.col("seq").between(middle, last), F.col("seq") > last):
        # a part arrives in as many files as it has tasks; the stream, started again, takes them as its next batch
        batch.where(part).write.mode("append").parquet(f"{folder}/rows")
        rows = t.spark.readStream.schema(batch.schema).parquet(f"{folder}/rows")
        run = run_insert_stream(rows, t.attendance, "attendance", AS_OF_TEXT, f"{folder}/out", lambda: parents)
        run.awaitTermination()
        if run.exception() is not None:
            raise RuntimeError(str(run.exception()))
    return f"{folder}/out"


@query("bulk_insert_stream", ORACLE["bulk_insert"])
def bulk_insert_stream(t):
    """S3 on Structured Streaming: the report over all micro-batches; the second submission finds the first's keys."""
    return read_report(t.spark, _inserted_by_stream(t)).select("seq", "id", "outcome", "status")


@query("bulk_insert_snapshot", ORACLE["bulk_insert"].rsplit("SELECT seq, id, outcome", 1)[0] + f"""
    SELECT id, officer_id, session_id, status, CAST(credited_hours AS DECIMAL(4,1)) AS credited_hours,
           CAST({AS_OF} AS TIMESTAMP) AS created_at, CAST(1 AS INTEGER) AS version FROM d WHERE outcome = 'created'
    UNION ALL SELECT id, officer_id, session_id, status, credited_hours, created_at, version FROM attendance""")
def bulk_insert_snapshot(t):
    """S3: the new version of attendance, generated columns included."""
    new, _ = I.bulk_insert(t.attendance, attendance_batch(t), "attendance", AS_OF_TEXT,
                           parents={"officers": t.officers, "sessions": t.sessions})
    return new.select("id", "officer_id", "session_id", "status", "credited_hours", "created_at", "version")


# --- S4 insert if absent --------------------------------------------------------------------------
@query("insert_if_absent", with_tables("session_facilitators") + f"""
    SELECT b.* FROM (SELECT o_orderkey AS seq, {uid('o_orderkey')} AS session_id,
                            {uid('o_custkey // 15')} AS facilitator_id FROM orders) b
    WHERE NOT EXISTS (SELECT 1 FROM session_facilitators s WHERE s.session_id = b.session_id
                      AND s.facilitator_id = b.facilitator_id)""")
def insert_if_absent(t):
    """Link every order's session to facilitator customer / 15 unless already linked."""
    batch = t.raw("orders").select(F.col("o_orderkey").alias("seq"),
                                   key_uuid("o_orderkey").alias("session_id"),
                                   key_uuid(F.expr("o_custkey div 15")).alias("facilitator_id"))
    return I.insert_if_absent(t.session_facilitators, batch, ("session_id", "facilitator_id")) \
        .select("seq", "session_id", "facilitator_id")


# --- S5 insert from a query -----------------------------------------------------------------------
@query("insert_select", with_tables("officers", "ranks") + """
    SELECT id AS seq, 'fac-' || id AS id,
           CASE WHEN first_name <> '' AND last_name <> '' THEN 'created' ELSE 'invalid' END
             AS outcome,
           CASE WHEN first_name <> '' AND last_name <> '' THEN 201 ELSE 422 END AS status
    FROM officers WHERE sex = 'female'""")
def insert_select(t):
    """INSERT INTO facilitators SELECT ... FROM officers WHERE sex = 'female'."""
    return _selected(t)[1].select("seq", "id", "outcome", "status")


@query("insert_select_snapshot", with_tables("officers", "facilitators") + """
    SELECT 'fac-' || id AS id, id AS officer_id, first_name, last_name, rank_code, CAST(NULL AS VARCHAR) AS posting_id,
           'from officers' AS notes, CAST(1 AS INTEGER) AS version
    FROM officers WHERE sex = 'female' AND first_name <> '' AND last_name <> ''
    UNION ALL SELECT id, officer_id, first_name, last_name, rank_code, posting_id, notes, version FROM facilitators""")
def insert_select_snapshot(t):
    """The new version of facilitators."""
    return _selected(t)[0].select("id", "officer_id", "first_name", "last_name", "rank_code", "posting_id", "notes", "version")


def _selected(t):
    src = t.officers.where(F.col("sex") == "female")
    mapping = {"seq": "id", "id": F.concat(F.lit("fac-"), F.col("id")),
               "officer_id": "id", "first_name": "first_name", "last_name": "last_name",
               "rank_code": "rank_code", "notes": F.lit("from officers")}
    return I.insert_select(t.facilitators, src, "facilitators", AS_OF_TEXT, mapping,
                           parents={"officers": t.officers, "ranks": t.ranks})


# --- S6 JSON ------------------------------------------------------------------------------------
def _officer_json_sql(alias: str = "") -> str:
    a = alias
    return (f"'{{\"id\":\"' || {a}id || '\",' || CASE WHEN {a}regulation_number IS NOT NULL THEN "
            f"'\"regulation_number\":\"' || {a}regulation_number || '\",' ELSE '' END || "
            f"'\"first_name\":\"' || {a}first_name || '\",\"last_name\":\"' || {a}last_name || "
            f"'\",\"sex\":\"' || {a}sex || '\",\"rank_code\":\"' || {a}rank_code || "
            f"'\",\"created_at\":\"' || strftime({a}created_at, '%Y-%m-%dT%H:%M:%S') || "
            f"rtrim(rtrim(strftime({a}created_at, '.%f'), '0'), '.') || 'Z' || "
            f"'\",\"version\":' || CAST({a}version AS VARCHAR) || '}}'")


@query("json_rows", with_tables("officers") +
       f"SELECT id, '{{\"officer\":' || {_officer_json_sql()} || '}}' AS json FROM officers")
def json_rows(t):
    """One {"officer": {...}} document per officer; NULL members left out."""
    return S.json_rows(t.officers, "officers", "officer")


_ENV_ARGS, _ENV_WHERE, _ENV_ORDER = LIST_CASES["officers"]


@query("json_page_envelope", f"""
    WITH p AS ({_list_sql('officers', _ENV_WHERE, _ENV_ORDER, _ENV_ARGS.page,
                          _ENV_ARGS.page_size)}),
         m AS ({_meta_sql(_list_sql('officers', _ENV_WHERE, _ENV_ORDER, _ENV_ARGS.page,
                                    _ENV_ARGS.page_size), _ENV_ARGS.page, _ENV_ARGS.page_size)})
    SELECT '{{"officers":[' || coalesce((SELECT string_agg({_officer_json_sql('p.')}, ','
                 ORDER BY p.first_name DESC NULLS FIRST, p.id) FROM p), '') ||
           '],"metadata":' ||
           (SELECT '{{"current_page":' || CAST(current_page AS VARCHAR) || ',"page_size":' ||
                   CAST(page_size AS VARCHAR) || ',"first_page":' || CAST(first_page AS VARCHAR) ||
                   ',"last_page":' || CAST(last_page AS VARCHAR) || ',"total_records":' ||
                   CAST(total_records AS VARCHAR) || '}}' FROM m) || '}}' AS json""")
def json_page_envelope(t):
    """{"officers": [page rows], "metadata": {...}} for the officer listing page."""
    spec = LIST_SPECS["officers"]
    page = L.list_page(t.officers, spec, _ENV_ARGS)
    meta = L.page_metadata(page, _ENV_ARGS.page, _ENV_ARGS.page_size)
    return S.json_page_envelope(page.drop("total_records"), meta, "officers",
                                L.sort_columns(spec, _ENV_ARGS.sort))


# --- S7 import ledger ----------------------------------------------------------------------------
@query("import_job_ledger", f"""
    SELECT 'job-officers-1' AS id, 'officers' AS type,
           CASE WHEN rejected > 0 OR created < tried THEN 'failed' ELSE 'completed' END AS status,
           CASE WHEN rejected > 0 OR created < tried THEN
             CAST(rejected + tried - created AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) ||
             ' rows not imported' END AS error_message,
           {uid(0)} AS created_by_user_id,
           TIMESTAMP '2024-01-15 12:00:00' AS created_at,
           TIMESTAMP '2024-01-15 12:05:00' AS finished_at, 1 AS version,
           n AS rows_read, rejected AS rows_rejected, created AS rows_created
    FROM (SELECT count(*) AS n, count(reject_code) AS rejected,
                 count(*) - count(reject_code) AS tried,
                 count(*) FILTER (WHERE reject_code IS NULL AND sex = 'male') AS created
          FROM ({_OFFICER_EXPECTED}) e) s""")
def import_job_ledger(t):
    """Run an officer import (decode → rules → insert) and write its ledger row."""
    decoded = _decoded_officers(t)
    good = N.split_rejects(decoded)[0].withColumnRenamed("line_id", "seq") \
        .withColumn("id", F.concat(F.lit("imp-"), F.col("seq").cast("string")))
    _, report = I.bulk_insert(t.officers, good.drop("reject_code"), "officers", AS_OF_TEXT,
                              parents={"ranks": t.ranks})
    return I.import_ledger("job-officers-1", "officers", "00000000-0000-4000-8000-000000000000",
                           "2024-01-15 12:00:00", "2024-01-15 12:05:00", decoded, report)
