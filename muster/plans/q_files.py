"""Registered queries on stored files: mutations that rewrite the touched files alone, pages from a directory."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators.directory import build_directory, directory_total, read_page
from muster.plans.catalog import query
from muster.plans.oracle_sql import with_tables
from muster.plans.specs import LIST_SPECS
from muster.plans.standins import AS_OF
from muster.schemas import PUBLIC, UPDATABLE
from muster.session import checkpoint_dir
from muster.sources import file_table as T


def _folder(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("rewrite_touched", with_tables("attendance") + """,
    b AS (SELECT max(created_at) - INTERVAL 90 DAY AS late, min(created_at) + INTERVAL 90 DAY AS early FROM attendance),
    m AS (SELECT a.*, created_at >= late AND right(id, 1) <> '1' AS hit, created_at <= early AND status = 'absent' AS gone
          FROM attendance a, b)
    SELECT id, CASE WHEN hit THEN 'excused' ELSE status END AS status,
           CASE WHEN hit THEN CAST(0.25 AS DECIMAL(4,1)) ELSE credited_hours END AS credited_hours,
           CAST(CASE WHEN hit THEN version + 1 ELSE version END AS INTEGER) AS version
    FROM m WHERE NOT gone""")
def rewrite_touched(t):
    """M1 on the last 90 days of attendance, M3 on absences of the first 90, each rewriting the files of its days;
    rows whose id ends in 1 are patched with a stale version and stay."""
    folder, base = _folder(t, "touched"), t.attendance
    table = T.store_table(base, f"{folder}/v0", ["created_at", "id"])
    stored = table.read(t.spark)
    late = stored.agg(F.expr("max(created_at) - INTERVAL 90 DAYS")).scalar()
    patches = stored.where(F.col("created_at") >= late).select(
        "id", (F.col("version") + (F.right("id", F.lit(1)) == "1").cast("int")).alias("expected_version"),
        F.lit(1).alias("seq"), F.lit("excused").alias("status"), F.lit("0.25").cast("decimal(8,2)").alias("credited_hours"))
    patched, _ = T.update_rows(t.spark, table, patches, "attendance", UPDATABLE["attendance"], AS_OF, f"{folder}/v1")
    early = stored.agg(F.expr("min(created_at) + INTERVAL 90 DAYS")).scalar()
    gone = stored.where((F.col("created_at") <= early) & (F.col("status") == "absent"))
    left = T.delete_rows(t.spark, patched, gone, ["id"], f"{folder}/v2")
    return left.read(t.spark).select("id", "status", "credited_hours", "version")


@query("page_from_directory", with_tables("sessions") + f""",
    o AS (SELECT {', '.join(PUBLIC['sessions'])}, count(*) OVER () AS total_records,
                 row_number() OVER (ORDER BY start_datetime DESC NULLS FIRST, id) - 1 AS pos FROM sessions),
    p AS (SELECT *, pos // 20 + 1 AS page, (total_records + 19) // 20 AS last FROM o)
    SELECT CAST(page AS INTEGER) AS page, total_records, {', '.join(PUBLIC['sessions'])} FROM p WHERE page IN (1, (last + 1) // 2, last)""")
def page_from_directory(t) -> DataFrame:
    """The first, the middle and the last page of the stored listing of all sessions, latest first."""
    folder, spec = _folder(t, "directory"), LIST_SPECS["sessions"]
    build_directory(t.sessions, spec, folder, "-start_datetime")
    last = -(-directory_total(t.spark, folder) // 20)
    pages = sorted({1, (last + 1) // 2, last} - {0}) or [1]
    return reduce(DataFrame.unionByName, [
        read_page(t.spark, folder, spec, n, 20, max_page=None).select(F.lit(n).alias("page"), "*") for n in pages])
