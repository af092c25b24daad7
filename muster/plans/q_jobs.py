"""Registered query: the history of import jobs from a log of status changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators.jobs import import_job_history
from muster.plans.catalog import query

_STATUS = ("CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_type = 'purchase' AND value >= 80 THEN 'completed' "
           "WHEN event_type IN ('purchase', 'error') THEN 'failed' WHEN value < 3 THEN 'cancelled' ELSE 'running' END")


@query("import_job_history", f"""
    WITH RECURSIVE ev AS (SELECT user_id AS job_id, event_id AS seq, ts AS changed_at, {_STATUS} AS status,
                                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    h(job_id, seq, changed_at, status, rn, state, attempt, applied) AS (
        SELECT job_id, seq, changed_at, status, rn, CASE WHEN status = 'pending' THEN status END, CAST(0 AS BIGINT), status = 'pending'
        FROM ev WHERE rn = 1
        UNION ALL
        SELECT job_id, seq, changed_at, status, rn, CASE WHEN ok THEN status ELSE state END,
               attempt + CASE WHEN ok AND status = 'running' THEN 1 ELSE 0 END, ok
        FROM (SELECT e.*, h.state, h.attempt, CASE WHEN h.state IS NULL THEN e.status = 'pending'
                     WHEN h.state IN ('pending', 'failed') THEN e.status = 'running'
                     WHEN h.state = 'running' THEN e.status IN ('completed', 'failed') ELSE FALSE END AS ok
              FROM h JOIN ev e ON e.job_id = h.job_id AND e.rn = h.rn + 1) n)
    SELECT job_id, seq, changed_at, status, CASE WHEN applied THEN 'applied' ELSE 'illegal' END AS outcome, state, attempt FROM h""")
def history(t):
    """Every event is a status change of the import job of its user."""
    log = t.raw("events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("changed_at"),
                                 F.expr(_STATUS).alias("status"))
    return import_job_history(log, at="changed_at")
