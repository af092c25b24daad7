"""Registered query: the filtered totals of a whole log of list requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators.totals import totals_for_requests
from muster.plans.catalog import query
from muster.plans.oracle_sql import with_tables

#: arguments of the request that a customer stands for, in SQL of both engines
_ARGS = {
    "last_name": "CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN '' WHEN 2 THEN c_mktsegment ELSE NULL END",
    "region_id": "CASE WHEN c_custkey % 3 = 0 THEN concat('R', CAST(c_nationkey % 7 AS STRING)) END",
    "sex": "CASE WHEN c_custkey % 5 = 0 THEN 'MALE' WHEN c_custkey % 5 = 1 THEN 'female' END",
}
FILTERS = {"last_name": "ci", "region_id": "id", "sex": "ci"}


@query("totals_for_requests", with_tables("officers") + """,
    q AS (SELECT c_custkey AS request_id, """ + ", ".join(f"{v} AS {k}" for k, v in _ARGS.items()) + """ FROM customer)
    SELECT request_id, (SELECT count(*) FROM officers o WHERE (coalesce(q.last_name, '') = '' OR lower(o.last_name) = lower(q.last_name))
        AND (coalesce(q.region_id, '') = '' OR o.region_id = q.region_id)
        AND (coalesce(q.sex, '') = '' OR lower(o.sex) = lower(q.sex))) AS total_records FROM q""")
def totals(t):
    """A1/A2 for a log: one list request per customer, with changing arguments."""
    requests = t.raw("customer").select(F.col("c_custkey").alias("request_id"), *[F.expr(v).alias(k) for k, v in _ARGS.items()])
    return totals_for_requests(t.officers, requests, FILTERS)
