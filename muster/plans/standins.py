"""Domain tables derived from the driver's TPC-H-style tables.

The driver data has no officers, courses, ... so each domain table is a pure
column mapping of one driver table (no joins, no row filters): its size grows with
the driver table. Defects that the audits and rules must find (NULLs, duplicate
keys, out-of-list values, end before start, orphans) come from the data's own
attributes, e.g. a negative account balance.

| domain               | driver table | id                                  |
| -------------------- | ------------ | ----------------------------------- |
| users, officers      | customer     | key_uuid(c_custkey)                 |
| courses              | part         | key_uuid(p_partkey)                 |
| sessions, import_jobs| orders       | key_uuid(o_orderkey)                |
| facilitators         | supplier     | key_uuid(s_suppkey)                 |
| attendance, feedback, session_facilitators | lineitem | line_id(orderkey, linenumber, partkey, suppkey, quantity) |
| tokens, requests     | events       | hash of lpad(event_id, 26, 'A')     |
| regions, postings / formations, ranks | region / nation | 'R'/'P'+key / 'F'+key, n_name |

Timestamps stay ``timestamp_ntz`` like the driver data.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.ids import key_uuid, line_id
from muster.functions.time import ntz_literal
from muster.schemas import SCOPE_ACTIVATION, SCOPE_AUTHENTICATION, SCOPE_PASSWORD_RESET
from muster.sources.tables import load_table

EPOCH = "2024-01-01 00:00:00"
AS_OF = "2024-01-15 12:00:00"  # the fixed "now" of every time-dependent query


def ts_lit(text: str) -> Column:
    return ntz_literal(text)


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_add("SECOND", s, ts)


def _null(type_: str) -> Column:
    return F.lit(None).cast(type_)


class StandIns:
    """Lazily derived domain tables over one driver data folder."""

    _shared: dict[tuple[str, str], StandIns] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._raw: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, root: str) -> StandIns:
        """One set of stand-in DataFrames per (session, folder), reused across queries
        like a catalog of views (DataFrames are immutable; building them is driver work)."""
        try:  # the JVM session's own id survives Python object reuse
            ident = str(spark._jsparkSession.sessionUUID())
        except Exception:
            ident = str(id(spark))
        key = (ident, os.path.abspath(root))
        if key not in cls._shared:
            cls._shared[key] = cls(spark, root)
        return cls._shared[key]

    def raw(self, name: str) -> DataFrame:
        """A driver table, as Spark splits it."""
        if name not in self._raw:
            self._raw[name] = load_table(self.spark, self.root, name)
        return self._raw[name]

    # --- lookup tables --------------------------------------------------------------
    @cached_property
    def regions(self) -> DataFrame:
        return self.raw("region").select(
            F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"),
            F.col("r_name").alias("name"))

    @cached_property
    def formations(self) -> DataFrame:
        return self.raw("nation").select(
            F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("id"),
            F.col("n_name").alias("name"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region_id"))

    @cached_property
    def postings(self) -> DataFrame:
        return self.raw("region").select(
            F.concat(F.lit("P"), F.col("r_regionkey").cast("string")).alias("id"),
            F.col("r_name").alias("name"))

    @cached_property
    def ranks(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_name").alias("code"),
                                         F.col("n_name").alias("name"))

    # --- people -------------------------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        email = F.concat(F.lower(F.regexp_replace("c_name", "#", ".")),
                         F.when(F.col("c_acctbal") < 0, F.lit("@example..org"))
                         .otherwise(F.lit("@example.org")))
        role = (F.when(F.col("c_mktsegment") == "BUILDING", "admin")
                .when(F.col("c_mktsegment") == "AUTOMOBILE", "contributor")
                .when(F.col("c_mktsegment") == "HOUSEHOLD", "user")
                .otherwise("viewer"))
        return c.select(
            key_uuid("c_custkey").alias("id"),
            email.alias("email"),
            F.sha2(F.col("c_name"), 256).alias("password_hash"),
            role.alias("role"),
            plus_seconds(ts_lit(EPOCH), F.col("c_custkey") * 60).alias("created_at"),
            _null("timestamp_ntz").alias("last_login_at"),
            (F.col("c_custkey") % 3 + 1).cast("int").alias("version"),
            (F.col("c_acctbal") >= 0).alias("activated"))

    @cached_property
    def officers(self) -> DataFrame:
        c = self.raw("customer")
        reg = F.when(F.col("c_acctbal") >= 0, F.concat(
            F.lit("REG-"), F.lpad(F.floor("c_acctbal").cast("bigint").cast("string"), 5, "0")))
        sex = (F.when(F.col("c_nationkey") == 24, "other")
               .when(F.col("c_nationkey") % 3 == 0, "male")
               .when(F.col("c_nationkey") % 3 == 1, "female")
               .otherwise("unknown"))
        return c.select(
            key_uuid("c_custkey").alias("id"),
            reg.alias("regulation_number"),
            F.col("c_name").alias("first_name"),
            F.col("c_mktsegment").alias("last_name"),
            sex.alias("sex"),
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("rank_code"),
            F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string")).alias("region_id"),
            F.concat(F.lit("F"), F.col("c_nationkey").cast("string")).alias("formation_id"),
            F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("posting_id"),
            plus_seconds(ts_lit(EPOCH), F.col("c_custkey") * 60).alias("created_at"),
            _null("timestamp_ntz").alias("updated_at"),
            _null("timestamp_ntz").alias("archived_at"),
            (F.col("c_custkey") % 3 + 1).cast("int").alias("version"))

    @cached_property
    def facilitators(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            key_uuid("s_suppkey").alias("id"),
            F.when(F.col("s_acctbal") > 5000, key_uuid("s_suppkey")).alias("officer_id"),
            F.col("s_name").alias("first_name"),
            F.when(F.col("s_acctbal") >= 0,
                   F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")))
            .alias("last_name"),
            _null("string").alias("rank_code"),
            _null("string").alias("posting_id"),
            _null("string").alias("notes"),
            (F.col("s_suppkey") % 3 + 1).cast("int").alias("version"))

    # --- courses and sessions ---------------------------------------------------------
    @cached_property
    def courses(self) -> DataFrame:
        p = self.raw("part")
        category = (F.when(F.col("p_type") == "PROMO", "elective")
                    .when(F.col("p_type") == "LARGE", "instructor")
                    .when(F.col("p_type") == "ECONOMY", "other")
                    .otherwise("mandatory"))
        return p.select(
            key_uuid("p_partkey").alias("id"),
            F.col("p_name").alias("title"),
            category.alias("category"),
            (F.col("p_size") / F.lit(2.0)).cast("decimal(4,1)").alias("default_credit_hours"),
            F.col("p_brand").alias("description"),
            key_uuid(F.expr("p_partkey div 2")).alias("created_by_user_id"),
            plus_seconds(ts_lit(EPOCH), F.col("p_partkey") * 60).alias("created_at"),
            _null("timestamp_ntz").alias("updated_at"),
            (F.col("p_partkey") % 3 + 1).cast("int").alias("version"))

    @cached_property
    def sessions(self) -> DataFrame:
        o = self.raw("orders")
        start = F.col("o_orderdate")
        backwards = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
        location = (F.when(F.col("o_orderstatus") == "F",
                           F.concat(F.lit("Main Hall "), F.col("o_orderpriority")))
                    .when(F.col("o_orderstatus") == "O",
                          F.concat(F.lit("Room "), F.col("o_orderpriority"))))
        return o.select(
            key_uuid("o_orderkey").alias("id"),
            key_uuid("o_custkey").alias("course_id"),
            start.alias("start_datetime"),
            F.when(backwards, plus_seconds(start, -3600)).otherwise(plus_seconds(start, 7200))
            .alias("end_datetime"),
            _null("string").alias("region_id"),
            _null("string").alias("formation_id"),
            _null("string").alias("posting_id"),
            location.alias("location_text"),
            _null("string").alias("facilitator_notes"),
            F.when(F.col("o_orderstatus") == "O", F.lit(1.5).cast("decimal(4,1)"))
            .alias("credit_hours_override"),
            start.alias("created_at"),
            _null("timestamp_ntz").alias("updated_at"),
            (F.col("o_orderkey") % 3 + 1).cast("int").alias("version"))

    @cached_property
    def import_jobs(self) -> DataFrame:
        o = self.raw("orders")
        status = (F.when(F.col("o_orderstatus") == "F", "completed")
                  .when(F.col("o_orderstatus") == "O", "Running")
                  .otherwise("pending"))
        return o.select(
            key_uuid("o_orderkey").alias("id"),
            F.col("o_orderpriority").alias("type"),
            status.alias("status"),
            _null("string").alias("error_message"),
            key_uuid("o_custkey").alias("created_by_user_id"),
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderstatus") == "F", plus_seconds(F.col("o_orderdate"), 3600))
            .alias("finished_at"),
            F.lit(1).alias("version"))

    # --- line-level tables ---------------------------------------------------------------
    def _lines(self) -> DataFrame:
        return self.raw("lineitem")

    @staticmethod
    def _line_id() -> Column:
        return line_id("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")

    @cached_property
    def attendance(self) -> DataFrame:
        status = (F.when(F.col("l_returnflag") == "A", "attended")
                  .when(F.col("l_returnflag") == "N", "absent")
                  .otherwise("excused"))
        return self._lines().select(
            self._line_id().alias("id"),
            key_uuid(F.expr("l_partkey div 2")).alias("officer_id"),
            key_uuid("l_orderkey").alias("session_id"),
            status.alias("status"),
            F.col("l_quantity").cast("decimal(4,1)").alias("credited_hours"),
            F.col("l_shipdate").alias("created_at"),
            (F.col("l_linenumber") % 3 + 1).cast("int").alias("version"))

    @cached_property
    def session_feedback(self) -> DataFrame:
        return self._lines().select(
            self._line_id().alias("id"),
            key_uuid("l_orderkey").alias("session_id"),
            key_uuid("l_suppkey").alias("facilitator_id"),
            key_uuid(F.expr("l_partkey div 2")).alias("officer_id"),
            (F.col("l_quantity") / F.lit(10.0)).cast("decimal(2,1)").alias("rating"),
            F.when(F.col("l_linestatus") == "O", F.lit("open")).alias("comments"),
            F.col("l_shipdate").alias("created_at"),
            F.lit(1).alias("version"))

    @cached_property
    def session_facilitators(self) -> DataFrame:
        return self._lines().select(
            self._line_id().alias("id"),
            key_uuid("l_orderkey").alias("session_id"),
            key_uuid("l_suppkey").alias("facilitator_id"),
            F.when(F.col("l_linenumber") == 1, F.lit("lead")).alias("role"),
            F.lit(1).alias("version"))

    # --- credentials and requests ----------------------------------------------------------
    @staticmethod
    def token_text() -> Column:
        return F.lpad(F.col("event_id").cast("string"), 26, "A")

    @staticmethod
    def event_scope() -> Column:
        return (F.when(F.col("event_type") == "click", SCOPE_ACTIVATION)
                .when(F.col("event_type") == "purchase", SCOPE_PASSWORD_RESET)
                .otherwise(SCOPE_AUTHENTICATION))

    @cached_property
    def token_requests(self) -> DataFrame:
        """One token registration per event: (token, user_id, scope, issued_at)."""
        return self.raw("events").select(
            self.token_text().alias("token"),
            key_uuid("user_id").alias("user_id"),
            self.event_scope().alias("scope"),
            F.col("ts").alias("issued_at"))

    @cached_property
    def tokens(self) -> DataFrame:
        from muster.operators.access import register_tokens
        return register_tokens(self.token_requests).select("hash", "user_id", "expiry", "scope")

    @cached_property
    def requests(self) -> DataFrame:
        """A request log: id, Authorization header (or NULL), whether the route is guarded."""
        e = self.raw("events")
        tok = self.token_text()
        header = (F.when(F.col("value") < 5, _null("string"))
                  .when(F.col("event_type") == "error", F.concat(F.lit("Token "), tok))
                  .when(F.col("event_type") == "purchase",
                        F.concat(F.lit("Bearer "), tok, F.lit(" extra")))
                  .when(F.col("event_type") == "view",
                        F.concat(F.lit("Bearer "), F.substring(tok, 2, 25)))
                  .otherwise(F.concat(F.lit("Bearer "), tok)))
        return e.select(F.col("event_id").alias("request_id"),
                        header.alias("auth_header"),
                        (F.col("event_type") != "view").alias("guarded"))

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

