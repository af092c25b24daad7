"""Registered queries: projections, filters, listings, metadata, pagination."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators import listing as L
from muster.plans.catalog import query
from muster.plans.oracle_sql import has_all, with_tables
from muster.plans.specs import LIST_SPECS, PageArgs
from muster.schemas import PUBLIC


def _cols(table: str) -> str:
    return ", ".join(PUBLIC[table])


def _list_sql(table: str, where: list[str], order: str, page: int, size: int) -> str:
    w = " AND ".join(where) if where else "TRUE"
    return (with_tables(table) +
            f"SELECT count(*) OVER () AS total_records, {_cols(table)} FROM {table} "
            f"WHERE {w} ORDER BY {order} LIMIT {size} OFFSET {(page - 1) * size}")


# --- the eight paged listings: fixed arguments per listing --------------------------------
LIST_CASES = {
    "officers": (PageArgs(2, 5, "-first_name", {"last_name": "Machinery", "rank_code": "nation_7"}),
                 [has_all("last_name", ["machinery"]), "lower(rank_code) = 'nation_7'"],
                 "first_name DESC NULLS FIRST, id ASC"),
    "courses": (PageArgs(3, 10, "-default_credit_hours", {"title": "Red widget", "category": ""}),
                [has_all("title", ["red", "widget"])],
                "default_credit_hours DESC NULLS FIRST, id ASC"),
    "sessions": (PageArgs(2, 20, None, {"location": "main HALL urgent"}),
                 [has_all("location_text", ["main", "hall", "urgent"])],
                 "start_datetime ASC NULLS LAST, id ASC"),
    "facilitators": (PageArgs(1, 20, "-last_name", {"first_name": "supplier"}),
                     [has_all("first_name", ["supplier"])],
                     "last_name DESC NULLS FIRST, id ASC"),
    "attendance": (PageArgs(1, 50, "-status",
                            {"session_id": "00000000-0000-4000-8000-000000000007"}),
                   ["CAST(session_id AS VARCHAR) = '00000000-0000-4000-8000-000000000007'"],
                   "status DESC NULLS FIRST, id ASC"),
    "session_feedback": (PageArgs(1, 100, "rating",
                                  {"facilitator_id": "00000000-0000-4000-8000-000000000003"}),
                         ["CAST(facilitator_id AS VARCHAR) = '00000000-0000-4000-8000-000000000003'"],
                         "rating ASC NULLS LAST, id ASC"),
    "session_facilitators": (PageArgs(4, 25, "-facilitator_id", {}), [],
                             "facilitator_id DESC NULLS FIRST, id ASC"),
    "import_jobs": (PageArgs(2, 100, None, {"type": "1-urgent", "status": "running"}),
                    ["lower(type) = '1-urgent'", "lower(status) = 'running'"],
                    "created_at ASC NULLS LAST, id ASC"),
}


def _register_listing(name: str) -> None:
    args, where, order = LIST_CASES[name]
    spec = LIST_SPECS[name]

    def run(t):
        return L.list_page(t.table(spec.table), spec, args)
    run.__name__ = f"list_{name}"
    query(f"list_{name}", _list_sql(spec.table, where, order, args.page, args.page_size))(run)


for _n in LIST_CASES:
    _register_listing(_n)


# --- P1 public projection ---------------------------------------------------------------
@query("public_projection", with_tables("users") + f"SELECT {_cols('users')} FROM users")
def public_projection(t):
    """Users without password hash and version."""
    return L.public_projection(t.users, "users")


# --- F1 / F2 / F3 standalone filters ----------------------------------------------------
@query("filter_ci_equal", with_tables("import_jobs") +
       f"SELECT {_cols('import_jobs')} FROM import_jobs WHERE lower(status) = lower('RUNNING')")
def filter_ci_equal(t):
    spec = LIST_SPECS["import_jobs"]
    return L.apply_filters(t.import_jobs, spec, {"status": "RUNNING"}).select(*PUBLIC["import_jobs"])


@query("filter_id_equal", with_tables("sessions") +
       f"SELECT {_cols('sessions')} FROM sessions "
       "WHERE CAST(course_id AS VARCHAR) = '00000000-0000-4000-8000-000000000042'")
def filter_id_equal(t):
    spec = LIST_SPECS["sessions"]
    return L.apply_filters(t.sessions, spec,
                           {"course_id": "00000000-0000-4000-8000-000000000042"}) \
        .select(*PUBLIC["sessions"])


@query("filter_fulltext", with_tables("courses") +
       f"SELECT {_cols('courses')} FROM courses WHERE {has_all('title', ['cold', 'widget'])}")
def filter_fulltext(t):
    spec = LIST_SPECS["courses"]
    return L.apply_filters(t.courses, spec, {"title": "Widget, cold!"}).select(*PUBLIC["courses"])


DOC_QUERY = "The LICENSE"


@query("filter_fulltext_docs",
       f"SELECT doc_id, lang, source, n_chars FROM documents "
       f"WHERE {has_all('text', ['the', 'license'])}")
def filter_fulltext_docs(t):
    """Full-text match over whole documents (every term, whole tokens)."""
    from muster.functions.text import matches_all_terms
    d = t.raw("documents")
    return d.where(matches_all_terms("text", DOC_QUERY)).select("doc_id", "lang", "source", "n_chars")


# --- A2 page metadata --------------------------------------------------------------------
def _meta_sql(inner: str, page: int, size: int) -> str:
    return (f"SELECT CASE WHEN t > 0 THEN {page} END AS current_page, "
            f"CASE WHEN t > 0 THEN {size} END AS page_size, "
            f"CASE WHEN t > 0 THEN 1 END AS first_page, "
            f"CASE WHEN t > 0 THEN CAST(ceil(t / {size}) AS INTEGER) END AS last_page, "
            f"CASE WHEN t > 0 THEN t END AS total_records "
            f"FROM (SELECT max(total_records) AS t FROM ({inner}) p) m")


_off_args, _off_where, _off_order = LIST_CASES["officers"]


@query("page_metadata", _meta_sql(
    _list_sql("officers", _off_where, _off_order, 2, 5), 2, 5))
def page_metadata(t):
    args = LIST_CASES["officers"][0]
    page = L.list_page(t.officers, LIST_SPECS["officers"], args)
    return L.page_metadata(page, args.page, args.page_size)


@query("page_metadata_past_end", _meta_sql(
    _list_sql("officers", _off_where, _off_order, 500, 5), 500, 5))
def page_metadata_past_end(t):
    """A page past the end of a non-empty result: no rows, empty metadata."""
    a = LIST_CASES["officers"][0]
    args = PageArgs(500, 5, a.sort, a.filters)
    page = L.list_page(t.officers, LIST_SPECS["officers"], args)
    return L.page_metadata(page, args.page, args.page_size)


# --- L3 full ordered listing ---------------------------------------------------------------
@query("user_directory", with_tables("users") +
       f"SELECT {_cols('users')} FROM users ORDER BY email")
def user_directory(t):
    return L.user_directory(t.users)


# --- L5 every page of a listing ------------------------------------------------------------
@query("paginate_all", with_tables("attendance") +
       f"SELECT {_cols('attendance')}, "
       f"CAST((row_number() OVER w - 1) // 100 + 1 AS BIGINT) AS page, "
       f"CAST((row_number() OVER w - 1) % 100 + 1 AS BIGINT) AS row_in_page "
       f"FROM attendance WINDOW w AS (ORDER BY created_at ASC NULLS LAST, id ASC)")
def paginate_all(t):
    """Page number of every attendance row, default order, 100 rows a page."""
    return L.paginate_all(t.attendance, LIST_SPECS["attendance"], 100)


# --- L4 / V12 page-argument validation over a request log -----------------------------------
_PAGE_TEXT = ("CASE WHEN event_type = 'view' THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) "
              "WHEN event_type = 'click' THEN '' WHEN event_type = 'error' THEN 'x' || "
              "CAST(event_id AS VARCHAR) ELSE CAST(CAST(trunc(value) AS BIGINT) - 10 AS VARCHAR) END")
_SIZE_TEXT = ("CASE WHEN event_type = 'purchase' THEN CAST(CAST(trunc(value * 10) AS BIGINT) AS VARCHAR) "
              "ELSE CAST(user_id AS VARCHAR) END")
_SORT_TEXT = ("CASE WHEN event_type = 'signup' THEN '-title' WHEN event_type = 'view' THEN '' "
              "ELSE '-rank_code' END")


def _page_requests(t):
    e = t.raw("events")
    page = (F.when(F.col("event_type") == "view", F.col("value").cast("bigint").cast("string"))
            .when(F.col("event_type") == "click", F.lit(""))
            .when(F.col("event_type") == "error",
                  F.concat(F.lit("x"), F.col("event_id").cast("string")))
            .otherwise((F.col("value").cast("bigint") - 10).cast("string")))
    size = (F.when(F.col("event_type") == "purchase",
                   (F.col("value") * 10).cast("bigint").cast("string"))
            .otherwise(F.col("user_id").cast("string")))
    sort = (F.when(F.col("event_type") == "signup", F.lit("-title"))
            .when(F.col("event_type") == "view", F.lit(""))
            .otherwise(F.lit("-rank_code")))
    return e.select("event_id", page.alias("page"), size.alias("page_size"), sort.alias("sort"))


def _int_err(x: str, lo_msg: str, hi: int, hi_msg: str, default: int) -> str:
    ok = f"regexp_full_match({x}, '[+-]?[0-9]+')"
    val = f"(CASE WHEN coalesce({x}, '') = '' THEN {default} WHEN {ok} THEN CAST({x} AS BIGINT) END)"
    return (f"CASE WHEN coalesce({x}, '') <> '' AND NOT {ok} THEN 'must be an integer value' "
            f"WHEN {val} <= 0 THEN '{lo_msg}' WHEN {val} > {hi} THEN '{hi_msg}' END")


@query("validate_page_requests", f"""
    SELECT event_id, page, page_size, sort, page_error, page_size_error, sort_error,
           page_error IS NULL AND page_size_error IS NULL AND sort_error IS NULL AS valid
    FROM (SELECT *, {_int_err('page', 'must be greater than zero', 10000,
                              'must be a maximum of 10,000', 1)} AS page_error,
                 {_int_err('page_size', 'must be greater than zero', 100,
                           'must be a maximum of 100', 20)} AS page_size_error,
                 CASE WHEN (CASE WHEN coalesce(sort, '') = '' THEN 'id' ELSE sort END) NOT IN
                   ('id', 'first_name', 'last_name', 'rank_code', '-id', '-first_name',
                    '-last_name', '-rank_code') THEN 'invalid sort value' END AS sort_error
          FROM (SELECT event_id, {_PAGE_TEXT} AS page, {_SIZE_TEXT} AS page_size,
                       {_SORT_TEXT} AS sort FROM events) r) v""")
def validate_page_requests(t):
    """V12 over a request log built from events (officer listing safelist)."""
    return L.validate_page_requests(_page_requests(t), LIST_SPECS["officers"])



COMPOUND_QUERY = "Hall 1-URGENT"


@query("filter_fulltext_compound", with_tables("sessions") +
       f"SELECT {_cols('sessions')} FROM sessions "
       f"WHERE {has_all('location_text', ['1-urgent', 'hall', '1', 'urgent'])}")
def filter_fulltext_compound(t):
    """F3 with a hyphenated term: the compound must occur as such, not only its parts."""
    spec = LIST_SPECS["sessions"]
    return L.apply_filters(t.sessions, spec, {"location": COMPOUND_QUERY}) \
        .select(*PUBLIC["sessions"])
