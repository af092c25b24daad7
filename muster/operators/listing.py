"""Filtered, sorted, paged listings.

Plan shape of ``list_page`` (checked with ``explain``):

* the filters are plain column predicates, so equality on an id reaches the
  Parquet scan as a pushed filter, and only the needed columns are read;
* the page is ``orderBy(...).offset(o).limit(n)``, which plans as one
  ``TakeOrderedAndProject``: every task keeps only its best ``o + n`` rows and the
  driver merges them. No global sort, no shuffle of the table;
* the total is a separate partial/final ``count`` (map-side combine) attached to the
  page rows as a scalar subquery. A ``count(*) OVER ()`` window would plan an
  ``Exchange SinglePartition`` of the whole filtered table instead.

A caller who walks far into a large listing calls ``deep_page`` instead: positions from a
distributed range sort (``global_positions``), so no task holds the ``o + n`` best rows. Page
arguments allow at most a million rows of offset, which one task still sorts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.predicates import ci_equal, id_equal
from muster.functions.text import matches_all_terms
from muster.plans.specs import MAX_PAGE, MAX_PAGE_SIZE, ListSpec, PageArgs
from muster.schemas import PUBLIC
from muster.session import pin

INT_PATTERN = r"^[+-]?[0-9]+\z"
_POS_BITS = 33  # monotonically_increasing_id keeps the partition index above bit 33


# --- page-argument validation (L4 / V12) ---------------------------------------------
def validate_page_args(spec: ListSpec, args: PageArgs, max_page: int | None = MAX_PAGE) -> dict[str, str]:
    """Error map for one request's page arguments; empty = valid. First message per key wins.

    ``max_page`` None: no bound, for callers that got the page number from the listing itself."""
    errors: dict[str, str] = {}

    def check(ok: bool, key: str, msg: str) -> None:
        if not ok:
            errors.setdefault(key, msg)

    sort = args.sort or spec.default_sort
    check(args.page > 0, "page", "must be greater than zero")
    check(max_page is None or args.page <= max_page, "page", f"must be a maximum of {max_page or 0:,}")
    check(args.page_size > 0, "page_size", "must be greater than zero")
    check(args.page_size <= MAX_PAGE_SIZE, "page_size", "must be a maximum of 100")
    check(sort in spec.safelist, "sort", "invalid sort value")
    return errors


def _parsed_int(text: Column, default: int) -> tuple[Column, Column]:
    """(value, parse_failed) for an integer query-string argument; '' or NULL = default."""
    given = F.coalesce(text, F.lit("")) != F.lit("")
    ok = text.rlike(INT_PATTERN) & (F.length(F.regexp_replace(text, "^[+-]?0*", "")) <= 18)
    value = F.when(~given, F.lit(default)).when(ok, text.cast("bigint")).otherwise(F.lit(default))
    return value, given & ~F.coalesce(ok, F.lit(False))


def validate_page_requests(requests: DataFrame, spec: ListSpec, page_col: str = "page",
                           size_col: str = "page_size", sort_col: str = "sort") -> DataFrame:
    """V12 over a log of requests whose arguments are raw query-string text.

    Adds one message column per argument (NULL = fine) and ``valid``. One pass, no shuffle.
    """
    page, page_bad = _parsed_int(F.col(page_col), 1)
    size, size_bad = _parsed_int(F.col(size_col), 20)
    sort = F.when(F.coalesce(F.col(sort_col), F.lit("")) == "", F.lit(spec.default_sort)) \
        .otherwise(F.col(sort_col))
    page_err = (F.when(page_bad, "must be an integer value")
                .when(page <= 0, "must be greater than zero")
                .when(page > MAX_PAGE, "must be a maximum of 10,000"))
    size_err = (F.when(size_bad, "must be an integer value")
                .when(size <= 0, "must be greater than zero")
                .when(size > MAX_PAGE_SIZE, "must be a maximum of 100"))
    sort_err = F.when(~sort.isin(list(spec.safelist)), "invalid sort value")
    return (requests
            .withColumn("page_error", page_err)
            .withColumn("page_size_error", size_err)
            .withColumn("sort_error", sort_err)
            .withColumn("valid", F.col("page_error").isNull() & F.col("page_size_error").isNull()
                        & F.col("sort_error").isNull()))


# --- filters (F1-F4) ------------------------------------------------------------------
def filter_predicate(spec: ListSpec, values: dict) -> Column | None:
    """AND of the predicates for the non-empty arguments; None when nothing filters."""
    preds = []
    for arg, kind, col in spec.filters:
        v = values.get(arg, "") or ""
        if v == "":
            continue  # an empty argument means "no filter": leave the predicate out
        if kind == "text":
            preds.append(matches_all_terms(F.coalesce(F.col(col), F.lit("")), v))
        elif kind == "ci":
            preds.append(ci_equal(col, v))
        elif kind == "id":
            preds.append(id_equal(col, v))
        else:
            raise ValueError(f"unknown filter kind {kind!r}")
    return reduce(lambda a, b: a & b, preds) if preds else None


def apply_filters(df: DataFrame, spec: ListSpec, values: dict) -> DataFrame:
    pred = filter_predicate(spec, values)
    return df if pred is None else df.where(pred)


# --- sort (L1) --------------------------------------------------------------------------
def sort_columns(spec: ListSpec, sort: str | None) -> list[Column]:
    """Safelisted sort, NULLs last ascending / first descending, then the id ascending."""
    sort = sort or spec.default_sort
    if sort not in spec.safelist:
        raise ValueError(f"invalid sort value {sort!r}")
    name = sort.lstrip("-")
    key = F.col(name).desc_nulls_first() if sort.startswith("-") else F.col(name).asc_nulls_last()
    return [key, F.col(spec.tiebreak).asc_nulls_last()]


# --- positions for every row (L5 building block) -------------------------------------
def global_positions(df: DataFrame, order: list[Column], pos_col: str = "position") -> DataFrame:
    """0-based position of every row in ``order``, without a single-partition window.

    A distributed range sort puts the rows in global order across partitions; the
    sorted layout is pinned with a reliable checkpoint (so a recomputation after a
    lost executor cannot change it); each row's position inside its partition comes
    from ``monotonically_increasing_id`` (low 33 bits) and the partition's start is
    the prefix sum of per-partition counts, a table with one row per partition
    (bounded by the partition count, not the data) that is broadcast back.
    """
    mid = "_mid"
    laid_out = pin(df.orderBy(*order).withColumn(mid, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(mid), _POS_BITS)
    counts = laid_out.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_start"))
    starts = starts.select("_part", F.coalesce("_start", F.lit(0)).alias("_start"))
    local = F.col(mid).bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    return (laid_out.join(F.broadcast(starts), part == F.col("_part"))
            .withColumn(pos_col, F.col("_start") + local)
            .drop(mid, "_part", "_start"))


# --- one page (L1 + L2 + A1) ------------------------------------------------------------
def list_page(df: DataFrame, spec: ListSpec, args: PageArgs, columns=None) -> DataFrame:
    """Rows of one page plus ``total_records`` (the filtered total), like the reference.

    Raises ``ValueError`` carrying the error map when the page arguments are invalid.
    """
    errors = validate_page_args(spec, args)
    if errors:
        raise ValueError(errors)
    columns = list(columns or PUBLIC[spec.table])
    filtered = apply_filters(df, spec, args.filters)
    order = sort_columns(spec, args.sort)
    offset = (args.page - 1) * args.page_size
    projected = filtered.select(*columns)
    page = projected.orderBy(*order).offset(offset).limit(args.page_size)
    # the filtered total as a scalar subquery: one partial/final count, attached to the
    # page rows without any join
    total = filtered.agg(F.count(F.lit(1)).alias("total_records")).scalar()
    return page.select(total.alias("total_records"), *columns)


def deep_page(df: DataFrame, spec: ListSpec, args: PageArgs, columns=None) -> DataFrame:
    """The rows of :func:`list_page` by position after a distributed sort.

    Runs a job when called (the sorted layout is checkpointed), so it is a plan the caller
    chooses, never one that ``list_page`` switches to.
    """
    errors = validate_page_args(spec, args)
    if errors:
        raise ValueError(errors)
    columns = list(columns or PUBLIC[spec.table])
    filtered = apply_filters(df, spec, args.filters)
    start = (args.page - 1) * args.page_size
    total = filtered.agg(F.count(F.lit(1)).alias("total_records")).scalar()
    placed = global_positions(filtered.select(*columns), sort_columns(spec, args.sort), "_pos")
    return placed.where(F.col("_pos").between(start, start + args.page_size - 1)) \
        .select(total.alias("total_records"), *columns)


# --- page metadata (A2) -------------------------------------------------------------------
def page_metadata(page: DataFrame, page_no: int, page_size: int) -> DataFrame:
    """One row: current/size/first/last page and total, all NULL when the page is empty.

    The total is read from the page rows, so a page past the end of a non-empty
    table yields empty metadata, as in the reference.
    """
    total = page.agg(F.max("total_records").alias("t"))
    has = F.coalesce(F.col("t"), F.lit(0)) > 0
    return total.select(
        F.when(has, F.lit(page_no)).alias("current_page"),
        F.when(has, F.lit(page_size)).alias("page_size"),
        F.when(has, F.lit(1)).alias("first_page"),
        F.when(has, F.ceil(F.col("t") / F.lit(page_size)).cast("int")).alias("last_page"),
        F.when(has, F.col("t")).alias("total_records"),
    )


# --- every page at once (L5) ----------------------------------------------------------
def paginate_all(df: DataFrame, spec: ListSpec, page_size: int, sort: str | None = None,
                 filters: dict | None = None, columns=None) -> DataFrame:
    """Page number and row-in-page for every row (a bulk export of all pages)."""
    columns = list(columns or PUBLIC[spec.table])
    filtered = apply_filters(df, spec, filters or {}).select(*columns)
    pos = global_positions(filtered, sort_columns(spec, sort), "_pos")
    return pos.select(
        *columns,
        (F.floor(F.col("_pos") / page_size) + 1).cast("bigint").alias("page"),
        (F.col("_pos") % page_size + 1).cast("bigint").alias("row_in_page"))


# --- full ordered listing (L3) ----------------------------------------------------------
def user_directory(users: DataFrame) -> DataFrame:
    """Every user, public columns, ordered by e-mail (a distributed range sort)."""
    return users.select(*PUBLIC["users"]).orderBy(F.col("email").asc_nulls_last())


def public_projection(df: DataFrame, table: str) -> DataFrame:
    """The fixed public column list of a table."""
    return df.select(*PUBLIC[table])
