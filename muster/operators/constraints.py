"""Constraint audits Spark does not enforce (C1-C4) and the per-row outcome report.

Scale notes
* C1 is one aggregate over the table (partial counts per task, one tiny final).
* C2 counts key hashes, then the keys of hashes that occur twice, each with map-side partial
  aggregation: a key holding a third of all rows becomes one partial count per map task.
* C3 first reduces the child to its distinct key values with counts (partial
  aggregation again, so a hot parent key costs one row per task), then anti-joins
  those against the parent keys. No broadcast hint: parents are unbounded tables;
  Catalyst/AQE broadcast them only when their measured size is under the threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.schemas import FOREIGN_KEYS, NUMERIC_COLUMNS, SCHEMAS, UNIQUE_KEYS, ForeignKey
from muster.session import pin


# --- C1 -------------------------------------------------------------------------------------
def null_profile(df: DataFrame, table: str) -> DataFrame:
    """One row per schema column: NULL count, nullability, and whether NOT NULL is violated."""
    fields = [f for f in SCHEMAS[table].fields if f.name in df.columns]
    counts = df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in fields])
    stack = ", ".join(f"'{f.name}', {str(f.nullable).lower()}, `{f.name}`" for f in fields)
    rows = counts.selectExpr(
        f"stack({len(fields)}, {stack}) AS (column_name, nullable, null_count)")
    return rows.select(
        F.lit(table).alias("table_name"), "column_name", "nullable",
        F.col("null_count").cast("bigint").alias("null_count"),
        ((~F.col("nullable")) & (F.col("null_count") > 0)).alias("violation"))


def not_null_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """C1 over several tables: one union of per-table NULL profiles."""
    return reduce(DataFrame.unionByName, [null_profile(df, t) for t, df in tables.items()])


# --- C2 -------------------------------------------------------------------------------------
def duplicate_keys(df: DataFrame, table: str, keys: tuple[str, ...]) -> DataFrame:
    """Key values held by more than one row; rows with any NULL key part are exempt."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    grouped = df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return grouped.where(F.col("row_count") > 1).select(
        F.lit(table).alias("table_name"),
        F.lit(",".join(keys)).alias("key_columns"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key_value"),
        "row_count")


#: duplicate keys that are sent whole to every task; a longer list is joined by a shuffle
BROADCAST_KEYS = 1_000_000


def unique_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Every declared unique and primary key of every given table.

    Each row emits one (key columns, key parts) pair per key set (parts as an array, so composite keys cannot
    collide), and rows with a NULL part are exempt. Almost all keys are held once, so the keys themselves are not
    shuffled: a first scan counts 64-bit hashes of them, of all tables in one partially aggregated group-by, and a
    second one groups the keys whose hash occurs twice. Keys are compared in full there; equal hashes of different
    keys only add rows to it. The job of the first scan runs when this is called.
    """
    keyed = {}
    for t, df in tables.items():
        sets = [k for k in UNIQUE_KEYS.get(t, ()) if all(c in df.columns for c in k)]
        if not sets:
            continue
        pairs = F.array(*[F.struct(
            F.lit(",".join(k)).alias("key_columns"),
            F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k]),
                   F.array(*[F.col(c).cast("string") for c in k])).alias("key_parts"))
            for k in sets])
        keyed[t] = df.select(F.inline(pairs)).where(F.col("key_parts").isNotNull()) \
            .withColumn("_hash", F.xxhash64(F.lit(t), "key_columns", "key_parts"))
    hashes = reduce(DataFrame.unionByName, [k.select("_hash") for k in keyed.values()])
    twice = pin(hashes.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_hash"))
    if twice.count() <= BROADCAST_KEYS:
        twice = F.broadcast(twice)
    parts = []
    for t, k in keyed.items():
        counted = k.join(twice, "_hash", "left_semi").groupBy("key_columns", "key_parts") \
            .agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)
        parts.append(counted.select(F.lit(t).alias("table_name"), "key_columns",
                                    F.array_join("key_parts", "|").alias("key_value"),
                                    "row_count"))
    return reduce(DataFrame.unionByName, parts)


# --- C3 -------------------------------------------------------------------------------------
def orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Distinct non-NULL child key values with no parent row, with how many rows hold each."""
    values = child.where(F.col(fk.column).isNotNull()) \
        .groupBy(F.col(fk.column).alias("key_value")).agg(F.count(F.lit(1)).alias("row_count"))
    keys = parent.select(F.col(fk.parent_column).alias("key_value"))
    missing = missing_from(values, keys, ["key_value"])
    return missing.select(
        F.lit(fk.child).alias("child_table"), F.lit(fk.column).alias("column_name"),
        F.lit(fk.parent).alias("parent_table"), F.col("key_value").cast("string").alias("key_value"),
        "row_count")


def fk_audit(tables: dict[str, DataFrame], fks=FOREIGN_KEYS) -> DataFrame:
    """C3 for every foreign key whose child and parent tables are both given.

    One scan per child table emits (fk, value) for each of its references; the
    distinct values are counted with partial aggregation (a hot parent key costs one
    row per task); one anti-join against the union of all parent keys, tagged by
    parent table, finds the orphans of all foreign keys together.
    """
    live = [fk for fk in fks if fk.child in tables and fk.parent in tables
            and fk.column in tables[fk.child].columns]
    refs = []
    for child in dict.fromkeys(fk.child for fk in live):
        mine = [fk for fk in live if fk.child == child]
        pairs = F.array(*[F.struct(F.lit(fk.column).alias("column_name"),
                                   F.lit(fk.parent).alias("parent_table"),
                                   F.col(fk.column).cast("string").alias("key_value"))
                          for fk in mine])
        refs.append(tables[child].select(F.lit(child).alias("child_table"), F.inline(pairs)))
    values = reduce(DataFrame.unionByName, refs).where(F.col("key_value").isNotNull()) \
        .groupBy("child_table", "column_name", "parent_table", "key_value") \
        .agg(F.count(F.lit(1)).alias("row_count"))
    keys = reduce(DataFrame.unionByName, [
        tables[p].select(F.lit(p).alias("parent_table"),
                         F.col(col).cast("string").alias("key_value"))
        for p, col in dict.fromkeys((fk.parent, fk.parent_column) for fk in live)])
    return missing_from(values, keys, ["parent_table", "key_value"]) \
        .select("child_table", "column_name", "parent_table", "key_value", "row_count")


def missing_from(values: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``values`` with no match in ``keys``. ``keys`` need not be distinct: a
    repeated key only repeats matched rows, and those are dropped.

    Written as a left join plus a NULL test rather than ``left_anti``: Catalyst pushes
    an anti join below the aggregate that produced ``values`` when the join keys are
    its grouping keys, which would shuffle every raw child row to the join instead of
    one partial count per key and task.
    """
    marked = keys.select(*on, F.lit(True).alias("_found"))
    return values.join(marked, on, "left").where(F.col("_found").isNull()).drop("_found")


# --- C4 -------------------------------------------------------------------------------------
def coerce_numeric(col: Column, precision: int, scale: int) -> tuple[Column, Column]:
    """(decimal value, overflow flag): rounds half away from zero; too wide → NULL + flag."""
    dec = col.try_cast(f"decimal({precision},{scale})")
    return dec, col.isNotNull() & dec.isNull()


def numeric_coercion(df: DataFrame, table: str | None = None, columns=None) -> DataFrame:
    """C4: cast every NUMERIC(p,s) column of ``table`` (or the given ``(col, p, s)``
    list) present in ``df``; flag overflows."""
    out = df
    flags = []
    for col, p, s in (columns if columns is not None else NUMERIC_COLUMNS.get(table, ())):
        if col not in df.columns:
            continue
        dec, bad = coerce_numeric(F.col(col), p, s)
        # both from the input column, in one projection
        out = out.withColumns({col: dec, f"{col}_overflow": bad})
        flags.append(F.col(f"{col}_overflow"))
    return out.withColumn("numeric_ok", ~reduce(lambda a, b: a | b, flags) if flags
                          else F.lit(True))


# --- C5 -------------------------------------------------------------------------------------
# fixed values: outcome classes and their HTTP status in the reference
OUTCOME_STATUS = {
    "ok": 200, "allowed": 200, "updated": 200, "created": 201, "bad_input": 400,
    "unauthenticated": 401, "invalid_token": 401, "inactive": 403, "not_found": 404,
    "method_not_allowed": 405, "conflict": 409, "invalid": 422, "duplicate": 422, "rate_limited": 429,
    "constraint_violation": 500, "check_violation": 500, "fk_violation": 500,
    "numeric_overflow": 500,
}


def outcome_column(*cases: tuple[Column, str], default: str = "ok") -> Column:
    """First matching (condition, outcome) wins; otherwise ``default``."""
    expr = None
    for cond, name in cases:
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def with_status(df: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    status = F.create_map(*[x for k, v in OUTCOME_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("status", status[F.col(outcome_col)])


def outcome_summary(reports: dict[str, DataFrame], outcome_col: str = "outcome") -> DataFrame:
    """Rows per source, outcome and status over several reports: one partially aggregated count."""
    tagged = [df.select(F.lit(name).alias("source"), F.col(outcome_col).alias("outcome")) for name, df in reports.items()]
    counts = reduce(DataFrame.unionByName, tagged).groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("row_count"))
    return with_status(counts)
