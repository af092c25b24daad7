"""Inserts in bulk (S3-S5), the import ledger (S7) and the per-row outcome report.

``bulk_insert`` does in one batch what the reference does per request: validate,
check unique keys against the base *and* against earlier rows of the same batch,
check foreign keys and value checks, coerce numerics, fill generated columns.
All checks are joins on keys, and windows over the rows of a key where a join has left them;
the report has one row per input row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.ids import content_uuid
from muster.functions.time import as_of_literal, utc_as
from muster.operators.constraints import coerce_numeric, outcome_column, with_status
from muster.operators.constraints import missing_from
from muster.operators.validate import RULES, ddl_check_rules, validate_columns, fields_of
from muster.operators.validate import _ok as rule_ok
from muster.schemas import FOREIGN_KEYS, NUMERIC_COLUMNS, SCHEMAS, UNIQUE_KEYS, not_null_columns
from muster.session import pin

PENDING = "pending"  # fixed value: the status of an import job that has not run
GENERATED = ("id", "created_at", "version", "activated")


def _key_state(checked: DataFrame, batch: DataFrame, base: DataFrame, keys: tuple[str, ...], seq_col: str, j: int) -> DataFrame:
    """``checked`` with, per row, whether the base holds its key (``_held{j}``) and the ``seq`` of the key's first
    eligible row (``_first{j}``).

    The base's keys meet the distinct keys of ``batch``, which are read from it without its checks. The first is a window
    over the checked rows as the join to those leaves them, partitioned and sorted by the key: rows are checked once.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    asked = batch.where(present).select(*keys).distinct()
    known = asked.join(base.select(*keys), list(keys), "left_semi").withColumn(f"_held{j}", F.lit(True))
    first = F.min(F.when(F.col("_eligible"), F.col(seq_col))).over(Window.partitionBy(*keys))
    return checked.join(known, list(keys), "left").withColumn(f"_first{j}", F.when(present, first))


def bulk_insert(base: DataFrame, batch: DataFrame, table: str, as_of,
                parents: dict[str, DataFrame] | None = None, id_expr: Column | None = None,
                seq_col: str = "seq", rules=None, pin_batch: bool = False):
    """Insert ``batch`` rows into ``base``. Returns ``(new_base, report)``.

    Outcomes (first that applies): invalid (rule set, with ``errors``), check_violation
    (DDL CHECK), numeric_overflow, constraint_violation (NULL in a NOT NULL column),
    fk_violation (a non-NULL reference with no parent in ``parents``), duplicate (the
    primary key or a unique key held by the base or by an earlier row of the batch),
    created. Every reference column of the batch needs its parent table in ``parents``
    (ValueError otherwise); ``seq`` must be unique and not NULL (a NULL fails the job). Generated columns: ``id`` (``id_expr``; by default a
    UUID-shaped hash of the row's values including ``seq``, stable under recomputation),
    ``created_at`` = ``as_of``, ``version`` = 1, an import job's ``status`` = ``pending``,
    NULL for other absent columns.

    The batch is checked once per result; every key costs one shuffle of it, one of its distinct keys and
    one of the base's. ``pin_batch=True`` writes the judged batch to the shared checkpoint folder, so that
    rows and report do not judge it twice; worth it for large batches whose both results are used.
    """
    inserted, report = insert_rows(base, batch, table, as_of, parents, id_expr, seq_col, rules, pin_batch)
    return base.select(*inserted.columns).unionByName(inserted), report


def insert_rows(base: DataFrame, batch: DataFrame, table: str, as_of,
                parents: dict[str, DataFrame] | None = None, id_expr: Column | None = None,
                seq_col: str = "seq", rules=None, pin_batch: bool = False):
    """The rows that :func:`bulk_insert` adds, and its report: ``(inserted, report)``."""
    parents = parents or {}
    rules = RULES.get(table, []) if rules is None else rules
    schema = SCHEMAS[table]
    cols = [f.name for f in schema.fields]
    missing = sorted({fk.parent for fk in FOREIGN_KEYS if fk.child == table
                      and fk.column in batch.columns and fk.parent not in parents})
    if missing:
        raise ValueError(f"{table} references {', '.join(missing)}: pass them in parents")
    no_seq = F.raise_error(F.lit(f"{seq_col} must not be NULL")).cast(batch.schema[seq_col].dataType)
    b = batch.withColumn(seq_col, F.coalesce(F.col(seq_col), no_seq))
    if table == "import_jobs" and "status" not in b.columns:
        b = b.withColumn("status", F.lit(PENDING))
    own_id = "id" in b.columns
    if not own_id:
        # deterministic by default: a retried task must not mint a different id
        b = b.withColumn("id", id_expr if id_expr is not None
                         else content_uuid(F.lit(table), *[F.col(c) for c in b.columns]))
    checked = validate_columns(b, rules, prefix="_err_") if rules else b.withColumn(
        "valid", F.lit(True))
    errs = fields_of(rules)
    checked = checked.withColumn("errors", F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(f) for f in errs]),
                          F.array(*[F.col(f"_err_{f}") for f in errs])),
        lambda k, v: v.isNotNull()) if errs else F.create_map().cast("map<string,string>"))
    # DDL checks and numeric precision
    ddl = ddl_check_rules(table)
    check_ok = reduce(lambda a, r: a & rule_ok(r), ddl, F.lit(True))
    num_ok = F.lit(True)
    for c, p, s in NUMERIC_COLUMNS.get(table, ()):
        if c in checked.columns:
            dec, bad = coerce_numeric(F.col(c), p, s)
            checked = checked.withColumn(f"_dec_{c}", dec)
            num_ok = num_ok & ~bad
    given = [c for c in not_null_columns(table) if c not in GENERATED]
    null_ok = reduce(lambda a, c: a & (F.col(c).isNotNull() if c in checked.columns else F.lit(False)),
                     given, F.lit(True))
    checked = checked.withColumns({"_check_ok": check_ok, "_num_ok": num_ok, "_null_ok": null_ok})
    # foreign keys: one anti-join per reference whose parent is given
    fk_ok = F.lit(True)
    for i, fk in enumerate(fk for fk in FOREIGN_KEYS if fk.child == table):
        if fk.column not in batch.columns:
            continue
        keys = parents[fk.parent].select(F.col(fk.parent_column).alias(f"_p{i}")).distinct()
        checked = checked.join(keys, checked[fk.column] == keys[f"_p{i}"], "left")
        fk_ok = fk_ok & (F.col(fk.column).isNull() | F.col(f"_p{i}").isNotNull())
    checked = checked.withColumn("_fk_ok", fk_ok)
    eligible = F.col("valid") & F.col("_check_ok") & F.col("_num_ok") & F.col("_null_ok") & F.col("_fk_ok")
    checked = checked.withColumn("_eligible", eligible)
    # keys (but for a generated id): against the base, then inside the batch; only eligible rows come so far
    dup = F.lit(False)
    unique = [k for k in UNIQUE_KEYS.get(table, ()) if (own_id or k != ("id",)) and all(c in checked.columns for c in k)]
    for j, keys in enumerate(unique):
        checked = _key_state(checked, b, base, keys, seq_col, j)
        dup = dup | F.coalesce(F.col(f"_held{j}"), F.lit(False)) | F.coalesce(F.col(seq_col) != F.col(f"_first{j}"), F.lit(False))
    outcome = outcome_column(
        (~F.col("valid"), "invalid"), (~F.col("_check_ok"), "check_violation"),
        (~F.col("_num_ok"), "numeric_overflow"), (~F.col("_null_ok"), "constraint_violation"),
        (~F.col("_fk_ok"), "fk_violation"),
        (dup, "duplicate"), default="created")
    decided = checked.withColumn("outcome", outcome)
    if pin_batch:
        decided = pin(decided)
    created = decided.where(F.col("outcome") == "created")
    row = []
    for f in schema.fields:
        if f"_dec_{f.name}" in created.columns:
            row.append(F.col(f"_dec_{f.name}").cast(f.dataType).alias(f.name))
        elif f.name == "created_at":
            kind = base.schema[f.name].dataType
            row.append(utc_as(as_of_literal(as_of), kind).alias(f.name))
        elif f.name == "version":
            row.append(F.lit(1).alias(f.name))
        elif f.name == "activated" and f.name not in created.columns:
            row.append(F.lit(False).alias(f.name))
        elif f.name in created.columns:
            row.append(F.col(f.name).alias(f.name))
        else:
            row.append(F.lit(None).alias(f.name))
    inserted = created.select(*row)
    base_cast = base.select(*[F.col(c) for c in cols])
    inserted = inserted.select(*[F.col(c).cast(base_cast.schema[c].dataType) for c in cols])
    report = with_status(decided.select(seq_col, "id", "outcome",
                                        F.when(~F.col("valid"), F.col("errors")).alias("errors")))
    return inserted, report


def insert_if_absent(base: DataFrame, batch: DataFrame, keys: tuple[str, ...],
                     seq_col: str = "seq") -> DataFrame:
    """Rows of ``batch`` whose key is held neither by ``base`` nor by an earlier batch row.

    The first row per key is one ``min_by`` aggregate (partial aggregation: a key
    repeated a million times costs one row per task before the shuffle), then one
    anti-join against the base keys.
    """
    rest = [c for c in batch.columns if c not in keys]
    firsts = batch.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(seq_col)).alias("_row"))
    once = firsts.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return missing_from(once, base.select(*keys), list(keys)).select(*batch.columns)


def insert_select(base: DataFrame, source: DataFrame, table: str, as_of, mapping: dict,
                  **kw):
    """``INSERT INTO table SELECT ...``: project ``source`` by ``mapping`` then bulk insert.

    ``mapping`` names a unique, non-NULL ``seq`` (e.g. the source's key): it orders the rows and
    keeps the generated ids of equal rows apart."""
    if kw.get("seq_col", "seq") not in mapping:
        raise ValueError("mapping must give a unique, non-NULL seq")
    batch = source.select(*[(v if isinstance(v, Column) else F.col(v)).alias(k)
                            for k, v in mapping.items()])
    return bulk_insert(base, batch, table, as_of, **kw)


# --- S7 import ledger -----------------------------------------------------------------------
LEDGER_COLUMNS = ("id", "type", "status", "error_message", "created_by_user_id", "created_at",
                  "finished_at", "version", "rows_read", "rows_rejected", "rows_created")


def import_ledger(job_id: str, job_type: str, user_id: str, created_at, finished_at,
                  decoded: DataFrame, report: DataFrame) -> DataFrame:
    """One ledger row for a finished import: counts from the decode and insert reports.

    Status ``completed`` when every line decoded and inserted, else ``failed`` with an
    error message naming the counts. All counts are one aggregate each (no collect).
    """
    read = decoded.agg(F.count(F.lit(1)).alias("rows_read"),
                       F.count_if(F.col("reject_code").isNotNull()).alias("rows_rejected"))
    made = report.agg(F.struct(F.count_if(F.col("outcome") == "created").alias("rows_created"),
                               F.count(F.lit(1)).alias("_tried")).alias("m")).scalar()
    j = read.select("*", made.alias("_m")).select("*", "_m.rows_created", "_m._tried")
    failed = (F.col("rows_rejected") > 0) | (F.col("rows_created") < F.col("_tried"))
    return j.select(
        F.lit(job_id).alias("id"), F.lit(job_type).alias("type"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, F.concat(
            (F.col("rows_rejected") + F.col("_tried") - F.col("rows_created")).cast("string"),
            F.lit(" of "), F.col("rows_read").cast("string"), F.lit(" rows not imported")))
        .alias("error_message"),
        F.lit(user_id).alias("created_by_user_id"),
        as_of_literal(created_at).alias("created_at"), as_of_literal(finished_at).alias("finished_at"),
        F.lit(1).alias("version"),
        F.col("rows_read").cast("bigint").alias("rows_read"),
        F.col("rows_rejected").cast("bigint").alias("rows_rejected"),
        F.col("rows_created").cast("bigint").alias("rows_created"))


# --- C5 outcome report -------------------------------------------------------------------------
def outcome_report(decoded: DataFrame, table: str, seq_col: str = "seq",
                   rules=None) -> DataFrame:
    """Outcome class and HTTP status per submitted line: bad_input (decode reject),
    invalid (rule failure), else ok. Constraint outcomes come from ``bulk_insert``."""
    rules = RULES.get(table, []) if rules is None else rules
    checked = validate_columns(decoded, rules, prefix="_err_")
    outcome = outcome_column((F.col("reject_code").isNotNull(), "bad_input"),
                             (~F.col("valid"), "invalid"))
    first_err = F.coalesce(*[F.when(F.col(f"_err_{f}").isNotNull(),
                                    F.concat(F.lit(f + ": "), F.col(f"_err_{f}")))
                             for f in fields_of(rules)])
    out = checked.select(seq_col, "reject_code", outcome.alias("outcome"),
                         F.when(F.col("reject_code").isNull(), first_err).alias("first_error"))
    return with_status(out)
