"""Batch mutations: snapshot in → new snapshot + report out (M1-M5, A3).

Open-source Spark cannot MERGE into Parquet, so every mutation returns the new
version of each table as a DataFrame plus a per-row report; the caller writes the
snapshot to a new directory (``sources.sinks.write_snapshot``).

Scale notes
* Patches are judged by their own values first, so only the verdict and what the result asks
  for meets the base, in one equi-join on the id. The report's winner per id is a window over the
  rows as that join leaves them, partitioned and sorted by id: nothing is scanned, shuffled or
  sorted a second time, and many patches of one id go to disk as in the join. The snapshot's
  winner is a ``min`` aggregate.
* Delete propagation walks the static foreign-key graph; every step is a
  semi/anti join of a child table against the set of deleted parent keys. No
  iteration to a fixpoint is needed (the graph is acyclic) and nothing is
  collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.time import as_of_literal, utc_as
from muster.operators.constraints import coerce_numeric
from muster.operators.validate import RULES, _ok, ddl_check_rules, fields_of, validate_columns
from muster.schemas import (
    FOREIGN_KEYS,
    NUMERIC_COLUMNS,
    PATCHABLE,
    PRIMARY_KEYS,
    SCOPE_PASSWORD_RESET,
    STAMPS_UPDATED_AT,
    UNIQUE_KEYS,
    UPDATABLE,
    ForeignKey,
    not_null_columns,
)
from muster.session import pin


# --- M1 -----------------------------------------------------------------------------------------
def optimistic_update(base: DataFrame, patches: DataFrame, columns, as_of,
                      stamp_updated_at: bool = False, key: str = "id",
                      expected_col: str = "expected_version", seq_col: str = "seq",
                      unique_keys=(), violations=None):
    """Version-checked full update. Returns ``(new_base, report)``.

    A patch applies when the stored version equals ``expected_version`` (NULL means
    "whatever is current") and it breaks no constraint. ``seq`` orders the patches of one id and
    should be unique per id. Several patches for one id: the first in ``seq`` order
    among those that match wins; later ones are ``conflict`` (what running them one by
    one with equal expected versions yields). The winner replaces every listed
    column, NULL included, bumps the version and optionally stamps ``updated_at``; columns keep
    the base's types.
    ``violations`` turns the patches into the same rows with a column ``_violation`` (an
    outcome or NULL); a patch with one leaves its row unchanged and the version free for the next.
    A winner whose new value of a unique key (``unique_keys`` whose columns it writes)
    is held by another row, or by a winner with a lower ``seq``, fails as ``duplicate``
    and leaves its row unchanged (NULL keys are exempt). Rows are compared as they stand before
    the batch: a value that an earlier patch of the same batch gives up is still held.
    Report outcomes: updated / duplicate / conflict / not_found / a violation.
    """
    stored = base.select(F.col(key).alias("_k"), F.col("version").alias("_stored"))
    judged = violations(patches) if violations else patches.withColumn("_violation", F.lit(None).cast("string"))
    p = judged.join(stored, judged[key] == stored["_k"], "left").drop("_k")
    current = F.col("_stored").isNotNull() & (
        F.col(expected_col).isNull() | (F.col(expected_col) == F.col("_stored")))
    matches = current & F.col("_violation").isNull()
    new_cols = [f"_new_{c}" for c in columns]
    # one aggregation: the winning seq per id and the winning patch's values (min_by, so
    # exactly one applied patch per id even if a seq repeats)
    w = p.where(matches).groupBy(key).agg(
        F.min(seq_col).alias("_win"),
        F.min_by(F.struct(*[F.col(c).alias(n) for c, n in zip(columns, new_cols)]),
                 F.col(seq_col)).alias("_p")).select(key, "_win", "_p.*")
    # unique keys the update writes, checked on the winners only (one row per id)
    dup = F.lit(False)
    checked = [k for k in unique_keys if k != (key,) and all(c in columns for c in k)]
    for j, keys in enumerate(checked):
        newk = [f"_new_{c}" for c in keys]
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in newk])
        held = base.select(F.col(key).alias(f"_hid{j}"),
                           *[F.col(c).alias(n) for c, n in zip(keys, newk)]).where(present)
        clash = w.where(present).join(held, newk).where(F.col(f"_hid{j}") != F.col(key)) \
            .select(key).distinct().withColumn(f"_clash{j}", F.lit(True))
        w = w.join(clash, key, "left")
        # within the batch, only winners that do not already clash can claim a value
        firsts = w.where(present & F.col(f"_clash{j}").isNull()).groupBy(*newk) \
            .agg(F.min("_win").alias(f"_kf{j}"))
        w = w.join(firsts, newk, "left")
        dup = dup | (present & (F.coalesce(F.col(f"_clash{j}"), F.lit(False))
                                | F.coalesce(F.col("_win") != F.col(f"_kf{j}"), F.lit(False))))
    w = w.withColumn("_dup", dup)
    if checked:
        rep = p.join(w.select(key, "_win", "_dup"), key, "left")
    else:  # no winner can fail: the report needs its seq alone, not the patches again
        rep = p.withColumns({"_win": F.min(F.when(matches, F.col(seq_col))).over(Window.partitionBy(key)),
                             "_dup": F.lit(False)})
    won = F.coalesce(F.col(seq_col) == F.col("_win"), F.lit(False)) \
        & ~F.coalesce(F.col("_dup"), F.lit(False))
    report = rep.select(
        key, seq_col, expected_col,
        F.when(F.col("_stored").isNull(), "not_found").when(won, "updated")
        .when(F.coalesce(F.col(seq_col) == F.col("_win"), F.lit(False)), "duplicate")
        .when(current & F.col("_violation").isNotNull()
              & (F.col("_win").isNull() | (F.col(seq_col) < F.col("_win"))), F.col("_violation"))
        .otherwise("conflict").alias("outcome"),
        F.when(won, F.col("_stored") + 1).otherwise(F.col("_stored")).cast("int").alias("version"))
    applied = w.where(~F.col("_dup")).select(F.col(key).alias("_pk"), *new_cols)
    merged = base.join(applied, base[key] == applied["_pk"], "left")
    hit = F.col("_pk").isNotNull()
    out_cols = []
    for c in base.columns:
        if c in columns:
            kind = base.schema[c].dataType
            out_cols.append(F.when(hit, F.col(f"_new_{c}").cast(kind)).otherwise(F.col(c)).alias(c))
        elif c == "version":
            out_cols.append(F.when(hit, F.col(c) + 1).otherwise(F.col(c)).cast("int").alias(c))
        elif c == "updated_at" and stamp_updated_at:
            now = utc_as(as_of_literal(as_of), base.schema[c].dataType)
            out_cols.append(F.when(hit, now).otherwise(F.col(c)).alias(c))
        else:
            out_cols.append(F.col(c))
    return merged.select(*out_cols), report


def constraint_violations(table: str, columns, parents: dict[str, DataFrame] | None = None):
    """What :func:`optimistic_update` takes as ``violations``: the constraints on the written columns.

    First that applies: check_violation, numeric_overflow, constraint_violation (NULL in a NOT NULL
    column), fk_violation. Numerics are brought to their scale. Every written reference needs its
    parent table (ValueError otherwise).
    """
    parents = parents or {}
    fks = [fk for fk in FOREIGN_KEYS if fk.child == table and fk.column in columns]
    missing = sorted({fk.parent for fk in fks} - parents.keys())
    if missing:
        raise ValueError(f"{table} references {', '.join(missing)}: pass them in parents")

    def judge(p: DataFrame) -> DataFrame:
        cases = [(~_ok(r), "check_violation") for r in ddl_check_rules(table) if r.field in columns]
        numbers = {}
        for c, precision, scale in NUMERIC_COLUMNS.get(table, ()):
            if c in columns:
                numbers[f"_dec_{c}"], bad = coerce_numeric(F.col(c), precision, scale)
                cases.append((bad, "numeric_overflow"))
        cases += [(F.col(c).isNull(), "constraint_violation") for c in not_null_columns(table) if c in columns]
        for i, fk in enumerate(fks):
            keys = parents[fk.parent].select(F.col(fk.parent_column).alias(f"_p{i}")).distinct()
            p = p.join(keys, p[fk.column] == keys[f"_p{i}"], "left")
            cases.append((F.col(fk.column).isNotNull() & F.col(f"_p{i}").isNull(), "fk_violation"))
        violation = F.lit(None).cast("string")
        for bad, outcome in reversed(cases):
            violation = F.when(F.coalesce(bad, F.lit(False)), F.lit(outcome)).otherwise(violation)
        p = p.withColumns({**numbers, "_violation": violation})
        for name in numbers:
            p = p.withColumn(name.removeprefix("_dec_"), F.col(name))
        return p.drop(*numbers, *[f"_p{i}" for i in range(len(fks))])

    return judge


def table_update(base: DataFrame, patches: DataFrame, table: str, columns, as_of,
                 parents: dict[str, DataFrame] | None = None, **kw):
    """M1 with the table's timestamp rule, unique keys and constraints."""
    kw.setdefault("unique_keys", UNIQUE_KEYS.get(table, ()))
    kw.setdefault("violations", constraint_violations(table, columns, parents))
    return optimistic_update(base, patches, columns, as_of,
                             stamp_updated_at=table in STAMPS_UPDATED_AT, **kw)


def update_password(users: DataFrame, tokens: DataFrame, patches: DataFrame, as_of):
    """New password hashes (M1), then the users' password-reset tokens go (M4).

    Returns ``(new_users, new_tokens, report)``; tokens of users whose update failed stay.
    """
    new_users, report = table_update(users, patches, "users", UPDATABLE["users_password"], as_of)
    done = report.where(F.col("outcome") == "updated").select(
        F.col("id").alias("user_id"), F.lit(SCOPE_PASSWORD_RESET).alias("scope"))
    return new_users, delete_by_predicate(tokens, done, ["user_id", "scope"]), report


# --- M2 -----------------------------------------------------------------------------------------
def partial_patch(base: DataFrame, patches: DataFrame, patchable, rules, as_of,
                  stamp_updated_at: bool = False, key: str = "id",
                  expected_col: str = "expected_version", seq_col: str = "seq",
                  unique_keys=(), violations=None):
    """Partial update: an absent (NULL) member keeps the stored value; the whole merged row
    is re-validated; valid merges go through the version and constraint checks (M1).

    Returns ``(new_base, report)``; report outcomes add ``invalid`` (with the first
    message per field in ``errors``).
    """
    kept = [c for c in base.columns if c != key]
    b = base.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_b_{c}") for c in kept])
    present = [c for c in patchable if c in patches.columns]
    j = patches.join(b, patches[key] == b["_k"], "left")
    merged = j.select(
        key, seq_col, expected_col, F.col("_k").isNotNull().alias("_exists"),
        *[(F.coalesce(F.col(c), F.col(f"_b_{c}")) if c in present else F.col(f"_b_{c}")).alias(c)
          for c in kept])
    checked = validate_columns(merged, rules, prefix="_err_")
    msgs = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(f) for f in fields_of(rules)]),
                          F.array(*[F.col(f"_err_{f}") for f in fields_of(rules)])),
        lambda k, v: v.isNotNull())
    checked = checked.withColumn("errors", msgs)
    good = checked.where(F.col("valid") & F.col("_exists")).select(key, seq_col, expected_col,
                                                                   *patchable)
    new_base, upd = optimistic_update(base, good, list(patchable), as_of, stamp_updated_at,
                                      key, expected_col, seq_col, unique_keys, violations)
    rejected = checked.where(~(F.col("valid") & F.col("_exists"))).select(
        key, seq_col, expected_col,
        F.when(~F.col("_exists"), "not_found").otherwise("invalid").alias("outcome"),
        F.lit(None).cast("int").alias("version"),
        F.when(F.col("_exists"), F.col("errors")).alias("errors"))
    upd = upd.withColumn("errors", F.lit(None).cast("map<string,string>"))
    return new_base, upd.unionByName(rejected)


def table_patch(base: DataFrame, patches: DataFrame, table: str, as_of,
                parents: dict[str, DataFrame] | None = None, **kw):
    """M2 with the table's patchable columns, rules, timestamp rule, unique keys and constraints."""
    columns = PATCHABLE[table]
    kw.setdefault("unique_keys", UNIQUE_KEYS.get(table, ()))
    kw.setdefault("violations", constraint_violations(table, columns, parents))
    rules = [r for r in RULES[table] if r.field in base.columns]
    return partial_patch(base, patches, columns, rules, as_of,
                         stamp_updated_at=table in STAMPS_UPDATED_AT, **kw)


# --- M3 / M4 ------------------------------------------------------------------------------------
def delete_by_key(base: DataFrame, keys: DataFrame, key: str = "id"):
    """Delete the requested keys. Returns ``(new_base, report)``; deleted / not_found."""
    k = keys.select(F.col(key).alias("_del")).distinct()
    new_base = base.join(k, base[key] == k["_del"], "left_anti")
    present = base.select(F.col(key).alias("_have"))
    report = keys.join(present, keys[key] == present["_have"], "left").select(
        *keys.columns,
        F.when(F.col("_have").isNotNull(), "deleted").otherwise("not_found").alias("outcome"))
    return new_base, report


def delete_by_predicate(base: DataFrame, matches: DataFrame, on: list[str]):
    """Delete every row whose ``on`` columns equal a row of ``matches`` (no not-found)."""
    return base.join(matches.select(*on).distinct(), on, "left_anti")


# --- M5 -----------------------------------------------------------------------------------------
def _pk(table: str) -> str:
    return PRIMARY_KEYS[table][0]


def propagate_delete(tables: dict[str, DataFrame], root: str, keys: DataFrame,
                     fks=FOREIGN_KEYS, key_col: str = "id"):
    """Delete ``keys`` from ``root`` and apply every foreign key's delete action.

    CASCADE deletes referencing rows (transitively), SET NULL clears the reference,
    RESTRICT blocks the root key whose deletion (directly or through a cascade)
    would remove a still-referenced parent row. Blocking is decided over the whole
    closure before anything is deleted, per root key.

    Returns ``(new_tables, report)``; report rows: table_name, id, action
    (deleted / set_null / blocked / not_found), root_id. The deleted (id, root) pairs of each
    table are computed once, when called, and checkpointed in the shared folder: a child table is read
    once per reference to find them, and the report reads no table again but for SET NULL.
    """
    root_pk = _pk(root)
    requested = keys.select(F.col(key_col).alias("_root")).distinct()
    base_root = tables[root].select(F.col(root_pk).alias("_id"))
    looked_up = pin(requested.join(base_root, requested["_root"] == base_root["_id"], "left"))
    # 1. closure of cascading deletes, each row tagged with its root key; (id, root) pairs, kept once
    # per table, as every later step starts from them
    closure: dict[str, DataFrame] = {
        root: looked_up.where(F.col("_id").isNotNull()).select(F.col("_id").alias("id"), "_root")}
    live = [fk for fk in fks if _applies(fk, tables)]
    for child in _cascade_order(root, live):
        hits = [_referencing(tables[child], fk, closure[fk.parent]) for fk in live
                if fk.child == child and fk.on_delete == "cascade" and fk.parent in closure]
        closure[child] = pin(reduce(DataFrame.unionByName, hits).distinct())
    # 2. RESTRICT: root keys whose closure removes a parent row still referenced
    blocked_parts = [_referencing(tables[fk.child], fk, closure[fk.parent]).select("_root")
                     for fk in live if fk.on_delete == "restrict" and fk.parent in closure]
    blocked = pin(reduce(DataFrame.unionByName, blocked_parts).distinct()) if blocked_parts else None
    deleted = {t: df if blocked is None else pin(df.join(blocked, "_root", "left_anti"))
               for t, df in closure.items()}
    # 3. new snapshots: drop deleted rows, clear SET NULL references
    new_tables = dict(tables)
    for t, d in deleted.items():
        ids = d.select(F.col("id").alias("_gone")).distinct()
        new_tables[t] = tables[t].join(ids, tables[t][_pk(t)] == ids["_gone"], "left_anti")
    report_parts = [d.select(F.lit(t).alias("table_name"), "id", F.lit("deleted").alias("action"),
                             F.col("_root").alias("root_id")) for t, d in deleted.items()]
    for fk in live:
        if fk.on_delete != "set_null" or fk.parent not in deleted:
            continue
        gone = deleted[fk.parent].select(F.col("id").alias("_gone"), "_root")
        child = new_tables[fk.child]
        report_parts.append(
            child.join(gone, child[fk.column] == gone["_gone"], "inner").select(
                F.lit(fk.child).alias("table_name"), F.col(_pk(fk.child)).alias("id"),
                F.lit("set_null").alias("action"), F.col("_root").alias("root_id")))
        gone_ids = gone.select(F.col("_gone").alias("_g")).distinct()
        new_tables[fk.child] = child.join(gone_ids, child[fk.column] == gone_ids["_g"], "left") \
            .withColumn(fk.column, F.when(F.col("_g").isNull(), F.col(fk.column))) \
            .drop("_g").select(*tables[fk.child].columns)
    if blocked is not None:
        report_parts.append(blocked.select(F.lit(root).alias("table_name"), F.col("_root").alias("id"),
                                           F.lit("blocked").alias("action"),
                                           F.col("_root").alias("root_id")))
    report_parts.append(looked_up.where(F.col("_id").isNull()).select(
        F.lit(root).alias("table_name"), F.col("_root").alias("id"), F.lit("not_found").alias("action"),
        F.col("_root").alias("root_id")))
    report = reduce(DataFrame.unionByName, report_parts).distinct()
    return new_tables, report


def _cascade_order(root: str, fks) -> list[str]:
    """Tables that cascading deletes from ``root`` reach, every table after all its parents."""
    cascades = [fk for fk in fks if fk.on_delete == "cascade"]
    reached, frontier = {root}, [root]
    while frontier:
        parent = frontier.pop()
        new = {fk.child for fk in cascades if fk.parent == parent} - reached
        reached |= new
        frontier += new
    order: list[str] = []
    while len(order) < len(reached) - 1:
        order += [t for t in sorted(reached - {root, *order})
                  if {fk.parent for fk in cascades if fk.child == t} & reached <= {root, *order}]
    return order


def _applies(fk: ForeignKey, tables: dict[str, DataFrame]) -> bool:
    """The child table is given and carries the reference column."""
    return fk.child in tables and fk.column in tables[fk.child].columns


def _referencing(child: DataFrame, fk: ForeignKey, parents: DataFrame) -> DataFrame:
    """Child rows whose ``fk.column`` points at a row of ``parents`` (id, _root)."""
    p = parents.select(F.col("id").alias("_pid"), "_root")
    return child.join(p, child[fk.column] == p["_pid"], "inner") \
        .select(F.col(_pk(fk.child)).alias("id"), "_root")


# --- A3 -----------------------------------------------------------------------------------------
def mutation_summary(report: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """Rows per outcome of a mutation report (partial + final count)."""
    return report.groupBy(outcome_col).agg(F.count(F.lit(1)).alias("row_count"))
