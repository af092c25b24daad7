"""File tables that rewrite touched files alone, and stored page directories."""

import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from muster.operators import listing as L
from muster.operators.directory import build_directory, directory_total, read_page
from muster.operators.mutate import table_update
from muster.plans.specs import LIST_SPECS, PageArgs
from muster.plans.standins import AS_OF, StandIns
from muster.schemas import UPDATABLE
from muster.sources import file_table as T
from muster_helpers import SMOKE_DIR


def state(files):
    """Name -> (bytes, time of the last write)."""
    out = {}
    for f in files:
        p = unquote(f).split(":", 1)[-1]
        p = "/" + p.lstrip("/")
        with open(p, "rb") as h:
            out[f] = (h.read(), os.stat(p).st_mtime_ns)
    return out


@pytest.fixture(scope="module")
def officers(spark):
    return StandIns.of(spark, SMOKE_DIR).officers


def rowset(df, cols=None):
    return sorted(map(repr, df.select(*sorted(cols or df.columns)).collect()))


def test_untouched_files_keep_name_and_bytes(spark, officers, tmp_path):
    base = T.store_table(officers, str(tmp_path / "a folder"), ["id"], files=8)
    assert len(base.files) == 8
    ids = officers.orderBy("id").limit(10).select("id")
    before = state(base.files)
    new = T.delete_rows(spark, base, ids, ["id"], str(tmp_path / "v1"))
    assert len(new.rewritten) == 1 and set(base.files) - set(new.rewritten) <= set(new.files)
    kept = [f for f in base.files if f not in new.rewritten]
    after = state(base.files)
    assert after == before and len(kept) == 7
    assert rowset(new.read(spark)) == rowset(officers.join(ids, "id", "left_anti"))
    # the version before stays readable
    assert base.read(spark).count() == officers.count()


def test_nothing_touched_writes_nothing(spark, officers, tmp_path):
    base = T.store_table(officers, str(tmp_path / "v0"), ["id"], files=3)
    none = spark.createDataFrame([("nobody",), (None,)], "id string")
    new = T.delete_rows(spark, base, none, ["id"], str(tmp_path / "v1"))
    assert new.files == base.files and not os.path.exists(tmp_path / "v1")
    empty = T.FileTable(base.schema, ())
    assert T.touched_files(spark, empty, none, ["id"]) == () and empty.read(spark).count() == 0


def test_deleting_every_row_leaves_an_empty_table(spark, officers, tmp_path):
    base = T.store_table(officers, str(tmp_path / "v0"), ["id"], files=3)
    new = T.delete_rows(spark, base, officers, ["id"], str(tmp_path / "v1"))
    assert new.read(spark).count() == 0 and set(new.rewritten) == set(base.files)
    T.write_list(spark, new, str(tmp_path / "list"))
    assert T.read_list(spark, str(tmp_path / "list"), new.schema).read(spark).columns == officers.columns


def test_update_equals_the_whole_table_update(spark, tmp_path):
    users = StandIns.of(spark, SMOKE_DIR).users
    base = T.store_table(users, str(tmp_path / "v0"), ["id"], files=6)
    rows = users.orderBy("id").collect()
    far = rows[-1].email  # held by a row of another file than the patched ones
    patches = spark.createDataFrame(
        [(rows[0].id, rows[0].version, 1, "a@b.org", "admin", True), (rows[1].id, rows[1].version, 2, far, "admin", True),
         (rows[2].id, 99, 3, "c@b.org", "admin", True), ("nobody", 1, 4, "d@b.org", "admin", True),
         (rows[3].id, rows[3].version, 5, "a@b.org", "viewer", True)],
        "id string, expected_version int, seq int, email string, role string, activated boolean")
    new, report = T.update_rows(spark, base, patches, "users", UPDATABLE["users"], AS_OF, str(tmp_path / "v1"))
    want, wanted = table_update(users, patches, "users", UPDATABLE["users"], AS_OF)
    assert rowset(new.read(spark)) == rowset(want)
    assert rowset(report) == rowset(wanted)
    assert {r.seq: r.outcome for r in report.collect()} == {1: "updated", 2: "duplicate", 3: "conflict", 4: "not_found", 5: "duplicate"}
    assert len(new.rewritten) == 2  # the file of the patched rows and the one of the address's holder


def test_clear_reference(spark, officers, tmp_path):
    base = T.store_table(officers, str(tmp_path / "v0"), ["posting_id"], files=4)
    keys = spark.createDataFrame([("P1",), ("P1",), (None,)], "posting_id string")
    new = T.clear_reference(spark, base, keys, "posting_id", str(tmp_path / "v1"))
    held = officers.where("posting_id = 'P1'").count()
    assert held and new.read(spark).count() == officers.count()
    assert new.read(spark).where("posting_id is null").count() == held + officers.where("posting_id is null").count()
    assert 0 < len(new.rewritten) < len(base.files)


# --- page directory ---------------------------------------------------------------------------------
@pytest.mark.parametrize("sort,filters", [("-last_name", {}), ("id", {"rank_code": "nation_7"}), ("rank_code", {"last_name": "none such"})])
def test_every_page_equals_the_listing(spark, officers, tmp_path, sort, filters):
    spec = LIST_SPECS["officers"]
    path = str(tmp_path / "dir with space")
    build_directory(officers, spec, path, sort, filters)
    total = L.apply_filters(officers, spec, filters).count()
    assert directory_total(spark, path) == total
    size = 40
    for page in range(1, -(-total // size) + 2):
        got = read_page(spark, path, spec, page, size)
        want = L.list_page(officers, spec, PageArgs(page, size, sort, filters))
        assert got.columns == want.columns
        assert got.collect() == want.collect(), page


def test_a_page_sorts_and_reads_no_more_than_its_files(spark, officers, tmp_path):
    spec, path = LIST_SPECS["officers"], str(tmp_path / "d")
    build_directory(officers.repartition(4), spec, path)
    files = spark.read.parquet(f"{path}/files").collect()
    got = read_page(spark, path, spec, 2, 10)
    assert len(got.inputFiles()) == 1 <= len(files)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Window" not in plan
    # the one sort is that of the page's rows, by their position
    assert plan.count("Sort [") == 1 and "Sort [_position" in plan
    with pytest.raises(ValueError):
        read_page(spark, path, spec, 0, 10)


def test_pages_of_a_listing_beyond_the_bound_of_requests(spark, tmp_path):
    orders = spark.read.parquet(f"{SMOKE_DIR}/orders.parquet")
    copies = -(-200_101 // orders.count())
    step = orders.agg({"o_orderkey": "max"}).first()[0] + 1
    orders.crossJoin(spark.range(copies)).withColumn("o_orderkey", F.col("o_orderkey") + F.col("id") * step).drop("id") \
        .write.parquet(str(tmp_path / "orders.parquet"))
    got = queries()["page_from_directory"](spark, str(tmp_path)).select("page", "total_records").collect()
    total = orders.count() * copies
    last = -(-total // 20)
    assert last > 10_000 and {r.page for r in got} == {1, (last + 1) // 2, last}
    assert {r.total_records for r in got} == {total} and len(got) == 40 + (total - 1) % 20 + 1
    with pytest.raises(ValueError):  # a request is held to the bound
        read_page(spark, "unread", LIST_SPECS["sessions"], 10_001, 20)
