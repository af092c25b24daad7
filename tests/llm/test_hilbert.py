"""Hilbert sharding: the curve itself, the law of the shards, and what pruning gains."""

import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from muster.llm import hilbert, queries
from muster.llm.common import scratch


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_and_moves_one_step(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, [f"x{i}" for i in range(dims)])
    path = df.select("*", hilbert.hilbert_index([F.col(c) for c in df.columns], bits).alias("h")).collect()
    at = {r.h: tuple(r)[:-1] for r in path}
    assert sorted(at) == list(range(len(cells)))
    for h in range(len(cells) - 1):
        assert sum(abs(a - b) for a, b in zip(at[h], at[h + 1], strict=True)) == 1


def check_law(rows, docs, shards):
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr) == sorted(
        ((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs), key=repr)
    by = Counter(r.shard for r in rows)
    if len(docs) >= shards:
        assert len(by) == shards and set(by) == set(range(shards))
    assert not by or max(by.values()) - min(by.get(s, 0) for s in range(shards)) <= 1
    for shard in by:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(by[shard]))
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)


def test_query_on_the_whole_table(spark, documents):
    rows = queries.op3_hilbert_shards(spark, "/root/testdata/sf0.001").collect()
    check_law(rows, [(r.doc_id, r.text) for r in documents.collect()], 40)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_hot_cell_is_split_into_buckets(make_docs, monkeypatch):
    monkeypatch.setattr(hilbert, "BUCKET_ROWS", 7)
    docs = [(i, f"text {i % 5}", "en", "hot" if i % 3 else f"s{i % 4}", i % 2) for i in range(300)]
    check_law(hilbert.place(make_docs(docs), 11).collect(), [d[:2] for d in docs], 11)


def test_nulls_repeats_empty_table_and_few_rows(make_docs):
    docs = [(1, "a"), (1, "a"), (1, "a"), (None, None), (None, ""), (2, None, "en", "s", None), (3, "ü" * 9000)]
    for shards in (1, 3, 7, 50):
        check_law(hilbert.place(make_docs(docs), shards).collect(), [d[:2] for d in docs], shards)
    assert hilbert.place(make_docs([]), 4).collect() == []
    with pytest.raises(ValueError):
        hilbert.place(make_docs(docs), 0)


def test_shards_on_disk_keep_all_columns_and_prune(spark, documents):
    folder = scratch(spark, "shards")
    hilbert.write_shards(documents.withColumn("curve", F.lit("own")), folder, 8)
    back = spark.read.parquet(folder)
    cols = [*documents.columns, "curve"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(
        map(tuple, documents.withColumn("curve", F.lit("own")).select(*cols).collect()))
    assert {r["rows"] for r in hilbert.shard_ranges(back).collect()} == {25}
    ranges = hilbert.shard_ranges(back).collect()
    touched = sum(r.min_lang <= "de" <= r.max_lang for r in ranges) + sum(
        r.min_n_chars <= 300 <= r.max_n_chars for r in ranges)
    assert touched < 2 * len(ranges) * 0.75


def test_the_plan_has_no_python(documents):
    plan = hilbert.place(documents, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
