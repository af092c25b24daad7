"""Totals of a request log against counting per request."""

import itertools

import pytest

from muster.operators.totals import totals_for_requests

ROWS = [("Ann", "r1", "x"), ("ann", "r2", None), ("Bob", None, "x"), (None, "r1", "y"), ("", "r1", "x"), ("Ann", "r1", "X")]
FILTERS = {"name": "ci", "region": "id", "kind": "ci"}


def expected(args):
    given = [(a, k) for a, k in zip(args, FILTERS.values(), strict=True)]

    def same(a, k, v):
        return not a or (v is not None and (v.lower() == a.lower() if k == "ci" else v == a))

    return sum(all(same(a, k, v) for (a, k), v in zip(given, row, strict=True)) for row in ROWS)


def test_every_combination(spark):
    combos = list(itertools.product(["ANN", "bob", "none", "", None], ["r1", "R1", "", None], ["X", "y", None]))
    requests = [(i, *c) for i, c in enumerate(combos)] + [(0, *combos[0])]
    rows = spark.createDataFrame(ROWS, "name string, region string, kind string")
    log = spark.createDataFrame(requests, "request_id int, name string, region string, kind string")
    got = sorted((r.request_id, r.total_records) for r in totals_for_requests(rows, log, FILTERS).collect())
    assert got == sorted((i, expected(c)) for i, *c in requests)


def test_one_scan_of_the_table_and_empty_sides(spark):
    rows = spark.createDataFrame(ROWS, "name string, region string, kind string")
    log = spark.createDataFrame([(1, "ann", None, None)], "request_id int, name string, region string, kind string")
    out = totals_for_requests(rows, log, FILTERS)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2
    assert totals_for_requests(rows, log.limit(0), FILTERS).collect() == []
    assert [r.total_records for r in totals_for_requests(rows.limit(0), log, FILTERS).collect()] == [0]
    with pytest.raises(ValueError, match="kind"):
        totals_for_requests(rows, log, {"name": "like"})
