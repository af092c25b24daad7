"""Connected components against union-find: chains, hubs, repeated and empty links, many small chunks."""

import random

import pytest

from muster.llm import graph


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {x: find(x) for x in parent}


def found(spark, links, parts=7):
    df = spark.createDataFrame(links, "a long, b long").repartition(parts)
    rows = graph.components(df).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("chunk", [500_000, 40])
def test_components_of_chains_hubs_and_random_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(10_000, 10_000 + i) for i in range(1, 400)]
    links += [(20_000 + rnd.randrange(900), 20_000 + rnd.randrange(900)) for _ in range(500)]
    links += [(-1, 2**62), (2**62, 2**63 - 1), (2**63 - 1, -1)] * 3
    rnd.shuffle(links)
    assert found(spark, links) == brute([x for x in links if x[0] != x[1]])


def test_no_links_and_loops(spark):
    assert found(spark, []) == {}
    assert found(spark, [(3, 3), (None, 3), (None, None)]) == {}
    assert found(spark, [(2, 1), (1, 2), (2, 1)], 3) == {1: 1, 2: 1}
