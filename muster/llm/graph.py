"""Connected components of links, by alternating large-star and small-star steps over contracted links.

A task first replaces the links it reads by stars that join the same nodes (union-find over at most
``CHUNK`` links at a time), which takes most of the length out of chains. Every step after that is a
grouped minimum with partial aggregation and one join on the node, so a hub with a third of all links
stays one row per task in the aggregation and is split by the skew join. Links are kept as a table in
the shared folder between rounds; the rounds end when every node points at one node that points nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import stored, tidy

#: links that a task contracts at once
CHUNK = 500_000


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Links that join the same nodes as u-v: from every node to the least it is joined with."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[:len(u)], place[len(u):]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    tail = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[tail]), pa.array(nodes[root[tail]])], ["u", "v"])


@tidy
def _contract(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= chunk:
            yield _stars(*_columns(held))
            held = []
    if held:
        yield _stars(*_columns(held))


def _columns(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in held]) for name in ("u", "v"))


def _contracted(edges: DataFrame) -> DataFrame:
    chunk = CHUNK
    return stored(edges.mapInArrow(lambda b: _contract(b, chunk), "u long, v long"), "links")


def _star(pairs: DataFrame) -> DataFrame:
    """For (u, v) rows: connect every v to the least of u and all its v's."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and that one has none."""
    low = edges.select(F.col("u").alias("node"), "v").unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    per = low.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"),
                                  F.max(F.col("v").isNull()).alias("pointed_at"))
    return per.where((F.col("low") < F.col("high")) | (F.col("pointed_at") & F.col("low").isNotNull())).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node."""
    edges = _contracted(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
                        .where("u > v"))
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large)
        edges = _contracted(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct())
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return ends.distinct()
