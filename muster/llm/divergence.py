"""How far sources of one language differ in the words they use: a frequent-pattern tree of term rows.

**Counts.** Every task counts the terms of its documents by (lang, source) and hands on one row per
distinct (lang, source, term) it met, so neither a hot source nor a frequent word is sent row by row.
A language keeps the terms that occur in at least ``least`` of its documents; each group (lang, source)
gives a kept term the scaled frequency ``p = 1 + floor(10**9 * (n + 5) / (N + 5 V))``.

**Pair sums.** For two sources s and r the sum of ``|p_s - p_r|`` over all V terms is taken apart. With
``z`` the value of a term that does not occur, it is

* ``V * |z_s - z_r|``, as if no term occurred,
* plus, for each term that occurs in s, ``|p_s - z_r| - |z_s - z_r|``, and the same for r,
* plus a correction ``|p_s - p_r| - |p_s - z_r| - |z_s - p_r| + |z_s - z_r|`` for terms that occur in both.

**The tree.** A term's row lists its nonzero counts, the sources of its language in one order (those of
most terms first). Equal rows are counted once with their multiplicity and sorted, which lays the tree
out depth first: a task walks its run of rows with the current path as its only state. A node left
behind adds its corrections with all its ancestors, times the terms below it, and gives its
multiplicity to its parent. So terms that share a path share the work, and two tasks that
hold parts of one subtree add up to the same sum.

Defined results: null text, lang and source are ''; a text without terms still makes its group; a
language without kept terms gives pairs of value 0 and no term rows; a repeated row is a document of its
own; an empty table gives an empty result; further columns are ignored, whatever their names. All
sums are integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muster.llm.common import stored

#: a term is kept in a language from so many of its documents on; term rows are reported to this rank
LEAST_DOCUMENTS, TERM_RANKS = 30, 50
#: fixed values of the scaled frequency
SCALE, SMOOTH = 1_000_000_000, 5
#: distinct terms a task holds before it hands them on, and bytes of a text that are split at once
HELD_TERMS, PIECE = 300_000, 4 << 20
#: nodes from the root that decide where a row of the tree goes
SUBTREE = 3
#: pair sums a task holds before it hands them on
HELD_PAIRS = 1_000_000

#: letters and all bytes of characters beyond ASCII stay, A-Z in lower case; the rest separates
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

Batches = Iterator[pa.RecordBatch]


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``raw`` in parts of about ``size`` bytes, cut at spaces."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def _count_terms(batches: Batches) -> Batches:
    """(lang, source, term, n, docs) of each run of documents; a group's own row has no term."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flush() -> pa.RecordBatch:
        found = [(lang, source, term, n, docs[term])
                 for (lang, source), (seen, docs) in counts.items() for term, n in seen.items()]
        found += [(lang, source, None, 0, 0) for lang, source in counts]
        counts.clear()
        lang, source, term, n, docs = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()),
             pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for raw, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(),
                                     strict=True):
            seen, docs = counts[lang, source]
            own: set[bytes] = set()
            for part in pieces(raw.translate(_LETTERS)):
                words = part.split()
                seen.update(words)
                own.update(words)
            docs.update(own)
        if sum(len(seen) for seen, _ in counts.values()) > HELD_TERMS:
            yield flush()
    if counts:
        yield flush()


def scaled(n: Column, total: Column, terms: Column) -> Column:
    """p of a term with n of a group's ``total`` occurrences; null without kept terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + F.lit(SMOOTH)).cast("decimal(19,0)")
    below = (total + F.lit(SMOOTH) * terms).cast("decimal(19,0)")
    return F.when(below > 0, F.lit(1) + F.call_function("div", above, below))


def _walk(batches: Batches) -> Batches:
    """Corrections (lang, a, b) of the tree over sorted rows (lang, path, m); a comes after b in a path."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    lang, depth = None, 0
    path = np.zeros((4, 16), np.int64)  # place, n, p, z of every node of the current path
    below = np.zeros(16, np.int64)

    def leave(upto: int) -> None:
        nonlocal depth
        while depth > upto:
            depth -= 1
            place, _, p, z = path[:, depth]
            if depth:
                places, _, ps, zs = path[:, :depth]
                own = sums.get((lang, int(place)))
                if own is None:
                    own = sums[lang, int(place)] = np.zeros(int(place), np.int64)
                own[places] += below[depth] * (np.abs(p - ps) - np.abs(p - zs) - np.abs(z - ps) + np.abs(z - zs))
                below[depth - 1] += below[depth]

    def flush() -> pa.RecordBatch:
        keys = [(key, np.flatnonzero(own), own) for key, own in sums.items()]
        langs = [key[0] for key, at, _ in keys for _ in at]
        a = np.concatenate([np.full(len(at), key[1], np.int64) for key, at, _ in keys])
        b = np.concatenate([at for _, at, _ in keys])
        value = np.concatenate([own[at] for _, at, own in keys])
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(a), pa.array(b), pa.array(value)],
                                          names=["lang", "a", "b", "value"])

    for batch in batches:
        lists = batch.column("path")
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        nodes = lists.flatten()
        cells = np.stack([np.asarray(nodes.field(name)).astype(np.int64) for name in ("place", "n", "p", "z")])
        for i, (row_lang, m) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("m").to_pylist(), strict=True)):
            new = cells[:, ends[i]:ends[i + 1]]
            if row_lang != lang:
                leave(0)
                lang, shared = row_lang, 0
            else:
                k = min(depth, new.shape[1])
                differ = np.flatnonzero((path[:2, :k] != new[:2, :k]).any(axis=0))
                shared = int(differ[0]) if len(differ) else k
                leave(shared)
            if new.shape[1] > path.shape[1]:
                grow = new.shape[1] - path.shape[1]
                path = np.pad(path, ((0, 0), (0, grow)))
                below = np.pad(below, (0, grow))
            path[:, shared:new.shape[1]] = new[:, shared:]
            below[shared:new.shape[1]] = 0
            depth = new.shape[1]
            below[depth - 1] += m
        if sum(map(len, sums.values())) > HELD_PAIRS:
            yield flush()
    leave(0)
    if sums:
        yield flush()


class Divergence:
    """The tables of the audit: ``cells`` (group, kept term, count), ``groups`` and ``langs``."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS, text_col: str = "text",
                 lang_col: str = "lang", source_col: str = "source"):
        def text(name: str, alias: str) -> Column:
            return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(alias)

        rows = docs.select(text(text_col, "text"), text(lang_col, "lang"), text(source_col, "source"))
        counted = stored(rows.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
                         .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
                         "divergence-counts")
        kept = (counted.where("term is not null").groupBy("lang", "term")
                .agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= least)
                .select("lang", "term", "in_lang"))
        self.cells = stored(counted.where("term is not null").join(kept, ["lang", "term"])
                            .select("lang", "source", "term", "n", "in_lang"), "divergence-cells")
        # the terms of a language with the language's count: once, in the group that holds it first
        terms = self.cells.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang"))
        self.langs = stored(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total")),
                            "divergence-langs")
        sizes = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("present"))
        order = W.partitionBy("lang").orderBy(F.desc("present"), "source")
        self.groups = stored(
            counted.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left")
            .join(self.langs, "lang", "left").na.fill(0, ["total", "present", "terms", "lang_total"])
            .withColumn("place", F.row_number().over(order) - 1)
            .withColumn("z", scaled(F.lit(0), F.col("total"), F.col("terms")))
            .select("lang", "source", "total", "terms", "lang_total", "place", "z"), "divergence-groups")

    def _placed(self) -> DataFrame:
        return self.cells.join(self.groups, ["lang", "source"]).withColumn(
            "p", scaled(F.col("n"), F.col("total"), F.col("terms")))

    def terms(self, ranks: int = TERM_RANKS) -> DataFrame:
        """lang, source, item, value, rank: terms more frequent in the group than in its language."""
        q = scaled(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
        over = self._placed().withColumn("value", F.col("p") - q).where("value > 0")
        rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
        return (over.withColumn("rank", rank).where(F.col("rank") <= ranks)
                .select("lang", "source", F.col("term").alias("item"), "value", "rank"))

    def rows(self) -> DataFrame:
        """(lang, path, m): the distinct term rows of the tree with their multiplicities, in its order."""
        path = F.sort_array(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "n", "p", "z")))
        distinct = (self._placed().groupBy("lang", "term").agg(path.alias("path"))
                    .groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m")))
        # by the first nodes: subtrees stay whole, and no sample of paths goes to the driver as for ranges
        return distinct.repartition("lang", F.slice("path", 1, SUBTREE)).sortWithinPartitions("lang", "path")

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the lang), value, rank."""
        both = (self.rows().mapInArrow(_walk, "lang string, a long, b long, value long")
                .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
        there = self.groups.select("lang", F.col("place").alias("b"), F.col("z").alias("zb"))
        single = (self._placed().groupBy("lang", F.col("place").alias("a"), F.col("z").alias("za"), "p")
                  .agg(F.count(F.lit(1)).alias("m")).join(there, "lang").where("a <> b")
                  .select("lang", F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"),
                          (F.col("m") * (F.abs(F.col("p") - F.col("zb")) - F.abs(F.col("za") - F.col("zb")))).alias("value")))
        empty = (self.groups.select("lang", F.col("place").alias("a"), F.col("z").alias("za"), "terms").join(there, "lang")
                 .where("a > b").select("lang", F.col("a").cast("long"), F.col("b").cast("long"),
                                        F.coalesce(F.col("terms") * F.abs(F.col("za") - F.col("zb")), F.lit(0)).alias("value")))
        sums = both.unionByName(single).unionByName(empty).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        ends = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                                                              F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
        name = self.groups.select("lang", F.col("place").cast("long").alias("place"), "source")
        named = (ends.select("lang", "value", "e.x", "e.y")
                 .join(name.select("lang", F.col("place").alias("x"), "source"), ["lang", "x"])
                 .join(name.select("lang", F.col("place").alias("y"), F.col("source").alias("item")), ["lang", "y"]))
        rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return named.select("lang", "source", "item", "value", rank.alias("rank"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of every group."""
    found = Divergence(docs, least)
    cols = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    return (found.pairs().withColumn("part", F.lit("pair")).select(*cols)
            .unionByName(found.terms(ranks).withColumn("part", F.lit("term")).select(*cols)))
