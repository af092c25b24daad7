"""Full-text search for many queries at once: an inverted index, written once and searched by joins.

The index is two tables: ``terms`` (term, document frequency, parts) and ``postings`` (term, part, id). A term
of many rows is dealt over parts of about ``PART_ROWS`` ids by the hash of the id, so no task ever holds a
hot term, and a reader who knows the id knows the part.

A text is cut once. A task inverts a batch of texts at a time: one row for a term and the ids of the batch that hold
it, kept as ``blocks`` in the index's folder for the two tables that are made of them. Such lists are shuffled, sorted,
stored (term, part, ids) and joined in place of single postings, of which there are many times more; a reader of
``postings`` gets single ones.

A search answers a table of queries. The postings of all asked terms are gathered by id, once. Every query is driven by
its rarest term: the ids that hold it are its candidates, and the other terms are verified among the id's own, in the same
task. So the shuffle grows with the postings and not with the candidates, which grow with queries times
rows; a candidate costs a lookup for each other term in a table of the terms that some ids hold, many candidates at a
time. The base table is not read. A query with a term that no row has, or without terms, finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.functions.text import compound_tokens, text_tokens
from muster.session import pin

PART_ROWS = 100_000
#: queries that are sent whole to every task; more are searched in groups, each of which reads the postings
BROADCAST_QUERIES = 200_000
#: cells of a task's table of ids and asked terms, and candidates that are verified at a time
CELLS = 1 << 23
CANDIDATES = 1 << 19


def simple_terms(col: Column | str) -> Column:
    """Tokens and hyphenated compounds, as :func:`muster.functions.text.matches_all_terms` compares them."""
    return F.concat(text_tokens(col), compound_tokens(col))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The keys in order, once each, by sorting: ``np.unique`` hashes, which takes many times as long."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) != 0]


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, terms) to (term, ids, number of ids), for each batch; a term counts once for a row."""
    for batch in batches:
        rows, lists = batch.num_rows, batch.column("terms")
        terms = lists.flatten()
        row = np.repeat(np.arange(rows), lists.value_lengths().to_numpy())
        if terms.null_count:
            row, terms = row[terms.is_valid().to_numpy(zero_copy_only=False)], terms.drop_null()
        coded = terms.dictionary_encode()
        code, row = np.divmod(_distinct(coded.indices.to_numpy().astype(np.int64) * rows + row), max(rows, 1))
        counts = np.bincount(code, minlength=len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary, _lists(counts, batch.column("id").take(pa.array(row))), pa.array(counts, pa.int64())],
                                         names=["term", "ids", "n"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, ids, a part for each id) to a row for each term and part."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("parts")
        part = lists.flatten().to_numpy().astype(np.int64)
        most = part.max() + 1
        key = np.repeat(np.arange(batch.num_rows) * most, lists.value_lengths().to_numpy()) + part
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.diff(key[order], prepend=-1))
        row, part = np.divmod(key[order[head]], most)
        ids = batch.column("ids").flatten().take(pa.array(order))
        yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(row)), pa.array(part, pa.int32()),
                                          _lists(np.diff(head, append=len(key)), ids)], names=["term", "part", "ids"])


@dataclass
class _Asked:
    """Queries in the order of their rarest term, terms by number: query i has ``codes[first[i]:end[i]]``, its rarest
    term first; ``begin[c]`` and ``drives[c]`` are the first query driven by term c and their number."""

    queries: pa.Array
    codes: np.ndarray
    first: np.ndarray
    end: np.ndarray
    begin: np.ndarray
    drives: np.ndarray

    @classmethod
    def of(cls, plan: pa.Table) -> tuple[_Asked, pa.Array]:
        """Of (query, terms), and the terms in the order of their numbers."""
        lists = plan.column("terms").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        end = np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)
        first = np.concatenate([[0], end[:-1]]).astype(np.int64)[:len(end)]
        order = np.argsort(codes[first], kind="stable")
        drives = np.bincount(codes[first], minlength=len(coded.dictionary))
        return cls(plan.column("query").combine_chunks().take(pa.array(order)), codes, first[order], end[order],
                   np.cumsum(drives) - drives, drives), coded.dictionary

    def found(self, doc: np.ndarray, code: np.ndarray, docs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a document and a query it matches, in the documents' order, for distinct pairs of documents and
        their terms in that order."""
        width = len(self.drives)
        held = np.zeros(docs * width, bool)
        held[doc * width + code] = True
        drives = self.drives[code]
        doc, code, drives = doc[drives > 0], code[drives > 0], drives[drives > 0]
        after = np.cumsum(drives)
        cut = 0
        while cut < len(doc):
            past = after[cut - 1] if cut else 0
            until = max(cut + 1, np.searchsorted(after, past + CANDIDATES, side="right"))
            some = slice(cut, until)
            d = np.repeat(doc[some] * width, drives[some])
            q = np.arange(len(d)) + np.repeat(self.begin[code[some]] - (after[some] - drives[some] - past), drives[some])
            at = self.first[q] + 1
            while len(d):
                over = at >= self.end[q]
                if over.any():
                    yield d[over] // width, q[over]
                    d, q, at = d[~over], q[~over], at[~over]
                keep = held[d + self.codes[at]]
                d, q, at = d[keep], q[keep], at[keep] + 1
            cut = until


def _match(batches: Iterator[pa.RecordBatch], asked: _Asked) -> Iterator[pa.RecordBatch]:
    """(id, numbers of the terms it holds) to (id, queries it matches), in rows of some queries each."""
    width = len(asked.drives)
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        ids, lists = batch.column("id"), batch.column("codes")
        key = np.repeat(np.arange(len(ids)) * width, lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()
        doc, code = np.divmod(_distinct(key), max(1, width))  # an id's term counts once
        for low in range(0, len(ids), step):
            some = slice(*np.searchsorted(doc, [low, low + step]))
            docs = min(step, len(ids) - low)
            for d, q in asked.found(doc[some] - low, code[some], docs):
                counts = np.bincount(d, minlength=docs)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + low)), _lists(counts[at], asked.queries.take(pa.array(q)))],
                                                 names=["id", "queries"])


@dataclass
class Postings:
    """An inverted index; ``tokens`` must be the expression it was built with."""

    terms: DataFrame
    lists: DataFrame
    tokens: Callable[[Column | str], Column] = simple_terms

    @property
    def postings(self) -> DataFrame:
        return self.lists.select("term", "part", F.explode("ids").alias("id"))

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text_col: str, path: str, tokens=simple_terms,
              part_rows: int = PART_ROWS) -> Postings:
        """Index ``text_col`` of ``df`` in the new folder ``path``."""
        spark = df.sparkSession
        # empty and not NULL: Arrow's writer takes time by the square of a run of NULL arrays
        none = F.array().cast("array<string>")
        found = df.select(F.col(id_col).alias("id"), F.coalesce(tokens(F.col(text_col)), none).alias("terms"))
        id_type = found.schema["id"].dataType
        inverted = T.StructType().add("term", T.StringType()).add("ids", T.ArrayType(id_type)).add("n", T.LongType())
        found.mapInArrow(_invert, inverted).write.parquet(f"{path}/blocks")
        blocks = spark.read.parquet(f"{path}/blocks")
        blocks.groupBy("term").agg(F.sum("n").alias("df")) \
            .withColumn("parts", F.ceil(F.col("df") / part_rows).cast("int")) \
            .repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        terms = spark.read.parquet(f"{path}/terms")
        hot = F.broadcast(terms.where("parts > 1").select("term", F.col("parts").alias("of")))  # few: each has over part_rows rows
        parts = F.transform("ids", lambda i: F.pmod(F.xxhash64(i), F.col("of")).cast("int"))
        dealt = T.StructType().add("term", T.StringType()).add("part", T.IntegerType()).add("ids", T.ArrayType(id_type))
        blocks.join(hot, "term").select("term", "ids", parts.alias("parts")).mapInArrow(_deal, dealt) \
            .unionByName(blocks.join(hot, "term", "left_anti").select("term", F.lit(0).alias("part"), "ids")) \
            .repartition("term", "part").sortWithinPartitions("term", "part").write.parquet(f"{path}/postings")
        return cls.open(spark, path, tokens)

    @classmethod
    def open(cls, spark: SparkSession, path: str, tokens=simple_terms) -> Postings:
        return cls(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/postings"), tokens)

    def search(self, queries: DataFrame, query_col: str, text_col: str) -> DataFrame:
        """(query, id) of all rows that hold every term of a query, once each."""
        return self.matches(queries, query_col, text_col).select(F.explode("queries").alias("query"), "id")

    def matches(self, queries: DataFrame, query_col: str, text_col: str) -> DataFrame:
        """The pairs of :meth:`search` as (id, queries); an id can have several rows, each with other queries."""
        asked = queries.select(F.col(query_col).alias("query"),
                               F.explode(F.array_distinct(self.tokens(F.col(text_col)))).alias("term"))
        known = asked.join(self.terms, "term", "left")
        each = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")
        plan = pin(known.groupBy("query").agg(F.array_sort(F.collect_set(each)).alias("terms"))
                   .where(F.col("terms")[0]["df"] > 0).select("query", F.col("terms.term").alias("terms")))
        groups = max(1, -(-plan.count() // max(1, BROADCAST_QUERIES)))
        group = F.pmod(F.xxhash64("query"), F.lit(groups))
        return reduce(DataFrame.unionAll, [self._matches(plan.where(group == i) if groups > 1 else plan) for i in range(groups)])

    def _matches(self, plan: DataFrame) -> DataFrame:
        """(id, queries) for (query, terms), the rarest first; the queries are sent to every task."""
        spark = plan.sparkSession
        asked, terms = _Asked.of(plan.toArrow())
        wanted = spark.createDataFrame(pa.table({"term": terms, "code": pa.array(np.arange(len(terms)), pa.int32())}))
        shared = spark.sparkContext.broadcast(asked)
        matched = T.StructType().add("id", self.lists.schema["ids"].dataType.elementType) \
            .add("queries", T.ArrayType(plan.schema["query"].dataType))
        # one row for an id: Arrow's writer takes several times as long for a row as for an element of a list
        held = self.lists.join(F.broadcast(wanted), "term").select(F.explode("ids").alias("id"), "code") \
            .repartition("id").groupBy("id").agg(F.collect_list("code").alias("codes"))
        return held.mapInArrow(lambda b: _match(b, shared.value), matched)
