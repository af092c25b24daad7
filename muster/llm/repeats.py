"""Repeated passages of texts: fixed-block anchors, probed by every rolling window.

A window is ``width`` consecutive words of a document; it is repeated if the same words also start
somewhere else. Two passes, each one shuffle of packed hashes:

1. **Anchors.** Every document is cut into non-overlapping blocks of ``(width + 1) // 2`` words, so any
   window holds a whole block. Blocks are the reference; every rolling run of as many words of every
   document probes them by its hash. A run that meets a block and occurs twice is a hit.
2. **Extension.** A repeated window holds a hit in both of its places. The windows around hits, and no
   others, are hashed whole; those that occur twice are repeated, and neighbouring ones add up to the
   maximal repeats of all copies at once. No pair of copies is ever formed, so a passage of thousands
   of copies costs as much as as many different passages.

**Transport.** A task packs its documents in chunks (``packing.sizes``). A chunk sends each
distinct hash once: to the bucket of the hash, with its first place (32 bits of hash in the first pass;
64 in the second, where a second hash picks the bucket; 128 bits name a document). Places that repeat a hash
inside a chunk stay behind with the chunk's directory of documents. So a hash that fills a third of all rows comes once a chunk.
A bucket answers with places; answers and directory of a chunk meet and become runs of window starts per
document. Texts are never shuffled by a hash; the second pass and the result read the table again and are
joined with the runs by the document's key.

A false hit of the first pass (equal 32 bits) costs a window hashed in vain, no result.

Defined results: null and empty texts have no words; texts of fewer words than a window lose and repeat
nothing; rows that repeat an id and its text repeat each other's windows; an empty table gives an empty result;
further columns are ignored (``scan``) or kept (``remove``), whatever their names. Rows should come in
the same order when a task is run again, as file scans give them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import give_back, small_batches, stored, tidy
from muster.llm.packing import from_planes, pack, planes, sizes, unpack

WIDTH = 35
#: words whose hashes a task remembers
HELD_WORDS = 300_000
#: runs are broadcast to the texts up to so many bytes
BROADCAST_BYTES = 24 << 20

Batches = Iterator[pa.RecordBatch]
#: odd multipliers of the hash of a window and of the one that picks its bucket
_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: kind 0: distinct hashes of a chunk for one bucket; 1: the chunk's directory
_PACKED = ("bucket int, chunk long, kind int, hashes binary, places binary, twice binary, block binary, "
           "k1 binary, k2 binary, starts binary, words binary, echo binary, first binary")
_FIELDS = [part.split()[0] for part in _PACKED.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 10


def words_of(raw: bytes) -> list[bytes]:
    """Maximal runs of bytes other than space, tab and line ends (20, 09 to 0D)."""
    return raw.split()


class WordHashes(dict):
    """64-bit hashes of words, remembered for the frequent ones of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def rolling(hashes: np.ndarray, width: int, starts: np.ndarray | None = None, step: np.uint64 = _STEP) -> np.ndarray:
    """Hashes of the ``width`` words from every place, or from ``starts``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n if starts is None else len(starts), np.uint64)
    for i in range(width):
        out = out * step + (hashes[i:i + n] if starts is None else hashes[starts + i])
    return mixed(out)


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(columns["chunk"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(name, [None] * n), kind) for name, kind in zip(_FIELDS, _TYPES, strict=True)], names=_FIELDS)


class Chunk:
    """Places and hashes of the documents packed together."""

    def __init__(self) -> None:
        self.k1: list[int] = []
        self.k2: list[int] = []
        self.starts: list[int] = []
        self.words: list[int] = []
        self.size = 0
        self.hashes: list[np.ndarray] = []
        self.picks: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []

    def add(self, k1: int, k2: int, n: int, hashes: np.ndarray, picks: np.ndarray, at: np.ndarray, block: np.ndarray) -> None:
        self.k1.append(k1)
        self.k2.append(k2)
        self.starts.append(self.size)
        self.words.append(n)
        self.hashes.append(hashes)
        self.picks.append(picks)
        self.places.append(at + self.size)
        self.blocks.append(block)
        self.size += n

    def packed(self, number: int, buckets: int, wide: bool) -> Iterator[pa.RecordBatch]:
        hashes, picks, places, blocks = (np.concatenate(x) for x in (self.hashes, self.picks, self.places, self.blocks))
        own, first, back, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        block = np.zeros(len(own), bool)
        np.logical_or.at(block, back[blocks], True)
        echo = np.ones(len(hashes), bool)
        echo[first] = False
        echo &= counts[back] > 1
        twice = counts > 1
        bucket = (picks[first] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((places[first], bucket))
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows: dict[str, list] = {name: [] for name in ("bucket", "chunk", "kind", "hashes", "places", "twice", "block")}
        for b in np.flatnonzero(np.diff(ends)):
            of = order[ends[b]:ends[b + 1]]
            sent = own[of] if wide else (own[of] >> np.uint64(32)).astype("<u4")
            for name, value in (("bucket", int(b)), ("chunk", number), ("kind", 0), ("hashes", sent.tobytes()),
                                ("places", pack(places[first[of]])), ("twice", np.packbits(twice[of]).tobytes()),
                                ("block", np.packbits(block[of]).tobytes())):
                rows[name].append(value)
        yield _rows(rows)
        yield _rows({"bucket": [number % buckets], "chunk": [number], "kind": [1],
                     "k1": [np.array(self.k1, np.int64).tobytes()], "k2": [np.array(self.k2, np.int64).tobytes()],
                     "starts": [np.array(self.starts, np.int64).tobytes()], "words": [np.array(self.words, np.int64).tobytes()],
                     "echo": [pack(places[echo])], "first": [planes(places[first[back[echo]]])]})


@tidy
def _send(batches: Batches, width: int, buckets: int, extend: bool, most: int) -> Batches:
    """First pass: the rolling runs of all documents. Second: the windows that start in a document's runs."""
    known, block = WordHashes(), (width + 1) // 2
    number, chunk = TaskContext.get().partitionId() << 32, Chunk()
    for batch in batches:
        runs = batch.column("runs").to_pylist() if extend else [None] * batch.num_rows
        for raw, k1, k2, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("k1").to_pylist(),
                                      batch.column("k2").to_pylist(), runs, strict=True):
            words = words_of(raw)
            n = len(words)
            if n < width:
                continue
            hashes = known.of(words)
            if extend:
                at = places_of(spans)
                chunk.add(k1, k2, n, rolling(hashes, width, at), rolling(hashes, width, at, _OTHER), at, np.ones(len(at), bool))
            else:
                at = np.arange(n - block + 1)
                runs_hash = rolling(hashes, block)  # its high half is sent, its low half picks the bucket
                chunk.add(k1, k2, n, runs_hash, runs_hash & np.uint64(0xFFFFFFFF), at, at % block == 0)
            if chunk.size >= most:
                yield from chunk.packed(number, buckets, extend)
                number, chunk = number + 1, Chunk()
    if chunk.size:
        yield from chunk.packed(number, buckets, extend)


def places_of(spans: list[int]) -> np.ndarray:
    """All numbers of runs [first, last, first, last, ...]."""
    ends = np.array(spans, np.int64).reshape(-1, 2)
    sizes = ends[:, 1] - ends[:, 0] + 1
    return np.repeat(ends[:, 0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def runs_of(places: np.ndarray) -> list[int]:
    """Ascending numbers as runs [first, last, first, last, ...]."""
    cut = np.flatnonzero(np.diff(places) > 1)
    return np.stack([places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])]], axis=1).ravel().tolist()


def _answer(group: pa.Table, wide: bool) -> pa.Table:
    """One bucket: the places of hashes that occur twice and in a block; directories pass through."""
    sent = group.filter(pc.equal(group["kind"], 0)).combine_chunks()
    out = [group.filter(pc.equal(group["kind"], 1)).select(["chunk", "kind", "places", "k1", "k2", "starts", "words",
                                                                    "echo", "first"])]
    if sent.num_rows:
        parts = [np.frombuffer(h, "<u8" if wide else "<u4") for h in sent["hashes"].to_pylist()]
        sizes = np.array([len(p) for p in parts])

        def bits(name: str) -> np.ndarray:
            return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n)
                                   for b, n in zip(sent[name].to_pylist(), sizes, strict=True)])

        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        often = np.add.reduceat(1 + bits("twice")[order].astype(np.int64), head) > 1
        often &= np.add.reduceat(bits("block")[order].astype(np.int64), head) > 0
        hit = np.zeros(len(hashes), bool)
        hit[order] = np.repeat(often, np.diff(np.append(head, len(ranked))))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        chunks, places = [], []
        for i, (number, packed) in enumerate(zip(sent["chunk"].to_pylist(), sent["places"].to_pylist(), strict=True)):
            of = hit[ends[i]:ends[i + 1]]
            if of.any():
                chunks.append(number)
                places.append(pack(unpack(packed)[of]))
        empty = [None] * len(chunks)
        out.append(pa.table([pa.array(chunks, pa.int64()), pa.array([0] * len(chunks), pa.int32()), pa.array(places, pa.binary()),
                             *[pa.array(empty, pa.binary())] * 6], names=out[0].column_names))
    give_back()
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def _spread(group: pa.Table, width: int, extend: bool) -> pa.Table:
    """One chunk: the answers of all buckets as runs of window starts per document."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("runs", pa.list_(pa.int32()))])
    answers = [unpack(p) for p in group.filter(pc.equal(group["kind"], 0))["places"].to_pylist()]
    if not answers:
        return schema.empty_table()
    directory = group.filter(pc.equal(group["kind"], 1)).to_pylist()[0]
    k1, k2, starts, words = (np.frombuffer(directory[x], np.int64) for x in ("k1", "k2", "starts", "words"))
    hits = np.sort(np.concatenate(answers))
    echo, first = unpack(directory["echo"]), from_planes(directory["first"]).astype(np.int64)
    if len(echo):
        at = np.minimum(np.searchsorted(hits, first), len(hits) - 1)
        hits = np.sort(np.concatenate([hits, echo[hits[at] == first]]))
    of = np.searchsorted(starts, hits, side="right") - 1
    ends = np.searchsorted(of, np.arange(len(starts) + 1))
    rows = []
    for d in np.flatnonzero(np.diff(ends)):
        own = hits[ends[d]:ends[d + 1]] - starts[d]
        if not extend:  # windows that hold the run of a hit
            reach = width - (width + 1) // 2
            mark = np.zeros(words[d] + 2, np.int64)
            last = words[d] - width
            np.add.at(mark, np.minimum(np.maximum(own - reach, 0), last + 1), 1)
            np.add.at(mark, np.minimum(own, last) + 1, -1)
            own = np.flatnonzero(np.cumsum(mark) > 0)
        rows.append((int(k1[d]), int(k2[d]), runs_of(own)))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


# --- the job -------------------------------------------------------------------------------------
def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with two hashes of id and text, and the text, under names no column has."""
    text, of = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`").cast("string")
    names = free_names(docs, "k1", "k2", "whole")
    return docs.withColumns(dict(zip(names, (F.xxhash64(text, F.hash(of), of), F.xxhash64(of, F.lit(1), text, F.crc32(text)), text),
                                     strict=True)))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each behind a mark that no column's name starts with."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return [mark + n for n in names]


def _round(rows: DataFrame, width: int, chunk: int, buckets: int, extend: bool) -> DataFrame:
    sent = rows.mapInArrow(partial(_send, width=width, buckets=buckets, extend=extend, most=chunk), _PACKED)
    answered = sent.groupBy("bucket").applyInArrow(
        lambda g: _answer(g, extend), "chunk long, kind int, places binary, k1 binary, k2 binary, starts binary, "
        "words binary, echo binary, first binary")
    spread = answered.groupBy("chunk").applyInArrow(lambda g: _spread(g, width, extend), "k1 long, k2 long, runs array<int>")
    # rows that repeat an id and its text have the same runs
    return stored(spread, "repeats-runs").dropDuplicates(["k1", "k2"])


def _with_runs(keyed: DataFrame, names: list[str], runs: DataFrame, how: str) -> tuple[DataFrame, str]:
    """``keyed`` joined with the runs; they are broadcast only if their counted size is small."""
    held = runs.agg(F.sum(32 + 4 * F.size("runs"))).first()[0] or 0
    k1, k2, found = free_names(keyed, "r1", "r2", "runs")
    side = runs.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("runs").alias(found))
    side = F.broadcast(side) if held <= BROADCAST_BYTES else side
    on = (F.col(names[0]) == F.col(k1)) & (F.col(names[1]) == F.col(k2))
    return keyed.join(side, on, how).drop(k1, k2), found


def repeated_windows(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, runs): runs [first, last, ...] of the starts of repeated windows per distinct (id, text)."""
    if width < 2:
        raise ValueError("a window needs two words at least")
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    names = free_names(docs, "k1", "k2", "whole")
    chunk, buckets = sizes(keyed, names[2])
    k1, k2, whole = (F.col(n) for n in names)
    with small_batches(spark):
        hits = _round(keyed.select(k1.alias("k1"), k2.alias("k2"), whole.alias("text")), width, chunk, buckets, False)
        near, found = _with_runs(keyed, names, hits, "inner")
        near = near.select(k1.alias("k1"), k2.alias("k2"), whole.alias("text"), F.col(found).alias("runs"))
        return stored(_round(near, width, chunk, buckets, True), "repeats-windows")


def covered(n: int, runs: list[int], width: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a window that starts in one of the runs."""
    mark = np.zeros(n + 1, np.int64)
    ends = np.array(runs, np.int64).reshape(-1, 2)
    np.add.at(mark, ends[:, 0], 1)
    np.add.at(mark, ends[:, 1] + width, -1)
    return np.cumsum(mark)[:n] > 0


def kept_words(raw: bytes, runs: list[int] | None, width: int) -> tuple[list[bytes], int]:
    words = words_of(raw)
    if not runs:
        return words, len(words)
    gone = covered(len(words), runs, width)
    return [words[i] for i in np.flatnonzero(~gone)], len(words)


@tidy
def _digests(batches: Batches, width: int) -> Batches:
    for batch in batches:
        total, removed, digests = [], [], []
        for raw, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
            kept, n = kept_words(raw, runs, width)
            total.append(n)
            removed.append(n - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(digests, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])


def _texts(batches: Batches, width: int, at: str) -> Batches:
    for batch in batches:
        runs, texts = batch.column("runs").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
        new = [raw if not own else b" ".join(kept_words(raw, own, width)[0]) for raw, own in zip(texts, runs, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(at), pa.array(new, pa.binary()).cast(pa.string())], names=[at, "text"])


def _marked(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    keyed = _keyed(docs, id_col, text_col)
    names = free_names(docs, "k1", "k2", "whole")
    marked, found = _with_runs(keyed, names, repeated_windows(docs, width, id_col, text_col), "left")
    return marked, names[2], found


def scan(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_removed (words in repeated windows), kept_sha256 (of the others)."""
    marked, whole, found = _marked(docs, width, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]
    return (marked.select(F.col(f"`{id_col}`").alias("id"), F.col(whole).alias("text"), F.col(found).alias("runs"))
            .mapInArrow(lambda b: _digests(b, width), f"id {kind}, n_words long, n_removed long, kept_sha256 string")
            .withColumnRenamed("id", id_col))


def remove(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of their texts, the words left joined by single spaces;
    texts that lose nothing stay as they are."""
    marked, whole, found = _marked(docs, width, id_col, text_col)
    own: list[Column] = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    new = (marked.select(F.struct(*own).alias("row"), F.col(whole).alias("text"), F.col(found).alias("runs"),
                         F.col(f"`{text_col}`").isNull().alias("none")))
    rows = new.select(F.struct("row", "none").alias("row"), "text", "runs")
    kept = rows.mapInArrow(lambda b: _texts(b, width, "row"), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return kept.select(*[F.when(~F.col("row.none"), F.col("text")).alias(c) if c == text_col else F.col(f"row.row.`{c}`")
                         for c in docs.columns])
