"""N-gram Jaccard join with signature trees.

A document's set holds the 64-bit hashes of its distinct word k-grams. Documents with equal sets form
a class; classes are joined.

**Which classes meet.** With all grams in one fixed order, two sets that reach the threshold share a
gram among the first ``n - ceil(t * n) + 1`` of each (n: own size). Classes that share such a gram form
a unit. The order is by exact document frequency, rarest first, so that common lines, passages and
phrases do not bring strangers together. Grams of one document alone come first and meet nobody: a
document whose first grams are all its own has no unit at all. Frequencies are counted in one shuffle
of packed hashes: a task sends each distinct gram of its documents once to the gram's bucket (32 bits,
a count and a place), and the bucket answers for those that other places hold too.

**Signature trees.** In a unit every class has a signature: a bitmap of its grams (about a byte per
gram) and its size. Leaves hold runs of classes ordered by size; every node holds the OR of its bitmaps,
its range of sizes and its least number of set bits, and its component if all its classes share one.
Two trees (or a tree and itself) are traversed together: a pair of nodes is dropped if the sizes
are too far apart, if the common bits leave too little overlap possible, or if both lie wholly in one
component. Bitmaps of different widths are folded to the narrower. Pairs of classes that survive
are verified on the full sets.

**Order of work.** Links inside a component add nothing, so most pairs need no test:

1. classes with the same smallest gram meet once with their full sets and are linked in the task;
2. units whose classes are in more than one component are traversed; the best pair of every two
   components is verified;
3. what still lies in different components is traversed again, and every surviving pair is verified.

The result is exact: a pair that reaches the threshold ends in one component. Links are not listed
pair by pair; what is returned is the component of every document, and the links that prove it.

A unit with more than ``BLOCK`` classes is cut into blocks by component, and pairs of blocks are
separate tasks; blocks of one and the same component are not paired.

Defined results: null texts, empty texts and texts without words have size 0 and link with nothing;
shorter texts than a k-gram are one gram, their whole sequence; rows that repeat an id are documents
of their own; a component's id is its smallest id that is not null; an empty table gives an empty
result; further columns are ignored (``link``) or kept (``deduplicate``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import give_back, small_batches, stored, tidy
from muster.llm.graph import components
from muster.llm.packing import from_planes, pack, planes, sizes, unpack
from muster.llm.words import KEY_ROWS, small, text_key

K, PERCENT = 5, 80
BLOCK = 1_000
LEAF, FANOUT = 16, 8
SLICE, PAIRS = 256, 50_000  # rows unpacked, and pairs held, at once
#: grams of the classes of a block, which one task holds
BLOCK_GRAMS = 1_500_000

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = (np.random.default_rng(17).integers(0, 2**63, 256).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _STEP, np.uint64), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z in lower case."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    inside = np.flatnonzero(~blank)
    sizes = ends - starts
    place = inside - np.repeat(starts, sizes)
    weight = _POWERS[place & 4095] + (place >> 12).astype(np.uint64)
    sums = np.add.reduceat(_ODD[raw[inside]] * weight, np.cumsum(sizes) - sizes, dtype=np.uint64)
    return _mix(sums ^ sizes.astype(np.uint64))


def gram_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the word k-grams; of the whole sequence if there are fewer words."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    n, span = max(1, len(words) - k + 1), min(k, len(words))
    grams = np.full(n, span, np.uint64)
    for i in range(span):
        grams = _mix(grams * _STEP + words[i:i + n])
    return np.unique(grams)


# --- signatures and trees ------------------------------------------------------------------------
def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Common grams needed by sets of n and m grams: 100 * common >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def width_of(n: int) -> int:
    """64-bit words of a signature: a power of two with about a byte per gram."""
    return 1 << max(0, math.ceil(math.log2(max(1, n) / 8)))


def signature(grams: np.ndarray) -> np.ndarray:
    width = width_of(len(grams))
    bits = np.zeros(width * 64, bool)
    bits[(grams & np.uint64(width * 64 - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Signatures (rows) of a smaller width: the OR of their parts, as the low hash bits pick a place."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, width), axis=-2)


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


@dataclass
class Node:
    bits: np.ndarray
    least_bits: int
    low: int
    high: int
    component: int | None
    children: list[Node] | None
    rows: np.ndarray | None


class SignatureTree:
    """Classes with sizes, signatures and components; ``pairs`` finds those that may reach the threshold."""

    def __init__(self, sizes, signatures: list[np.ndarray], comps):
        self.sizes, self.comps = np.asarray(sizes, np.int64), np.asarray(comps, np.int64)
        self.signatures = signatures
        order = np.lexsort((self.comps, self.sizes))
        self.leaf_bits: dict[int, np.ndarray] = {}
        level = [self._leaf(order[i:i + LEAF]) for i in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self._join(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self.root = level[0]

    def _leaf(self, rows: np.ndarray) -> Node:
        width = min(len(self.signatures[r]) for r in rows)
        bits = np.stack([_fold(self.signatures[r], width) for r in rows])
        node = Node(np.bitwise_or.reduce(bits, axis=0), int(_count(bits).min()), int(self.sizes[rows].min()),
                    int(self.sizes[rows].max()), self._one(self.comps[rows]), None, rows)
        self.leaf_bits[id(node)] = bits
        return node

    @staticmethod
    def _one(comps) -> int | None:
        first = comps[0]
        return int(first) if first is not None and all(c == first for c in comps) else None

    def _join(self, nodes: list[Node]) -> Node:
        width = min(len(n.bits) for n in nodes)
        # folding loses set bits, so a node keeps only what it can promise at its own width
        bits = np.stack([_fold(n.bits, width) for n in nodes])
        promised = min(n.least_bits if len(n.bits) == width else 0 for n in nodes)
        return Node(np.bitwise_or.reduce(bits, axis=0), promised, min(n.low for n in nodes),
                    max(n.high for n in nodes), self._one([n.component for n in nodes]), nodes, None)

    def pairs(self, percent: int, other: SignatureTree | None = None,
              same: Callable[[int, int], bool] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows here, rows there, possible overlap) of pairs in different components, leaf by leaf."""
        stack = [(self.root, (other or self).root)]
        while stack:
            a, b = stack.pop()
            if a.component is not None and a.component == b.component:
                continue
            if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
                continue
            if a is not b and len(a.bits) == len(b.bits):
                common = int(_count(a.bits & b.bits))
                most = min(a.high - max(0, a.least_bits - common), b.high - max(0, b.least_bits - common))
                if most < least_overlap(a.low, b.low, percent):
                    continue
            if a.rows is not None and b.rows is not None:
                found = self._leaf_pairs(a, b, other or self, percent)
                if found is not None:
                    yield found
            elif b.rows is not None or (a.rows is None and a.high - a.low >= b.high - b.low and a is not b):
                stack += [(c, b) for c in a.children]
            elif a is b:
                stack += [(c, d) for i, c in enumerate(a.children) for d in a.children[i:]]
            else:
                stack += [(a, c) for c in b.children]

    def _leaf_pairs(self, a: Node, b: Node, other: SignatureTree, percent: int):
        left, right = self.leaf_bits[id(a)], other.leaf_bits[id(b)]
        width = min(left.shape[1], right.shape[1])
        left, right = _fold(left, width), _fold(right, width)
        n, m = self.sizes[a.rows], other.sizes[b.rows]
        common = _count(left[:, None, :] & right[None, :, :])
        most = np.minimum(n[:, None] - (_count(left)[:, None] - common), m[None, :] - (_count(right)[None, :] - common))
        possible = most >= least_overlap(n[:, None], m[None, :], percent)
        possible &= self.comps[a.rows][:, None] != other.comps[b.rows][None, :]
        if a is b:
            possible &= np.triu(np.ones_like(possible), 1)
        i, j = np.nonzero(possible)
        return (a.rows[i], b.rows[j], most[i, j]) if len(i) else None


# --- tasks ---------------------------------------------------------------------------------------
Batches = Iterator[pa.RecordBatch]


#: kind 0: distinct grams of a chunk for one bucket; 1: the chunk's documents
_DOCUMENT = ("key", "n", "h1", "h2", "least")
_SENT = ["bucket int", "chunk long", "kind int", "grams binary", "counts binary", "places binary",
         *[f"{name} binary" for name in (*_DOCUMENT, "echo", "first")]]


def _packed(ids: list, id_type: pa.DataType, about: list[tuple], sets: list[np.ndarray], number: int, buckets: int) -> Batches:
    """The rows of one chunk: its distinct grams by bucket, its documents."""
    grams = np.concatenate([np.zeros(0, np.uint64), *sets])
    own, first, back, counts = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
    bucket = ((own >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((first, bucket))
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    echo = np.ones(len(grams), bool)
    echo[first] = False
    echo = np.flatnonzero(echo)
    rows = []
    for b in np.flatnonzero(np.diff(ends)).tolist():
        of = order[ends[b]:ends[b + 1]]
        rows.append({"bucket": b, "chunk": number, "kind": 0, "grams": own[of].astype("<u4").tobytes(),
                     "counts": planes(counts[of]), "places": pack(first[of])})
    documents = dict(zip(_DOCUMENT, (np.array(x, np.int64).tobytes() for x in zip(*about, strict=True)), strict=True))
    rows.append({"bucket": number % buckets, "chunk": number, "kind": 1, "ids": ids, "echo": pack(echo),
                 "first": planes(first[back[echo]]), **documents})
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()),
                        *[(f.split()[0], pa.binary()) for f in _SENT[3:]], ("ids", pa.list_(id_type))])
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


@tidy
def _send_grams(batches: Batches, k: int, buckets: int, most: int) -> Batches:
    number, ids, about, sets, held = TaskContext.get().partitionId() << 32, [], [], [], 0
    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field("id").type
        for doc, key, text in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(),
                                  batch.column("text").to_pylist(), strict=True):
            grams = gram_set(text, k)
            ids.append(doc)
            sets.append(grams)
            if len(grams):
                about.append((key, len(grams), int(_mix(grams ^ _STEP).sum().view(np.int64)),
                              int(np.bitwise_xor.reduce(_mix(grams + _STEP)).view(np.int64)), int(grams[0].view(np.int64))))
            else:
                about.append((key, 0, 0, 0, 0))
            held += len(grams) + 1
            if held >= most:
                yield from _packed(ids, kind, about, sets, number, buckets)
                number, ids, about, sets, held = number + 1, [], [], [], 0
    if ids:
        yield from _packed(ids, kind, about, sets, number, buckets)


def _answer_grams(group: pa.Table) -> pa.Table:
    """One bucket: place, gram and frequency of every gram of several documents; documents pass through."""
    passed = group.filter(pc.equal(group["kind"], 1)).select(["chunk", "kind", "grams", "counts", "places", *_DOCUMENT, "echo",
                                                              "first", "ids"])
    sent = group.filter(pc.equal(group["kind"], 0)).combine_chunks()
    if not sent.num_rows:
        return passed
    parts = [np.frombuffer(g, "<u4") for g in sent["grams"].to_pylist()]
    grams, counts = np.concatenate(parts), np.concatenate([from_planes(c) for c in sent["counts"].to_pylist()])
    order = np.argsort(grams, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(grams[order]) != 0]))
    total = np.empty(len(grams), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), head), np.diff(np.append(head, len(grams))))
    rows, ends = [], np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for i, (number, places) in enumerate(zip(sent["chunk"].to_pylist(), sent["places"].to_pylist(), strict=True)):
        of = slice(ends[i], ends[i + 1])
        shared = total[of] > 1
        if shared.any():
            often = np.minimum(255, 8 * np.log2(total[of][shared])).astype(np.uint8)
            rows.append({"chunk": number, "kind": 0, "grams": parts[i][shared].tobytes(), "counts": often.tobytes(),
                         "places": pack(unpack(places)[shared])})
    give_back()
    return pa.concat_tables([passed, pa.Table.from_pylist(rows, schema=passed.schema)])


def _choose_grams(group: pa.Table, percent: int) -> pa.Table:
    """One chunk: its documents with the grams to meet by, the rarest first."""
    about = group.filter(pc.equal(group["kind"], 1)).combine_chunks()
    key, n, h1, h2, least = (np.frombuffer(about[name][0].as_py(), np.int64) for name in _DOCUMENT)
    answers = group.filter(pc.equal(group["kind"], 0))
    places = np.concatenate([np.zeros(0, np.int64), *[unpack(p) for p in answers["places"].to_pylist()]])
    grams = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(g, "<u4") for g in answers["grams"].to_pylist()]])
    often = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(c, np.uint8) for c in answers["counts"].to_pylist()]])
    order = np.argsort(places)
    places, grams, often = places[order], grams[order], often[order]
    echo, first = unpack(about["echo"][0].as_py()), from_planes(about["first"][0].as_py()).astype(np.int64)
    at = np.searchsorted(places, first)  # what a chunk holds twice is always answered
    places, grams, often = np.append(places, echo), np.append(grams, grams[at]), np.append(often, often[at])
    of = np.searchsorted(np.cumsum(n), places, side="right")
    order = np.lexsort((grams, often, of))
    of, grams = of[order], grams[order]
    shared = np.bincount(of, minlength=len(n))
    wanted = n - -(-percent * n // 100) + 1 - (n - shared)
    keep = np.arange(len(of)) - (np.cumsum(shared) - shared)[of] < wanted[of]
    taken = np.bincount(of[keep], minlength=len(n))
    prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken)]), pa.int32()),
                                      pa.array(np.ascontiguousarray(grams[keep]).view(np.int32), pa.int32()))
    return pa.table([about["ids"].combine_chunks().flatten(), *[pa.array(x) for x in (key, n, h1, h2, least)], prefix],
                    names=["id", "key", "n", "h1", "h2", "least", "prefix"])


@tidy
def _signatures(batches: Batches, k: int) -> Batches:
    for batch in batches:
        sets = [gram_set(t, k) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array([len(g) for g in sets], pa.int64()),
             pa.array([signature(g).tobytes() for g in sets], pa.binary())], names=["row", "n", "signature"])


@tidy
def _full_sets(batches: Batches, k: int) -> Batches:
    for batch in batches:
        sets = [gram_set(t, k).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.list_(pa.int64()))],
                                         names=["row", "grams"])


def _groups(batches: Batches, keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys; the rows come sorted by them."""
    rows = (row for batch in batches for at in range(0, batch.num_rows, SLICE)
            for row in batch.slice(at, SLICE).to_pylist())
    for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield list(group)


@tidy
def _link_task(batches: Batches, percent: int) -> Batches:
    """Links that join the classes of a group of full sets; pairs already joined are not verified."""
    for group in _groups(batches, ["least", "block"]):
        sets = [np.array(r["grams"], np.int64).view(np.uint64) for r in group]
        tree = SignatureTree([len(s) for s in sets], [signature(s) for s in sets], range(len(sets)))
        parent = list(range(len(sets)))

        def root(x: int, parent=parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for left, right, most in tree.pairs(percent):
            for i in np.argsort(-most, kind="stable"):
                a, b = int(left[i]), int(right[i])
                ra, rb = root(a), root(b)
                if ra == rb:
                    continue
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if common >= least_overlap(len(sets[a]), len(sets[b]), percent):
                    parent[ra] = rb
                    links.append((group[a]["row"], group[b]["row"]))
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _best_pairs(found: list[np.ndarray]) -> np.ndarray:
    """Of every two components the pair with the highest score."""
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort((-pairs[4], pairs[3], pairs[2]))]
    first = np.concatenate([[True], (np.diff(pairs[2:4], axis=1) != 0).any(axis=0)])
    return pairs[:, first]


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=["a", "b", "low", "high", "score"])


@tidy
def _traverse_task(batches: Batches, percent: int, every: bool) -> Batches:
    """Pairs of classes in different components that may be linked; of every two components the most
    likely, or all. The classes of a home come first, then its units."""
    known: dict[int, tuple[int, np.ndarray]] = {}
    for group in _groups(batches, ["home", "unit"]):
        if group[0]["unit"] == "":
            known = {r["row"]: (r["n"], np.frombuffer(r["signature"], np.uint64)) for r in group}
            continue
        sides = [[r for r in group if r["side"] == s] for s in (0, 1)]
        trees = [SignatureTree([known[r["row"]][0] for r in side], [known[r["row"]][1] for r in side],
                               [r["comp"] for r in side]) if side else None for side in sides]
        if trees[0] is None or (group[0]["two"] and trees[1] is None):
            continue
        rows = [np.array([r["row"] for r in side], np.int64) for side in sides]
        there, other = (trees[0], rows[0]) if trees[1] is None else (trees[1], rows[1])
        found, held = [], 0
        for left, right, most in trees[0].pairs(percent, trees[1]):
            n, m = trees[0].sizes[left], there.sizes[right]
            a, b, ca, cb = rows[0][left], other[right], trees[0].comps[left], there.comps[right]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.minimum(ca, cb), np.maximum(ca, cb),
                                   most * 1_000_000 // (n + m - most)]))
            held += len(left)
            if held > PAIRS:
                found = [np.concatenate(found, axis=1) if every else _best_pairs(found)]
                held = found[0].shape[1]
                if every or held > PAIRS // 2:
                    yield _pair_batch(found.pop())
                    held = 0
        if found:
            yield _pair_batch(np.concatenate(found, axis=1) if every else _best_pairs(found))


# --- the join ------------------------------------------------------------------------------------
class JaccardJoin:
    """The steps over one table. ``members``: a row per document; ``comps``: what joins the classes."""

    def __init__(self, docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id",
                 text_col: str = "text"):
        if k < 1 or not 1 <= percent <= 100:
            raise ValueError("need k >= 1 and 1 <= percent <= 100")
        self.k, self.percent = k, percent
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), text.alias("text"))
        self.id_type = dict(self.texts.dtypes)["id"]
        self._describe()
        self._classes()
        self._find_components(stored(self._first_links(), "jaccard-links"))
        units = self._units()
        for every in (False, True):
            found = stored(self._verified(self._candidates(units, every)), "jaccard-links")
            if not found.isEmpty():
                self._find_components(found.unionByName(self.comps.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        self.members = self._members()

    def _describe(self) -> None:
        """Per document: size, set hash, smallest gram, and the grams to meet by."""
        k, percent, spark = self.k, self.percent, self.texts.sparkSession
        chunk, buckets = sizes(self.texts)
        ids = f"ids array<{self.id_type}>"
        sent = self.texts.mapInArrow(lambda b: _send_grams(b, k, buckets, chunk), ", ".join([*_SENT, ids]))
        answered = sent.groupBy("bucket").applyInArrow(_answer_grams, ", ".join([*_SENT[1:], ids]))
        chosen = answered.groupBy("chunk").applyInArrow(
            lambda g: _choose_grams(g, percent), f"id {self.id_type}, key long, n long, h1 long, h2 long, least long, prefix array<int>")
        with small_batches(spark):
            self.described = stored(chosen.withColumn("row", F.monotonically_increasing_id()), "jaccard-described")

    def _classes(self) -> None:
        """Every document's class: the first row with an equal set."""
        own = self.described.where("n > 0").select("id", "key", "row", "n", "h1", "h2")
        first = own.groupBy("h1", "h2", "n").agg(F.min("row").alias("cls"), F.count(F.lit(1)).alias("c"))
        several = stored(first.where("c > 1").drop("c"), "jaccard-several")
        self.by_class = stored(own.join(small(several, several.count()), ["h1", "h2", "n"], "left")
                               .select("id", "key", "row", "n", F.coalesce("cls", "row").alias("cls")), "jaccard-members")
        self.repeats = not own.groupBy("id", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
        copies = self.by_class.where("cls <> row").select("row")
        self.classes = self.described.where("n > 0").join(small(copies, copies.count()), "row", "left_anti")

    def _texts_of(self, rows: DataFrame) -> DataFrame:
        """row, text of some rows; where rows repeat an id and its text, a row comes once per repetition."""
        wanted = stored(self.by_class.join(rows.select("row").distinct(), "row", "left_semi")
                        .select(F.col("id").alias("_id"), F.col("key").alias("_key"), "row"), "jaccard-wanted")
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
        return self.texts.join(small(wanted, wanted.count()), same).select("row", "text")

    def _sets(self, rows: DataFrame) -> DataFrame:
        """row, grams: the full sets of the documents of some rows, from their texts."""
        k = self.k
        sets = self._texts_of(rows).mapInArrow(lambda b: _full_sets(b, k), "row long, grams array<long>")
        return sets.dropDuplicates(["row"]) if self.repeats else sets

    def _signed(self, rows: DataFrame) -> DataFrame:
        """row, n, signature of the documents of some rows."""
        k = self.k
        signed = self._texts_of(rows).mapInArrow(lambda b: _signatures(b, k), "row long, n long, signature binary")
        return signed.dropDuplicates(["row"]) if self.repeats else signed

    def _first_links(self) -> DataFrame:
        percent = self.percent
        least = self.classes.select("row", "least", "n")
        sizes = least.groupBy("least").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total")).where("c > 1")
        blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("total") / BLOCK_GRAMS))
        groups = stored(least.join(sizes, "least")
                        .select("row", "least", F.pmod(F.xxhash64("row"), blocks).alias("block")), "jaccard-groups")
        return (self._sets(groups).join(small(groups, groups.count()), "row").repartition("least", "block")
                .sortWithinPartitions("least", "block", "row").select("least", "block", "row", "grams")
                .mapInArrow(lambda b: _link_task(b, percent), "a long, b long"))

    def _find_components(self, links: DataFrame) -> None:
        self.comps = stored(components(links), "jaccard-components")
        self.linked = self.comps.count()

    def _with_component(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``row``) and ``comp``; a class without a link is its own component."""
        of = small(self.comps.select(F.col("node").alias("row"), "component"), self.linked)
        return rows.join(of, "row", "left").withColumn("comp", F.coalesce("component", "row")).drop("component")

    def _units(self) -> DataFrame:
        """(token, row): classes that share a gram to meet by, where they are not one component yet.

        Of grams with the same classes one is kept.
        """
        tokens = self._with_component(self.classes.where(F.size("prefix") > 0).select("row", "prefix")) \
            .select("row", "comp", F.explode("prefix").alias("token"))
        # most grams are in one class only; this first aggregation carries as little as it can
        shared = stored(tokens.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
                        .where("low < high").select("token"), "jaccard-tokens")
        units = stored(tokens.join(small(shared, shared.count(), KEY_ROWS), "token", "left_semi").select("token", "row"),
                       "jaccard-units")
        kept = stored(units.groupBy("token").agg(
            F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("row")).alias("who"),
            F.sum(F.xxhash64("row").bitwiseAND(0xFFFFFFFF)).alias("sum"))
            .groupBy("c", "who", "sum").agg(F.min("token").alias("token")).select("token"), "jaccard-tokens")
        return units.join(small(kept, kept.count(), KEY_ROWS), "token", "left_semi")

    def _candidates(self, units: DataFrame, every: bool) -> DataFrame:
        percent = self.percent
        rows = self._with_component(units)
        per = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("first"))
        totals = per.groupBy("token").agg(
            F.sum("c").alias("total"), F.count(F.lit(1)).alias("comps"),
            F.min("first").alias("first"),
            F.sum(F.when(F.col("c") <= BLOCK, F.col("c")).otherwise(0)).alias("small_total")).where("comps > 1")
        totals = stored(totals, "jaccard-totals")
        # units of the same family share their first class: with that as their home, a signature is sent
        # once per home and not once per unit
        whole = totals.where(F.col("total") <= BLOCK).select("token", "first")
        one = rows.join(small(whole, whole.count()), "token").select(
            F.col("first").cast("string").alias("home"), F.col("token").cast("string").alias("unit"),
            F.lit(False).alias("two"), F.lit(0).alias("side"), "row", "comp")
        pair = F.concat_ws("|", F.col("token").cast("string"), "left_block", "right_block")
        blocked = self._blocked(rows, per, totals).select(
            pair.alias("home"), pair.alias("unit"), (F.col("left_block") != F.col("right_block")).alias("two"),
            "side", "row", "comp")
        parts = stored(one.unionByName(blocked), "jaccard-parts")
        homes = parts.select("home", "row").distinct().join(self._signed(parts), "row").select(
            "home", F.lit("").alias("unit"), F.lit(False).alias("two"), F.lit(0).alias("side"), "row",
            F.lit(None).cast("long").alias("comp"), "n", "signature")
        tasks = (homes.unionByName(parts.withColumns({"n": F.lit(None).cast("long"),
                                                      "signature": F.lit(None).cast("binary")}))
                 .repartition("home").sortWithinPartitions("home", "unit", "side", "row")
                 .select("home", "unit", "two", "side", "row", "comp", "n", "signature"))
        pairs = tasks.mapInArrow(lambda b: _traverse_task(b, percent, every),
                                 "a long, b long, low long, high long, score long")
        if not every:
            pairs = pairs.groupBy("low", "high").agg(F.max(F.struct("score", "a", "b")).alias("best")).select("best.*")
        return stored(pairs.select("a", "b").distinct(), "jaccard-pairs")

    def _blocked(self, rows: DataFrame, per: DataFrame, totals: DataFrame) -> DataFrame:
        """Units beyond ``BLOCK``: a component beyond it has blocks of its own, which are not paired with
        each other; the other components are dealt to blocks together."""
        large = totals.where(F.col("total") > BLOCK).select("token", "small_total")
        counted = (per.join(small(large, large.count()), "token")
                   .select("token", "comp", "c", F.ceil(F.col("small_total") / BLOCK).alias("small_blocks")))
        counted = stored(counted, "jaccard-counted")

        def name(own: Column) -> Column:
            return F.when(F.col("c") > BLOCK, F.concat(F.lit("c"), F.col("comp"), F.lit("."), own)).otherwise(
                F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.greatest(F.col("small_blocks"), F.lit(1)))))

        of_row = F.pmod(F.xxhash64("row"), F.ceil(F.col("c") / BLOCK))
        dealt = stored(rows.join(small(counted, counted.count()), ["token", "comp"])
                       .select("token", "row", "comp", name(of_row.cast("string")).alias("block")), "jaccard-dealt")
        blocks = stored(counted.select("token", "comp", "c", F.explode(F.sequence(
            F.lit(0).cast("long"), F.when(F.col("c") > BLOCK, F.ceil(F.col("c") / BLOCK) - 1).otherwise(0))).alias("i"),
            "small_blocks").select("token", F.when(F.col("c") > BLOCK, F.col("comp")).alias("owner"),
                                   name(F.col("i").cast("string")).alias("block")).distinct(), "jaccard-blocks")
        mixed = blocks.where("owner is null").select("token", F.col("block").alias("x"))
        owned = blocks.where("owner is not null")
        any_block = blocks.select("token", F.col("block").alias("y"))
        pairs = mixed.join(any_block, "token").unionByName(
            owned.select("token", F.col("block").alias("x"), F.col("owner").alias("ox"))
            .join(owned.select("token", F.col("block").alias("y"), F.col("owner").alias("oy")), "token")
            .where("ox < oy").select("token", "x", "y"))
        pairs = stored(pairs.select("token", F.least("x", "y").alias("left_block"),
                                    F.greatest("x", "y").alias("right_block")).distinct(), "jaccard-block-pairs")
        n = pairs.count()
        left = dealt.join(small(pairs.withColumn("block", F.col("left_block")), n), ["token", "block"]) \
            .withColumn("side", F.lit(0))
        right = dealt.join(small(pairs.where("left_block <> right_block").withColumn("block", F.col("right_block")), n),
                           ["token", "block"]).withColumn("side", F.lit(1))
        return left.unionByName(right).select("token", "left_block", "right_block", "side", "row", "comp")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        sets = stored(self._sets(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row")))),
                      "jaccard-sets")
        both = (pairs.join(sets.select(F.col("row").alias("a"), F.col("grams").alias("ga")), "a")
                .join(sets.select(F.col("row").alias("b"), F.col("grams").alias("gb")), "b"))
        common = F.size(F.array_intersect("ga", "gb"))
        enough = F.lit(100) * common >= F.lit(self.percent) * (F.size("ga") + F.size("gb") - common)
        return both.where(enough).select("a", "b")

    def _members(self) -> DataFrame:
        """id, key, row, n, root, component_id, keeper of every document; documents without grams too."""
        of = small(self.comps.select(F.col("node").alias("cls"), "component"), self.linked)
        rooted = (self.by_class.join(of, "cls", "left")
                  .select("id", "key", "row", "n", F.coalesce("component", "cls").alias("root")))
        groups = stored(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("component_id"),
                                                   F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("k"))
                        .where("c > 1").select("root", "component_id", F.col("k.row").alias("keeper")), "jaccard-roots")
        linked = (rooted.join(small(groups, groups.count()), "root", "left")
                  .withColumn("component_id", F.when(F.col("keeper").isNull(), F.col("id")).otherwise(F.col("component_id")))
                  .withColumn("keeper", F.coalesce("keeper", "row")))
        empty = self.described.where("n = 0").select("id", "key", "row", "n", F.col("row").alias("root"),
                                                     F.col("id").alias("component_id"), F.col("row").alias("keeper"))
        return linked.unionByName(empty)


def link(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles (size of its set) and component_id."""
    members = JaccardJoin(docs, k, percent, id_col, text_col).members
    return members.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every component: the one with the smallest id."""
    members = stored(JaccardJoin(docs, k, percent, id_col, text_col).members, "jaccard-result")
    keys = members.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(
        F.max(F.col("row") == F.col("keeper")).alias("__kept"), F.sum((F.col("row") == F.col("keeper")).cast("int")).alias("times"),
        F.count(F.lit(1)).alias("rows"))
    # only ids and texts of which some row goes
    special = stored(keys.where("times < rows").select("__id", "__key", "__kept"), "jaccard-dropped")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(*own, text_key(F.col(text_col)).alias("__text")).join(small(special, special.count()), same, "left")
    plain = marked.where(F.col("__kept").isNull()).select(*own)
    once = marked.where(F.col("__kept")).dropDuplicates(["__id", "__key"]).select(*own)
    return plain.unionByName(once)
