"""Embedding near-duplicates by NN-descent.

The graph starts from random-projection leaves (vectors on the same side of a set of random
hyperplanes, several sets), and is refined by neighbours of neighbours: at every vector its neighbours
and those that have it as a neighbour are compared with each other, and each keeps its best ``K``.
Lists saturated with links (the last neighbour is still over the threshold) are enlarged and refined
again. A vector with ``K`` links or more in its list may have others beyond it; such dense vectors are completed
exactly, component by component, by block products that add up counts and emit only a spanning forest,
so a group's links are counted without ever being listed. Lists full of near copies never leave their
group, so before that representatives of all components with dense vectors meet in leaves of their own,
chosen and placed anew until no two of different components are linked.

The number of trees follows the table's size: two vectors at the threshold lie on the same side of a
hyperplane with a known chance, so in one leaf of a tree of a depth, and there are as many trees as it takes
for the pair to meet with chance ``MEET``. A pair without other neighbours depends on this alone.

Recall is audited in two ways, and while either share is below ``TARGET``, another round starts from new
hyperplanes (an error after ``ROUNDS``). ``AUDIT`` vectors, chosen by hash, are compared with all, and their links
counted against the result, dense vectors included. Where links are sparse that may see none, which says nothing.
So ``PLANTED`` vectors, chosen by hash, get a partner at the threshold, in a random direction, which goes through the
search like any vector and then is taken out; the share of these pairs that were found is the recall of the
hardest links, whatever the table.

The graph is built on half-precision unit vectors with a margin; every link is verified in double
precision. Equal vectors are one node with a weight, so copies cost nothing.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do vectors of different lengths; repeated rows are vectors of their own; a component's id
is its smallest vector id that is not null; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import stored
from muster.llm.graph import components
from muster.llm.words import small

THRESHOLD = 0.9
MARGIN = 0.01  # half precision
K, LARGE_K = 10, 40
LEAF, MEET = 200, 0.995
ITERATIONS, ROUNDS = 2, 12
AUDIT, PLANTED, TARGET = 512, 256, 0.98
BLOCK = 1_000
REPRESENTATIVES = 16  # of a component, at most

Batches = Iterator[pa.RecordBatch]


def _rows(batches: Batches) -> Iterator[dict]:
    return (row for batch in batches for row in batch.to_pylist())


def _matrix(packed: list[bytes], kind: str = "<f2") -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float32 if kind == "<f2" else np.float64)


def _edges(u, v, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()),
                                       pa.array(sim, pa.float32())], names=["u", "v", "sim"])


EDGE = "u long, v long, sim float"


def _pack(batches: Batches) -> Batches:
    """Unit vectors in double and half precision."""
    for batch in batches:
        units = []
        for x in batch.column("vector").to_pylist():
            x = np.asarray(x, np.float64)
            x = x / np.abs(x).max()  # neither overflow nor underflow in the norm
            units.append(x / np.sqrt(x @ x))
        yield pa.RecordBatch.from_arrays([
            batch.column("node"), batch.column("weight"), pa.array([len(x) for x in units], pa.int32()),
            pa.array([x.astype("<f8").tobytes() for x in units], pa.binary()),
            pa.array([x.astype("<f2").tobytes() for x in units], pa.binary())],
            names=["node", "weight", "dim", "unit", "half"])


def _partners(batches: Batches, cosine: float) -> Batches:
    """For each vector a unit vector at ``cosine`` to it, in a direction drawn by its node; numbered below zero."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            unit = np.frombuffer(row["unit"], "<f8")
            aside = np.random.default_rng(row["node"]).normal(size=len(unit))
            aside -= (aside @ unit) * unit
            x = cosine * unit + np.sqrt(1 - cosine**2) * aside / np.sqrt(aside @ aside)
            rows.append({"node": -1 - row["node"], "weight": 0, "dim": len(x), "unit": x.astype("<f8").tobytes(),
                         "half": x.astype("<f2").tobytes()})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("dim", pa.int32()),
                                                                 ("unit", pa.binary()), ("half", pa.binary())]))


def trees_for(depth: int, threshold: float) -> int:
    """Trees of a depth in which two vectors at the threshold share a leaf with chance ``MEET``."""
    together = (1 - np.arccos(min(threshold, 1.0)) / np.pi) ** depth
    return 1 if together >= MEET else int(np.ceil(np.log(1 - MEET) / np.log(1 - together)))


def _leaves(batches: Batches, depth: int, trees: int, seed: int) -> Batches:
    """(tree, leaf) of every vector: signs of its products with a tree's hyperplanes."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        packed = batch.column("half").to_pylist()
        for dim in np.unique(dims).tolist():
            if dim not in planes:
                planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, trees * max(depth, 1)))
            here = np.flatnonzero(dims == dim)
            signs = (_matrix([packed[i] for i in here]) @ planes[dim] > 0).reshape(len(here), trees, -1)[:, :, :depth]
            leaf = (signs.astype(np.int64) << np.arange(signs.shape[2])).sum(axis=2)
            yield pa.RecordBatch.from_arrays([
                batch.column("node").take(pa.array(np.repeat(here, trees))), pa.array(np.full(len(here) * trees, dim, np.int32)),
                pa.array(np.tile(np.arange(trees, dtype=np.int32), len(here))), pa.array(leaf.ravel())],
                names=["node", "dim", "tree", "leaf"])


def _best(sims: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries of every row; equal ones by lot, so that rows differ in their choice."""
    k = min(k, sims.shape[1])
    lot = np.random.default_rng(seed % (1 << 63)).random(sims.shape, np.float32) * np.float32(1e-6)
    columns = np.argpartition(-(sims + lot), k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(sims)), k), columns.ravel()


def _leaf_task(batches: Batches, k: int) -> Batches:
    for _, group in groupby(_rows(batches), key=lambda r: (r["dim"], r["tree"], r["leaf"], r["block"])):
        group = list(group)
        if len(group) < 2:
            continue
        nodes, x = np.array([r["node"] for r in group]), _matrix([r["half"] for r in group])
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        i, j = _best(sims, min(k, len(group) - 1), int(nodes[0]))
        yield _edges(nodes[i], nodes[j], sims[i, j])


def _join_task(batches: Batches, most: int) -> Batches:
    """At one vector: compare its neighbours, report what is better than the worst of a list."""
    for _, group in groupby(_rows(batches), key=lambda r: r["w"]):
        group = list(group)
        fresh = np.array([r["fresh"] for r in group])
        if len(group) < 2 or not fresh.any():
            continue
        nodes, x = np.array([r["node"] for r in group]), _matrix([r["half"] for r in group])
        sims = x @ x.T
        useful = (fresh[:, None] | fresh[None, :]) & (sims > np.array([r["worst"] for r in group])[:, None])
        sims = np.where(useful, sims, -2)
        np.fill_diagonal(sims, -2)
        i, j = _best(sims, most, group[0]["w"])
        good = sims[i, j] > -2
        if good.any():
            i, j = i[good], j[good]
            yield _edges(nodes[i], nodes[j], sims[i, j])


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable in a symmetric 0/1 matrix with a full diagonal."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(linked)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _block_task(batches: Batches, threshold: float) -> Batches:
    """Links between two blocks: weighted counts per vector, and a spanning forest."""
    for _, group in groupby(_rows(batches), key=lambda r: (r["comp"], r["left_block"], r["right_block"])):
        group = list(group)
        side = np.array([r["side"] for r in group])
        nodes, weight = np.array([r["node"] for r in group]), np.array([r["weight"] for r in group], np.int64)
        x = _matrix([r["unit"] for r in group], "<f8")
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if group[0]["left_block"] != group[0]["right_block"]:
            linked &= side[:, None] != side[None, :]  # a block with itself is a task of its own
        counts = linked @ weight
        np.fill_diagonal(linked, True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[_roots(linked)], pa.int64()),
                                          pa.array(counts, pa.int64())], names=["node", "root", "n"])


def _bridge_task(batches: Batches, threshold: float) -> Batches:
    """Pairs of components whose representatives in a leaf are linked, as a spanning forest."""
    for _, group in groupby(_rows(batches), key=lambda r: (r["dim"], r["tree"], r["leaf"], r["block"])):
        group = list(group)
        comp, x = np.array([r["comp"] for r in group]), _matrix([r["unit"] for r in group], "<f8")
        root = comp[_roots((x @ x.T >= threshold) | (comp[:, None] == comp[None, :]))]
        other = root != comp
        if other.any():
            yield pa.RecordBatch.from_arrays([pa.array(comp[other], pa.int64()), pa.array(root[other], pa.int64())], names=["a", "b"])


def _audit_task(batches: Batches, asked: list[tuple[int, bytes]], threshold: float) -> Batches:
    """Weighted counts of the links of the asked vectors among all."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for dim in {len(u) for _, u in asked}:
        some = [(n, u) for n, u in asked if len(u) == dim]
        by_dim[dim] = (np.array([n for n, _ in some]), _matrix([u for _, u in some], "<f8"), np.zeros(len(some), np.int64))
    for batch in batches:
        units, nodes, weight = batch.column("unit").to_pylist(), np.asarray(batch.column("node")), np.asarray(batch.column("weight"))
        lengths = np.array([len(u) for u in units])
        for dim, (them, y, n) in by_dim.items():
            here = np.flatnonzero(lengths == dim)
            for at in range(0, len(here), 4096):
                part = here[at:at + 4096]
                linked = (_matrix([units[p] for p in part], "<f8") @ y.T >= threshold) & (nodes[part][:, None] != them[None, :])
                n += weight[part] @ linked
    for them, _, n in by_dim.values():
        yield pa.RecordBatch.from_arrays([pa.array(them, pa.int64()), pa.array(n, pa.int64())], names=["u", "n"])


class NearDuplicates:
    """The search over one table. ``recall`` is the audited share of links found, after ``rounds`` rounds."""

    def __init__(self, vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                 vector_col: str = "embedding"):
        self.threshold = threshold
        self._nodes(vectors, id_col, vector_col)
        self.count = self.nodes.count()
        self._plant()
        lists = None
        for r in range(ROUNDS):
            lists = self._refined(self._initial(lists, seed=r))
            every = self._explicit(lists)
            found = every.where("a >= 0")
            complete = self._complete(lists, found, seed=r)
            seen = self._audit(lists, found, complete[0])
            self.rounds, self.recall = r + 1, min(self._planted_found(lists, every), 1.0 if seen is None else seen)
            if self.recall >= TARGET:
                break
        else:
            raise RuntimeError(f"recall {self.recall:.3f} after {ROUNDS} rounds, below {TARGET}")
        self.lists, self.found = lists, found
        self.members = self._members(*complete)

    def _nodes(self, vectors: DataFrame, id_col: str, vector_col: str) -> None:
        x = F.col("vector")
        sound = (x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)
                                                            & (F.abs(v) < F.lit(float("inf"))))
                 & F.exists(x, lambda v: v != 0))
        rows = stored(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
                      .withColumn("sound", F.coalesce(sound, F.lit(False)))
                      .withColumn("row", F.monotonically_increasing_id()), "nn-vectors")
        same = rows.where("sound").groupBy("vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"))
        same = stored(same, "nn-distinct")
        several = stored(rows.where("sound").select("row", "vector")
                         .join(same.where("weight > 1").select("vector", "node"), "vector").select("row", "node"), "nn-copies")
        self.rows = rows.select("id", "row", "sound").join(small(several, several.count()), "row", "left") \
            .withColumn("node", F.coalesce("node", "row"))
        self.nodes = stored(same.select("node", "weight", "vector").mapInArrow(
            _pack, "node long, weight long, dim int, unit binary, half binary"), "nn-nodes")

    def _plant(self) -> None:
        """``graph``: the nodes and the planted partners, which are at most ``PLANTED`` rows."""
        cosine = min(self.threshold + 0.002, (1 + self.threshold) / 2)
        chosen = self.nodes.where("dim > 1").orderBy(F.xxhash64("node", F.lit(11)), "node").limit(PLANTED)
        self.planted = stored(chosen.select("node", "unit").mapInArrow(
            lambda b: _partners(b, cosine), "node long, weight long, dim int, unit binary, half binary"), "nn-planted")
        self.graph = self.nodes.unionByName(self.planted)

    def _planted_found(self, lists: DataFrame, every: DataFrame) -> float:
        """Share of the planted pairs that were found; a partner with ``K`` links is in a dense place, completed by blocks."""
        met = every.where("a < 0 and b = -1 - a").select("a")
        dense = (lists.where((F.col("u") < 0) & (F.col("sim") >= self.threshold - MARGIN)).groupBy("u")
                 .agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= K).select(F.col("u").alias("a")))
        planted = self.planted.count()
        return met.unionByName(dense).distinct().count() / planted if planted else 1.0

    # --- the graph -------------------------------------------------------------------------------
    def _top(self, edges: DataFrame, k: int = K, large: DataFrame | None = None) -> DataFrame:
        """The best neighbours of every vector; a pair once, fresh only if no older copy is there."""
        once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), F.xxhash64("u", "v"), "v"))
        if large is None:
            return once.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
        ranked = once.join(large.withColumn("_large", F.lit(True)), "u", "left").withColumn("_r", rank)
        return ranked.where(F.col("_r") <= F.when(F.col("_large"), LARGE_K).otherwise(k)).drop("_r", "_large")

    def _placed(self, vectors: DataFrame, count: int, seed: int) -> DataFrame:
        """(dim, tree, leaf, block, node): the leaves of every vector; a large leaf is cut anew in every tree."""
        depth = max(0, int(np.log2(max(1, count) / LEAF)))
        trees = self._trees(depth)
        leaves = vectors.select("node", "dim", "half").mapInArrow(
            lambda b: _leaves(b, depth, trees, seed), "node long, dim int, tree int, leaf long")
        leaves = stored(leaves, "nn-leaves")
        sizes = leaves.groupBy("dim", "tree", "leaf").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        return (leaves.join(sizes, ["dim", "tree", "leaf"])
                .withColumn("block", F.pmod(F.xxhash64("node", "tree", F.lit(seed)), F.ceil(F.col("c") / (4 * LEAF)))))

    def _trees(self, depth: int) -> int:
        return trees_for(depth, self.threshold)

    def _initial(self, lists: DataFrame | None, seed: int) -> DataFrame:
        placed = self._placed(self.graph, self.count, seed)
        keys = ["dim", "tree", "leaf", "block"]
        edges = (placed.join(self.graph.select("node", "half"), "node").repartition(*keys)
                 .sortWithinPartitions(*keys, "node").select(*keys, "node", "half")
                 .mapInArrow(lambda b: _leaf_task(b, K), EDGE).withColumn("fresh", F.lit(True)))
        if lists is not None:
            edges = edges.unionByName(lists)
        return stored(self._top(edges), "nn-lists")

    def _saturated(self, lists: DataFrame, k: int) -> DataFrame:
        return (lists.groupBy("u").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("c"))
                .where((F.col("c") >= k) & (F.col("worst") >= self.threshold - MARGIN)).select("u"))

    def _step(self, lists: DataFrame, k: int, at: DataFrame | None = None, large: DataFrame | None = None) -> DataFrame:
        """One round of neighbours of neighbours, at all vectors or at some."""
        worst = lists.groupBy("u").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("c")).select(
            F.col("u").alias("node"), F.when(F.col("c") >= k, F.col("worst")).otherwise(F.lit(-1.0)).cast("float").alias("worst"))
        both = lists.select(F.col("u").alias("w"), F.col("v").alias("node"), "sim", "fresh").unionByName(
            lists.select(F.col("v").alias("w"), F.col("u").alias("node"), "sim", "fresh"))
        if at is not None:
            both = both.join(at.select(F.col("u").alias("w")), "w", "left_semi")
        order = Window.partitionBy("w").orderBy(F.desc("sim"), F.xxhash64("w", "node"), "node")
        around = (both.groupBy("w", "node").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
                  .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2 * k).drop("_r", "sim"))
        vectors = self.graph.select("node", "half", "dim")
        tasks = (around.join(vectors, "node").join(worst, "node", "left")
                 .withColumn("worst", F.coalesce("worst", F.lit(-1.0).cast("float")))
                 .repartition("w").sortWithinPartitions("w", "node").select("w", "node", "half", "fresh", "worst"))
        most = 3 if at is None else k  # reports per vector and place
        better = tasks.mapInArrow(lambda b: _join_task(b, most), EDGE).withColumn("fresh", F.lit(True))
        old = lists.withColumn("fresh", F.lit(False))
        return stored(self._top(old.unionByName(better), K, large), "nn-lists")

    def _refined(self, lists: DataFrame) -> DataFrame:
        for _ in range(ITERATIONS):
            lists = self._step(lists, K)
        full = stored(self._saturated(lists, K), "nn-saturated")
        if full.isEmpty():
            return lists
        lists = lists.withColumn("fresh", F.lit(True))  # longer lists: all their pairs count anew
        for _ in range(2):
            lists = self._step(lists, LARGE_K, full, full)
        return lists

    # --- links -----------------------------------------------------------------------------------
    def _explicit(self, lists: DataFrame) -> DataFrame:
        """Distinct pairs of the lists that reach the threshold in double precision."""
        likely = lists.where(F.col("sim") >= self.threshold - MARGIN).select(
            F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        unit = self.graph.select("node", "unit")
        both = (likely.join(unit.select(F.col("node").alias("a"), F.col("unit").alias("ua")), "a")
                .join(unit.select(F.col("node").alias("b"), F.col("unit").alias("ub")), "b"))
        threshold = self.threshold

        def verify(batches: Batches) -> Batches:
            for batch in batches:
                x, y = (batch.column(c).to_pylist() for c in ("ua", "ub"))
                good = [float(np.frombuffer(p, "<f8") @ np.frombuffer(q, "<f8")) >= threshold for p, q in zip(x, y, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return stored(both.select("a", "b", "ua", "ub").mapInArrow(verify, "a long, b long"), "nn-links")

    def _dense(self, lists: DataFrame) -> DataFrame:
        """Vectors whose lists hold ``K`` links or more, at any list size: there may be others."""
        links = lists.where((F.col("u") >= 0) & (F.col("sim") >= self.threshold - MARGIN)).groupBy("u").agg(F.count(F.lit(1)).alias("c"))
        return stored(links.where(F.col("c") >= K).select(F.col("u").alias("node")), "nn-dense")

    def _audit(self, lists: DataFrame, found: DataFrame, counts: DataFrame | None = None) -> float | None:
        """Share of the links of a fixed number of vectors that the result counts; None if they have no link."""
        threshold = self.threshold
        if counts is None:
            counts = self._complete(lists, found)[0]
        asked = [(r.node, bytes(r.unit)) for r in self.nodes.orderBy(F.xxhash64("node", F.lit(7)), "node")
                 .limit(AUDIT).select("node", "unit").collect()]
        true = self.nodes.select("node", "weight", "unit").mapInArrow(lambda b: _audit_task(b, asked, threshold), "u long, n long") \
            .groupBy("u").agg(F.sum("n").alias("n")).collect()
        got = {r.node: r.n for r in counts.where(F.col("node").isin([n for n, _ in asked])).collect()}
        links = sum(r.n for r in true)
        return sum(min(r.n, got.get(r.u, 0)) for r in true) / links if links else None

    def _complete(self, lists: DataFrame, found: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """node, n: the weighted links of every vector; a, b: what connects the vectors."""
        dense = self._dense(lists)
        n = dense.count()
        blocks = None
        edges = found
        if n:
            own, bridges = self._bridged(dense, found, seed)
            blocks = self._blocked(own)
            edges = edges.unionByName(bridges).unionByName(blocks.select(F.col("node").alias("a"), F.col("root").alias("b")))
        side = small(dense.select("node", F.lit(True).alias("dense")), n)
        links = (found.join(side.select(F.col("node").alias("a"), F.col("dense").alias("da")), "a", "left")
                 .join(side.select(F.col("node").alias("b"), F.col("dense").alias("db")), "b", "left"))
        weights = self.nodes.select("node", "weight")
        # a pair of dense vectors is counted by its blocks
        listed = links.where(F.col("da").isNull() | F.col("db").isNull()).select("a", "b")
        counts = (listed.unionByName(listed.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .join(weights.select(F.col("node").alias("b"), "weight"), "b").select(F.col("a").alias("node"), F.col("weight").alias("n")))
        if blocks is not None:
            counts = counts.unionByName(blocks.select("node", "n"))
        return stored(counts.groupBy("node").agg(F.sum("n").alias("n")), "nn-counts"), edges

    def _members(self, counts: DataFrame, edges: DataFrame) -> DataFrame:
        comps = stored(components(edges), "nn-components")
        copies = self.nodes.where("weight > 1").select("node", (F.col("weight") - 1).alias("copies"))
        df = (self.rows.join(small(counts, counts.count()), "node", "left")
              .join(copies, "node", "left")
              .join(small(comps.select("node", "component"), comps.count()), "node", "left")
              .withColumn("root", F.coalesce("component", "node"))
              .withColumn("n_links", F.when(F.col("sound"), F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(0)))
                          .otherwise(F.lit(0)).cast("long")))
        groups = df.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("component_id")).where("c > 1")
        groups = stored(groups.select("root", "component_id"), "nn-roots")
        return (df.join(small(groups.withColumn("several", F.lit(True)), groups.count()), "root", "left")
                .withColumn("component_id", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("id")))
                .select("id", "n_links", "component_id"))

    def _bridged(self, dense: DataFrame, found: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
        """(node, comp) of the dense vectors, and (a, b) of the components joined because representatives are linked."""
        threshold = self.threshold
        comps = components(found).select("node", F.col("component").alias("comp"))
        own = stored(dense.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "nn-own")
        bridges = found.limit(0)
        vectors = self.nodes.select("node", "dim", "half", "unit")
        keys = ["dim", "tree", "leaf", "block"]
        for salt in count(1_000 * (seed + 1)):
            drawn = F.xxhash64("node", F.lit(salt))
            reps = stored(own.groupBy("comp", F.pmod(drawn, F.lit(REPRESENTATIVES))).agg(F.min(F.struct(drawn, "node")).alias("least"))
                          .select("comp", F.col("least.node").alias("node")).join(vectors, "node"), "nn-representatives")
            new = stored(self._placed(reps, reps.count(), salt).join(reps.select("node", "comp", "unit"), "node").repartition(*keys)
                         .sortWithinPartitions(*keys, "node").select(*keys, "comp", "unit")
                         .mapInArrow(lambda b: _bridge_task(b, threshold), "a long, b long").distinct(), "nn-bridges")
            if new.isEmpty():
                return own, bridges
            bridges = bridges.unionByName(new)
            joined = components(new).select(F.col("node").alias("comp"), "component")
            own = stored(own.join(joined, "comp", "left").select("node", F.coalesce("component", "comp").alias("comp")), "nn-own")

    def _blocked(self, own: DataFrame) -> DataFrame:
        """node, root, n: links between dense vectors of a component."""
        threshold = self.threshold
        sizes = own.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        dealt = stored(own.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "nn-dealt")
        partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        tasks = dealt.withColumn("other", partner).select(
            "comp", F.least("block", "other").alias("left_block"), F.greatest("block", "other").alias("right_block"),
            (F.col("block") > F.col("other")).cast("int").alias("side"), "node")
        keys = ["comp", "left_block", "right_block"]
        return stored(
            tasks.join(self.nodes.select("node", "weight", "unit"), "node").repartition(*keys)
            .sortWithinPartitions(*keys, "node").select(*keys, "side", "node", "weight", "unit")
            .mapInArrow(lambda b: _block_task(b, threshold), "node long, root long, n long"), "nn-blocks")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """Per vector: id, n_links, component_id, kept."""
    members = NearDuplicates(vectors, threshold, id_col, vector_col).members
    return members.select(F.col("id").alias(id_col), "n_links", "component_id",
                          F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
