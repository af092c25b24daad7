"""NN-descent: links and components against brute force; dense groups, copies, audit, awkward rows."""

import numpy as np
import pytest

from muster.llm import nn_descent, queries


def brute(rows, threshold=0.9):
    ids, vectors = [r[0] for r in rows], [r[1] for r in rows]
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = {i: set() for i in range(len(rows))}
    for dim in {len(v) for v, s in zip(vectors, sound, strict=True) if s}:
        here = [i for i in links if sound[i] and len(vectors[i]) == dim]
        x = np.array([vectors[i] for i in here], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                links[here[a]].add(here[b])
    out = []
    for i in links:
        seen, stack = {i}, [i]
        while stack:
            new = links[stack.pop()] - seen
            seen |= new
            stack += new
        out.append((ids[i], len(links[i]), min((ids[j] for j in seen if ids[j] is not None), default=None)))
    return sorted(out, key=repr)


def run(spark, rows, extra="", **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in nn_descent.near_duplicates(df, **options).collect()), key=repr)


def around(rng, centre, n, spread):
    return centre + rng.normal(size=(n, len(centre))) * spread


def as_rows(x, start=0):
    return [(start + i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    parts = [rng.normal(size=(700, 32))]
    parts += [around(rng, rng.normal(size=32), n, 0.05) for n in (2, 2, 3, 12, 30, 70, 150)]
    chain = rng.normal(size=32)
    other = rng.normal(size=32)
    parts += [np.array([chain + t * other for t in np.linspace(0, 1.5, 12)])]
    x = np.concatenate(parts)
    return as_rows(x[rng.permutation(len(x))])


def test_equals_brute_force(spark, vectors):
    assert run(spark, vectors) == brute(vectors)


def test_dense_groups_in_many_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 25)
    monkeypatch.setattr(nn_descent, "LEAF", 20)
    monkeypatch.setattr("muster.llm.words.BROADCAST_ROWS", -1)
    assert run(spark, vectors) == brute(vectors)


def test_a_group_larger_than_a_leaf_stays_one(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "LEAF", 20)
    rng = np.random.default_rng(3)
    rows = as_rows(np.concatenate([around(rng, rng.normal(size=32), 300, 0.02), rng.normal(size=(300, 32))]))
    assert run(spark, rows) == brute(rows)


def test_tight_groups_inside_a_wider_one(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "LEAF", 50)
    rng = np.random.default_rng(4)
    centres = around(rng, rng.normal(size=32), 6, 0.1)
    rows = as_rows(np.concatenate([around(rng, c, 60, 0.001) for c in centres]))
    assert run(spark, rows) == brute(rows)


def test_hubs_of_a_tight_group(spark):
    rng = np.random.default_rng(5)
    rows = as_rows(np.concatenate([around(rng, rng.normal(size=32), 300, 0.005), rng.normal(size=(500, 32))]))
    assert run(spark, rows) == brute(rows)


def test_a_missed_target_is_not_returned(spark, vectors, monkeypatch):
    monkeypatch.setattr(nn_descent, "TARGET", 1.1)  # never reached
    monkeypatch.setattr(nn_descent, "ROUNDS", 2)
    with pytest.raises(RuntimeError, match="recall 1.000 after 2 rounds"):
        run(spark, vectors[::16])


def test_sparse_links_of_many_vectors(spark):
    """40 pairs at cosine 0.91 among 60,000 random vectors: no sampled vector has a link, planted ones tell."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60_000, 64)).astype(np.float32)
    for i in range(40):
        u = x[i] / np.linalg.norm(x[i])
        aside = rng.normal(size=64)
        aside -= (aside @ u) * u
        x[30_000 + i] = 0.91 * u + np.sqrt(1 - 0.91**2) * aside / np.linalg.norm(aside)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    search = nn_descent.NearDuplicates(df)
    linked = {r.id for r in search.members.where("n_links > 0").collect()}
    assert linked <= {*range(40), *range(30_000, 30_040)} and len(linked) >= 0.98 * 80
    assert search.recall >= nn_descent.TARGET


def test_a_failing_audit_starts_another_round(spark, monkeypatch):
    """With one tree too deep for its pairs the planted recall is low; later rounds repair it."""
    rng = np.random.default_rng(10)
    rows = as_rows(rng.normal(size=(3_000, 24)))
    u = np.array(rows[0][1]) / np.linalg.norm(rows[0][1])
    aside = rng.normal(size=24)
    aside -= (aside @ u) * u
    rows.append((5_000, [float(v) for v in np.float32(0.92 * u + np.sqrt(1 - 0.92**2) * aside / np.linalg.norm(aside))]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(nn_descent, "LEAF", 25)
    monkeypatch.setattr(nn_descent, "ITERATIONS", 0)
    monkeypatch.setattr(nn_descent.NearDuplicates, "_trees", lambda self, depth: 3)
    search = nn_descent.NearDuplicates(df)
    assert search.rounds > 1 and search.recall >= nn_descent.TARGET
    got = sorted(((r.id, r.n_links, r.component_id) for r in search.members.collect()), key=repr)
    assert sum(r[1] for r in got) >= 2 and sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in brute(rows))


def test_trees_follow_the_depth():
    together = 1 - np.arccos(0.9) / np.pi
    for depth in (0, 1, 5, 9, 22):
        trees = nn_descent.trees_for(depth, 0.9)
        assert 1 - (1 - together**depth) ** trees >= nn_descent.MEET - 1e-12
    assert nn_descent.trees_for(0, 0.9) == nn_descent.trees_for(30, 1.0) == 1


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op2_nn_descent(spark, sf).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_copies_nulls_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(50)] + [
        (60, [2.0, 4.0, 6.0]), (61, [1.0, 2.0, 3.1]), (62, None), (63, []), (64, [0.0, 0.0, 0.0]), (65, [1.0, None, 3.0]),
        (66, [nan, 1.0, 1.0]), (67, [inf, 1.0, 1.0]), (68, [1.0, 2.0]), (69, [1.0, 2.0]), (70, [-1.0, -2.0, -3.0]),
        (71, [1e30, 2e30, 3e30]), (72, [1e-30, 2e-30, 3e-30]), (60, [2.0, 4.0, 6.0]), (None, [1.0, 2.0, 3.0]), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_one_row_and_clashing_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(7, [1.0, 1.0])]) == [(7, 0, 7)]
    rows = [(1, [1.0, 0.0], "x", 1.0), (2, [1.0, 0.1], "y", 2.0)]
    assert run(spark, rows, ", node string, weight double") == [(1, 1, 1), (2, 1, 1)]


def test_recall_is_audited(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    search = nn_descent.NearDuplicates(df)
    assert search.recall >= nn_descent.TARGET
    withheld = spark.createDataFrame([], "node long, n long")
    assert search._audit(search.lists, search.found, withheld) == 0.0
    assert search._planted_found(search.lists.limit(0), search.found.limit(0)) == 0.0
    lonely = nn_descent.NearDuplicates(spark.createDataFrame(as_rows(np.eye(20)), "vec_id long, embedding array<float>"))
    assert lonely._audit(lonely.lists, lonely.found, withheld) is None and lonely.recall == 1.0
