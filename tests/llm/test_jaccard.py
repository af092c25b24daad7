"""Jaccard join: components against brute force over all pairs, the trees' bound, forced splits."""

import random
import re

import numpy as np
import pytest

from muster.llm import jaccard as j
from muster.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text, k):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for h in holders.values() if len(h) < 200 for x, a in enumerate(h) for b in h[x + 1:]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(df, k, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.link(df, k, percent).collect()), key=repr)


@pytest.fixture
def family():
    """Copies, near copies in chains, a shared passage, and strangers."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(rnd.choice(words) for _ in range(25))
    rows = []
    for base in range(12):
        text = [rnd.choice(words) for _ in range(rnd.randrange(4, 120))]
        for _ in range(rnd.randrange(1, 9)):
            text = list(text)
            for _ in range(rnd.randrange(0, 4)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((len(rows), (common + " " if base % 2 else "") + " ".join(text)))
    rows += [(len(rows) + i, t) for i, t in enumerate(
        ["", None, " \n", "one", "One", "two words", "TWO  words", "É a b c", "é a b c", "x " * 3000, "x " * 3000 + "y"])]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, "null id"), (None, "null id"), rows[7], rows[7]]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_equals_brute_force(make_docs, family, k, percent):
    assert run(make_docs(family), k, percent) == brute(family, k, percent)


def test_split_units_shuffled_joins_and_small_chunks(make_docs, family, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 2)
    monkeypatch.setattr("muster.llm.packing.LEAST", 200)
    monkeypatch.setattr("muster.llm.words.BROADCAST_ROWS", -1)
    assert run(make_docs(family), 4, 85) == brute(family, 4, 85)


def test_grams_to_meet_by_are_the_rarest(spark, make_docs):
    """A document of its own grams alone meets nobody; a near copy meets by grams that few share."""
    common = "a b c d e f g h i j"
    rows = [(i, common + " " + " ".join(f"u{i}.{x}" for x in range(30))) for i in range(20)]
    rows += [(50, "k l m n o p q r s t u v w x y z"), (51, "k l m n o p q r s t u v w x y zz"), (52, common)]
    join = j.JaccardJoin(make_docs(rows), 4, 85)
    chosen = {r.id: len(r.prefix) for r in join.described.collect()}
    assert all(chosen[i] == 0 for i in range(20))  # 30 of 37 grams are their own
    assert chosen[50] == chosen[51] == 1  # two of thirteen may differ: one gram of its own, one shared
    assert chosen[52] == 2 and join.described.where("size(prefix) > 0").count() == 3
    assert run(make_docs(rows), 4, 85) == brute(rows, 4, 85)


def test_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = queries.op4_signature_trees(spark, "/root/testdata/sf0.01").collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 4, 85)


def test_trees_keep_every_pair_that_reaches_the_threshold():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            keep = base[rng.random(len(base)) > 0.08]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, 3).astype(np.uint64)])))
    tree = j.SignatureTree([len(s) for s in sets], [j.signature(s) for s in sets], range(len(sets)))
    found = {tuple(sorted(p)) for a, b, _ in tree.pairs(85) for p in zip(a.tolist(), b.tolist(), strict=True)}
    true = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert true and true <= found and len(found) < 3 * len(true) + 40
    half = len(sets) // 2
    sides = [j.SignatureTree([len(s) for s in x], [j.signature(s) for s in x], [-i for i in range(len(x))])
             for x in (sets[:half], sets[half:])]
    across = {(a, b + half) for i, k, _ in sides[0].pairs(85, sides[1]) for a, b in zip(i.tolist(), k.tolist(), strict=True)}
    assert {p for p in true if p[0] < half <= p[1] and p != (0, half)} <= across | {(0, half)}


def test_one_document_of_each_group_stays(make_docs, family, spark):
    docs = make_docs([(*r, "en", "s", 1, "x", 2) for r in family], ", key string, row long")
    kept = j.deduplicate(docs, 4, 85)
    assert kept.columns == docs.columns
    expected = brute(family, 4, 85)
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    sizes = {d: n for d, n, _ in expected}
    assert {d for d, n, c in expected if d is not None and (d == c or n == 0)} == {d for d in got if d is not None}
    assert sizes and got.count(None) == 1  # "null id" once; the other joins a numbered document
    assert j.deduplicate(make_docs([]), 4, 85).collect() == [] and j.link(make_docs([])).collect() == []
