"""Spaced seeds: the masks' guarantee, a brute-force comparison, planted passages with substitutions."""

import random
import re
from itertools import combinations

import pytest

from muster.llm import decontaminate as d
from muster.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def survives(agree):
    return any(all(agree[s + o] for o in mask) for mask in d.MASKS for s in range(len(agree) - mask[-1]))


def test_masks_hit_every_passing_stretch():
    for bad in combinations(range(d.STRETCH), d.STRETCH - d.AGREE):
        assert survives([i not in bad for i in range(d.STRETCH)])
    for n in range(d.ONE_OFF_WORDS, d.STRETCH):
        assert all(survives([i != bad for i in range(n)]) for bad in range(n))
    assert all(survives([True] * n) for n in range(d.EXACT_WORDS, d.ONE_OFF_WORDS))


def brute(docs, items):
    def words(t):
        return WORD.findall((t or "").lower())
    out = {}
    for doc_id, text in docs:
        w = words(text)
        for item_id, item in items:
            v = words(item)
            n = min(len(v), d.STRETCH)
            if n < d.EXACT_WORDS:
                continue
            need = n - (d.STRETCH - d.AGREE if len(v) >= d.STRETCH else 1 if len(v) >= d.ONE_OFF_WORDS else 0)
            for diagonal in range(-len(v), len(w)):
                agree = [0 <= diagonal + j < len(w) and w[diagonal + j] == v[j] for j in range(len(v))]
                best = max(sum(agree[s:s + n]) for s in range(len(v) - n + 1))
                if best >= need:
                    out[doc_id, item_id] = max(best, out.get((doc_id, item_id), 0))
    return out


def plant(rnd, words, rate):
    return [w if rnd.random() > rate else f"sub{rnd.randrange(10**6)}" for w in words]


@pytest.fixture
def planted():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 30
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(n))) for i, n in enumerate([7, 8, 12, 13, 19, 20, 35, 60, 60])]
    docs = []
    for i in range(60):
        body = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 80))]
        if i % 3:
            item = plant(rnd, items[i % len(items)][1].split(), rnd.choice([0, 0.1, 0.2, 0.3]))
            cut = rnd.randrange(3)
            body += (item, item[len(item) // 3:], item[:len(item) * 2 // 3])[cut] + body
        docs.append((i, " ".join(body)))
    return docs, items


def test_equals_brute_force(spark, make_docs, planted):
    docs, items = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in d.overlaps(make_docs(docs), bench).collect()}
    expected = brute(docs, items)
    assert {k: r.agreeing for k, r in got.items()} == expected and len(expected) > 10
    text = dict(docs)
    for (doc_id, _), r in got.items():
        assert 0 <= r.start and r.end <= len(text[doc_id].split()) and r.end - r.start >= r.stretch
    flagged = {k[0] for k in expected}
    assert {r.doc_id for r in d.clean(make_docs(docs), bench).collect()} == {i for i, _ in docs} - flagged


def test_shuffled_join_gives_the_same(spark, make_docs, planted, monkeypatch):
    docs, items = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr("muster.llm.words.BROADCAST_ROWS", -1)
    got = {(r.doc_id, r.item_id): r.agreeing for r in d.overlaps(make_docs(docs), bench).collect()}
    assert got == brute(docs, items)


def test_query_finds_the_passages_of_the_table(spark, documents):
    sf = "/root/testdata/sf0.001"
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op8_spaced_seeds(spark, sf).collect()}
    whole = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if t in r.text}
    assert whole and whole <= got


def test_nulls_repeats_empty_tables_and_clashing_columns(spark, make_docs):
    item = " ".join(f"word{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item), (3, None), (4, "")],
                                  "item_id long, text string")
    rows = [(1, f"x {item} y"), (1, f"x {item} y"), (None, item), (None, None), (2, ""), (3, "long " * 30000 + item)]
    got = sorted(((r.doc_id, r.item_id) for r in d.overlaps(make_docs(rows), bench).collect()), key=repr)
    assert got == sorted(((a, b) for a in (1, None, 3) for b in (1, 2, None)), key=repr)
    kept = d.clean(make_docs(rows), bench).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(2, "")] and len(kept) == 2
    assert d.overlaps(make_docs([]), bench).collect() == []
    assert d.overlaps(make_docs(rows), bench.limit(0)).collect() == []
    clash = make_docs([(1, item, "en", "s", 3, "x", 9)], ", item_id string, diagonal long")
    assert d.overlaps(clash, bench).count() == 3


def test_plan_has_no_python(spark):
    plan = queries.op8_spaced_seeds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Pandas", "Arrow"))
