"""Repeated passages: windows against brute force, forced packing, edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from muster.llm import queries, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i:i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.fixture
def corpus():
    rnd = random.Random(3)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    passage, long = text(60), text(400)
    rows = [(i, text(rnd.randint(0, 120))) for i in range(40)]
    rows += [(100 + i, f"{text(rnd.randint(0, 30))}\t{passage}\n{text(rnd.randint(0, 30))}") for i in range(12)]
    rows += [(200 + i, text(20) + " " + " ".join(passage.split()[i:i + 34 + i % 3])) for i in range(20)]
    rows += [(300, long), (301, long), (302, text(5) + " " + long[:900]), (303, f"{passage} {text(3)} {passage}")]
    rows += [(400, " ".join(["a"] * 90)), (401, " ".join(["a"] * 36)), (402, " ".join(["a"] * 35)), (403, " ".join(["ab", "c"] * 30))]
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, passage), (7, rows[7][1]), (7, rows[7][1]), (504, "x\x0by\x1cz q " + passage)]
    return rows


@pytest.mark.parametrize("width", [35, 6, 2])
def test_equals_brute_force(make_docs, corpus, width):
    assert result(repeats.scan(make_docs(corpus), width)) == brute(corpus, width)


def test_many_chunks_and_shuffled_runs(make_docs, corpus, monkeypatch):
    """Chunks of a few documents, and runs joined instead of broadcast."""
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", -1)
    monkeypatch.setattr("muster.llm.packing.LEAST", 50)
    assert result(repeats.scan(make_docs(corpus).repartition(5))) == brute(corpus, 35)


def test_chunk_answers_echoes():
    """A hash repeated inside a chunk is sent once; the answer reaches all its places."""
    chunk = repeats.Chunk()
    words = np.array([1, 2, 3, 1, 2, 3, 9, 9], np.uint64)
    at = np.arange(6)
    hashes = repeats.rolling(words, 3)
    chunk.add(11, 12, 8, hashes, hashes & np.uint64(0xFFFFFFFF), at, at % 3 == 0)
    batches = list(chunk.packed(5, 3, False))
    sent = sum(len(h) // 4 for h in batches[0].column("hashes").to_pylist())
    assert sent == len(set(hashes.tolist())) == 5
    directory = batches[1].to_pylist()[0]
    assert repeats.unpack(directory["echo"]).tolist() == [3] and repeats.from_planes(directory["first"]).tolist() == [0]


def test_places_round_trip():
    places = np.array([0, 1, 5, 70_000, 70_001, 9_000_000])
    assert repeats.unpack(repeats.pack(places)).tolist() == places.tolist()
    runs = repeats.runs_of(places)
    assert runs == [0, 1, 5, 5, 70_000, 70_001, 9_000_000, 9_000_000]
    assert repeats.places_of(runs).tolist() == places.tolist()


def test_hot_passage_and_long_text(make_docs):
    """A passage in most documents, and a text of 300,000 words that repeats itself once."""
    rnd = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{passage} own{i}") for i in range(800)]
    long = [f"l{rnd.random()}" for _ in range(150_000)]
    rows.append((900, " ".join([*long, "mid", *long])))
    got = {r[0]: r[1:3] for r in result(repeats.scan(make_docs(rows)))}
    assert all(got[i] == (51, 50) for i in range(800))
    assert got[900] == (300_001, 300_000)


def test_remove_keeps_columns(make_docs, corpus, spark):
    docs = make_docs([(*r, "en", "s", 1, "x") for r in corpus], ", __k1 string").withColumnRenamed("source", "runs")
    out = repeats.remove(docs)
    assert out.columns == docs.columns
    want = {(d, h) for d, _, _, h in brute(corpus, 35)}
    rows = out.collect()
    assert len(rows) == len(corpus)
    assert {(r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in rows} == want
    assert [r.text for r in rows if r.doc_id == 500] == [None]
    assert [r.text for r in rows if r.doc_id == 502] == [" \t\n"]


def test_empty_table(make_docs):
    assert repeats.scan(make_docs([])).collect() == []


def test_query_on_whole_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(queries.op12_repeated_passages(spark, "/root/testdata/sf0.001")) == brute(rows, 35)
