"""Source divergence: pair sums and term ranks against brute force, tree work, edge cases."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from muster.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, ranks=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lower(text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]

        def freq(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: freq(counts[lang, s]) for s in sources}
        q = freq(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(r, sum(abs(p[s][t] - p[r][t]) for t in kept)) for r in sources if r != s]
            over = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", over)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < ranks]
    return sorted(out)


def result(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


@pytest.fixture
def corpus():
    rnd = random.Random(4)
    vocab = [f"{a}{b}" for a in ("ba", "Ka", "né", "ço", "日") for b in ("la", "ri", "TO", "ß", "x")]
    rows = [(" ".join(rnd.choice(vocab[:5 + 4 * (i % 5)]) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de", None]),
             rnd.choice(["hot", "hot", "a", "b", "ü", None])) for i in range(120)]
    rows += [(None, "en", "only null"), ("", "xx", "a"), ("", "xx", "b"), ("7_[]{} 1-2", None, "c"), (rows[0]), (rows[0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, place string")


@pytest.mark.parametrize("least", [1, 6, 1000])
def test_equals_brute_force(spark, corpus, least):
    assert result(divergence.audit(frame(spark, corpus), least)) == brute(corpus, least)


def test_small_holdings(spark, corpus, monkeypatch):
    """Tasks that hand on their counts and sums early give the same sums."""
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 2)
    counted = list(divergence._count_terms(iter([pa.record_batch(
        {"text": pa.array([t or ""]), "lang": pa.array([lang or ""]), "source": pa.array([s or ""])}) for t, lang, s in corpus])))
    assert len(counted) > 20
    total = Counter()
    for batch in counted:
        for r in batch.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter((lang or "", s or "", t) for text, lang, s in corpus for t in TERM.findall(lower(text or "")))
    assert {k: n for k, n in total.items() if n} == dict(want)
    assert result(divergence.audit(frame(spark, corpus).repartition(7), 2)) == brute(corpus, 2)


def test_shared_paths_are_walked_once():
    """Rows of one path are one walk with a multiplicity; a node's parent gets it."""
    path = [{"place": i, "n": i + 1, "p": 100 * i + 7, "z": 5 + i} for i in range(3)]
    other = [path[0], {"place": 2, "n": 9, "p": 900, "z": 7}]

    def walk(rows):
        batch = pa.RecordBatch.from_pylist([{"lang": "en", "path": p, "m": m} for p, m in rows], schema=pa.schema([
            ("lang", pa.string()), ("m", pa.int64()),
            ("path", pa.list_(pa.struct([(k, pa.int64()) for k in ("place", "n", "p", "z")])))]))
        return {(r["a"], r["b"]): r["value"] for out in divergence._walk(iter([batch])) for r in out.to_pylist()}

    def correction(x, y):
        return abs(x["p"] - y["p"]) - abs(x["p"] - y["z"]) - abs(x["z"] - y["p"]) + abs(x["z"] - y["z"])

    got = walk([(path, 4), (other, 3)])
    assert got == {k: v for k, v in {(1, 0): 4 * correction(path[1], path[0]), (2, 1): 4 * correction(path[2], path[1]),
                                     (2, 0): 4 * correction(path[2], path[0]) + 3 * correction(other[1], path[0])}.items() if v}


def test_long_text_is_split_at_spaces():
    raw = (b"abc " * 1000).translate(divergence._LETTERS)
    parts = list(divergence.pieces(raw, 100))
    assert len(parts) > 10 and b"".join(parts) == raw and sum(len(p.split()) for p in parts) == 1000
    assert list(divergence.pieces(b"x" * 500, 100)) == [b"x" * 500] and list(divergence.pieces(b"")) == []


def test_large_counts_stay_exact(spark):
    n, total = 9_000_000_000_123, 77_000_000_000_001
    from pyspark.sql import functions as F
    row = spark.range(1).select(divergence.scaled(F.lit(n), F.lit(total), F.lit(40)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 5) // (total + 200)


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def test_query_on_whole_table(spark, documents):
    rows = [tuple(r) for r in documents.select("text", "lang", "source").collect()]
    assert result(queries.op11_source_divergence(spark, "/root/testdata/sf0.001")) == brute(rows, 30)
