"""Spelling variants: near words, forms and roots against brute force, long words, edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from muster.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            count[run if h % 97 else run[:at] + run[at + 1:]] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows):
    words = words_of(rows)
    by_rest = {}
    for w in words:
        for key in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by_rest.setdefault(key, set()).add(w)
    close = {w: set() for w in words}
    for group in by_rest.values():
        for a in group:
            close[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), None if form[w] is None else words[form[w]]))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


@pytest.fixture
def corpus():
    rnd = random.Random(6)
    letters = "abcé×ÿ"

    def edit(w):
        i, kind = rnd.randrange(len(w)), rnd.randrange(3)
        return w[:i] + (rnd.choice(letters) if kind else "") + w[i + (kind < 2):]

    base = ["".join(rnd.choice(letters) for _ in range(rnd.choice([5, 5, 6, 7, 9, 14]))) for _ in range(40)]
    base += ["aaaaa", "aaaaaa", "aaaaaaaaa", "aabaa"]
    long = ["".join(rnd.choice(letters) for _ in range(n)) for n in (31, 32, 33, 34, 60, 400)] + ["a" * 32, "a" * 33, "b" * 70]
    base += long + [edit(w) for w in base + long * 4] + [edit(edit(w)) for w in base]
    rows = []
    for i in range(60):
        picked = [w for w in rnd.choices(base, k=60) if w] + rnd.choices(base[:8], k=20)
        rows.append((i, ", ".join(w.upper() if rnd.random() < .2 and w.isascii() else w for w in picked) + " ıİ日本 short"))
    return rows + [(None, None), (70, ""), (71, " 12 _"), rows[0], (None, " ".join(base[:20])), (72, "q" * 2000 + " " + "q" * 2001)] \
        + [(73 + i, "q" * 2000 + " " + "q" * 2001) for i in range(3)]


def test_equals_brute_force(make_docs, corpus):
    got, want = result(spelling.group(make_docs(corpus))), brute(corpus)
    assert got == want
    assert any(w[1] for w in want) and any(len(w[0]) > 32 and w[4] for w in want)


def test_chain_of_forms(make_docs):
    """Each word's form has twice as many occurrences: the root is the end of the chain."""
    chain = ["zaaaaa", "zbaaaa", "zbbaaa", "zbbbaa", "zbbbba"]
    rows = [(1000 * i, " ".join([w] * (3 * 2 ** i))) for i, w in enumerate(chain)]
    rows = [(next(d for d in range(i, i + 999) if zlib.crc32(f"{d}:{chain[i // 1000]}".encode()) % 97), t) for i, t in rows]
    got = {r[0]: r for r in result(spelling.group(make_docs(rows)))}
    assert [got[w][2] for w in chain] == [chain[-1]] * 5 and got[chain[0]][1] == chain[1]
    assert result(spelling.group(make_docs(rows))) == brute(rows)


def test_ties_go_to_the_smaller_word(make_docs):
    rows = [(i, "mmmmm mmmmn mmmmo") for i in range(3)] + [(i, "mmmmn mmmmo") for i in range(10, 20)]
    assert result(spelling.group(make_docs(rows))) == brute(rows)


def test_extra_columns_and_string_ids(spark):
    rows = [("d1", "Hello hello hellp hellp hellp HELLO", "x", 1)] * 4
    df = spark.createDataFrame(rows, "doc_id string, text string, word string, n int")
    assert result(spelling.group(df)) == brute([(r[0], r[1]) for r in rows])


def test_empty_tables(make_docs):
    assert spelling.group(make_docs([])).collect() == []
    assert spelling.group(make_docs([(1, "only once here")])).collect() == []


def test_query_on_whole_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(queries.op13_spelling_variants(spark, "/root/testdata/sf0.001")) == brute(rows)
