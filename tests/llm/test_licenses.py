"""License scan: phrase places against a plain scan of the words, spans by planted and edited notices."""

import re

import pytest
from pyspark.sql import functions as F

from muster.llm import licenses, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = [(i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()]
              for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def check(rows, docs):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in docs), key=repr)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op7_license_diagonals(spark, sf).collect()
    check(rows, docs)
    by = {r.doc_id: r for r in rows}
    for doc_id, text in docs:
        if "Licensed under CC BY-NC 4.0" in text:
            assert "cc-by-nc-4.0" in by[doc_id].labels and by[doc_id].score == 1


def test_phrases_next_to_each_other_and_odd_letters(make_docs):
    docs = [(1, "CC BY cc-by;CC\nBY"), (2, "cc by"), (3, "xcc by cc byx"), (4, "cc cc by by"), (5, "mit license mit"),
            (6, "İ MIT LICENSE K apache license"), (7, ""), (8, None), (8, None), (None, "gnu general public license"),
            (9, "é" * 5 + " cc by " + "ß"), (10, "cc by " * 3000)]
    check(licenses.scan(make_docs(docs)).collect(), docs)


def test_edited_notices_are_found_and_look_alikes_are_not(make_docs):
    gpl = dict(licenses.TEMPLATES)["gpl"]
    dropped = " ".join(w for i, w in enumerate(gpl.split()) if i != 12)
    inserted = gpl.replace("modify it", "modify it freely")
    noise = "words that have nothing to do with it " * 30
    docs = [(1, noise + gpl + " " + noise), (2, noise + dropped), (3, inserted + noise), (4, noise),
            (5, "redistribute it and or modify it under other terms of the road " * 3),
            (6, f"{gpl}\n{noise}\n{gpl}")]
    got = {r.doc_id: r for r in licenses.scan(make_docs(docs)).collect()}
    assert all("gpl" in got[i].labels.split(",") for i in (1, 2, 3, 6))
    assert got[4].labels == got[5].labels == "" and got[4].score == 0
    words = len(noise.split())
    assert [(s["first"], s["end"]) for s in got[1].spans] == [(words, words + len(WORD.findall(gpl.lower())))]
    assert len(got[6].spans) == 2 and got[2].score >= 0.8


def test_empty_table_and_clashing_columns(make_docs):
    assert licenses.scan(make_docs([])).collect() == []
    docs = make_docs([(1, "Released under the MIT License.", "en", "s", 3, "x", 9)], ", label string, votes long")
    r = licenses.scan(docs).first()
    assert (r.labels, r.score) == ("mit", 1.0)


def test_plan_has_no_python(spark):
    plan = queries.op7_license_diagonals(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Pandas", "Arrow"))
    assert F is not None
