"""Full-text: postings against token sets, a hot term, plans; token classes by hand-written tokens."""

import os

import pytest
from muster_helpers import SMOKE_DIR

from muster.functions.text import class_tokens, matches_all_class_terms
from muster.operators.fulltext import Postings

DOCS = [(1, "Main hall, state-of-the-art"), (2, "main Hall"), (3, None), (4, ""), (5, "the art of the state"), (6, "hall hall HALL main"),
        (7, "é É main"), (7, "hall")] + [(i, f"common word{i % 3}") for i in range(100, 400)]
QUERIES = [("a", "hall main"), ("b", "state-of-the-art"), ("c", "art state"), ("d", "nothing here"), ("e", ""), ("f", None), ("g", " - "),
           ("h", "common"), ("i", "common word1"), ("j", "É"), ("k", "main hall hall"), ("l", "common missing")]


def tokens(text):
    import re
    low = (text or "").lower()
    return set(re.findall(r"[^\W_]+", low)) | set(re.findall(r"[^\W_]+(?:-[^\W_]+)+", low))


def expected(docs, queries):
    return sorted({(q, d) for q, text in queries for d, body in docs if tokens(text) and tokens(text) <= tokens(body)})


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "id long, body string")
    return Postings.build(docs, "id", "body", str(tmp_path_factory.mktemp("index") / "one"), part_rows=40)


def found(index, spark, queries):
    return sorted((r.query, r.id) for r in index.search(spark.createDataFrame(queries, "q string, terms string"), "q", "terms").collect())


def test_every_query_finds_its_rows(index, spark):
    want = expected(DOCS, QUERIES)
    got = found(index, spark, QUERIES)
    # terms of a repeated id count together, as ids name rows
    assert got == sorted({*want, ("a", 7), ("k", 7)})
    assert len([q for q in got if q[0] == "h"]) == 300


def test_a_hot_term_is_dealt_over_parts(index):
    parts = {r.part for r in index.postings.where("term = 'common'").select("part").distinct().collect()}
    assert len(parts) == 8 and index.terms.where("term = 'common'").first().parts == 8
    assert max(r["count"] for r in index.postings.groupBy("term", "part").count().collect()) < 100


def test_a_search_reads_the_postings_alone(index, spark):
    plan = index.search(spark.createDataFrame(QUERIES, "q string, terms string"), "q", "terms")._jdf.queryExecution().toString()
    paths = {p for p in plan.split() if "one/" in p}
    assert paths and all("one/terms" in p or "one/postings" in p for p in paths)


def test_the_index_is_read_back(index, spark, tmp_path):
    docs = spark.createDataFrame([("x", "one two")], "id string, body string")
    Postings.build(docs, "id", "body", str(tmp_path / "two"))
    again = Postings.open(spark, str(tmp_path / "two"))
    assert found(again, spark, [("q", "TWO one")]) == [("q", "x")]
    empty = Postings.build(docs.limit(0), "id", "body", str(tmp_path / "none"))
    assert found(empty, spark, QUERIES) == []


def test_no_row_of_a_hot_term_is_read_for_a_rare_one(index, spark):
    """The rarest term gives the candidates; a hot one only confirms them."""
    rare = spark.createDataFrame([("q", "hall common"), ("r", "common word1 word2")], "q string, terms string")
    assert index.search(rare, "q", "terms").collect() == []
    assert index.terms.where("term = 'hall'").first().df < index.terms.where("term = 'common'").first().df == 300


def test_candidates_are_not_shuffled(index, spark, monkeypatch):
    """The postings are dealt by id; what comes of queries times rows stays in its task."""
    queries = spark.createDataFrame(QUERIES, "q string, terms string")
    plan = index.search(queries, "q", "terms")._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    dealt = [line for line in final.splitlines() if " Exchange " in line]
    assert len([x for x in dealt if "hashpartitioning(id" in x]) == 1 and not any("query" in x for x in dealt)
    assert "SortMergeJoin" not in final
    want = found(index, spark, QUERIES)
    monkeypatch.setattr("muster.operators.fulltext.BROADCAST_QUERIES", 0)
    assert found(index, spark, QUERIES) == want


def test_a_text_is_cut_once(spark, tmp_path):
    """Both tables are made of the terms of one pass over the texts; a batch gives one row for a term."""
    from pyspark.sql import functions as F
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        cuts.add(1)
        return text.split() if text else None

    docs = spark.createDataFrame(DOCS, "id long, body string").coalesce(1)
    index = Postings.build(docs, "id", "body", str(tmp_path / "once"), tokens=words, part_rows=40)
    assert cuts.value == len(DOCS)
    assert {r.term: (r.n, len(r.ids)) for r in spark.read.parquet(str(tmp_path / "once/blocks")).collect()}["common"] == (300, 300)
    want = sorted({(w, i) for i, text in DOCS for w in set((text or "").split())} | {("hall", 7)})
    assert sorted({(r.term, r.id) for r in index.postings.collect()}) == want
    assert {(r.term, r.df) for r in index.terms.collect()} >= {("common", 300), ("hall", 2), ("Hall", 1)}


def test_candidates_do_not_become_rows(index, spark):
    """What is verified are numbers in a task's memory: the only join of a search is that of postings and asked terms."""
    plan = index.search(spark.createDataFrame(QUERIES, "q string, terms string"), "q", "terms")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "array_contains" not in plan and plan.index("Generate explode(queries") < plan.index("MapInArrow")


@pytest.mark.parametrize("cells,candidates,rows", [(1, 1, 1), (64, 5, 7), (1 << 20, 1 << 16, 1000)])
def test_matching_in_pieces(monkeypatch, cells, candidates, rows):
    """Random ids and queries against sets, whatever the pieces the work is cut in."""
    import random

    import pyarrow as pa

    from muster.operators import fulltext as X
    monkeypatch.setattr(X, "CELLS", cells)
    monkeypatch.setattr(X, "CANDIDATES", candidates)
    rng = random.Random(rows)
    names = [f"t{i}" for i in range(12)]
    queries = [(f"q{i}", rng.sample(names, rng.choice([1, 2, 3, 3, 6]))) for i in range(40)]
    asked, terms = X._Asked.of(pa.table({"query": [q for q, _ in queries], "terms": [t for _, t in queries]}))
    code = {t: i for i, t in enumerate(terms.to_pylist())}
    held = [(i, rng.choices(names, k=rng.randint(1, 20))) for i in [None, "", "a", "b", "é", *(f"x{i:03}" for i in range(60))]]
    rows_of = [{"id": i, "codes": [code[t] for t in ts if t in code]} for i, ts in held]
    batches = [pa.RecordBatch.from_pylist(rows_of[k:k + rows], pa.schema([("id", pa.string()), ("codes", pa.list_(pa.int32()))]))
               for k in range(0, len(held), rows)]
    got = [(q, r["id"]) for b in X._match(iter(batches), asked) for r in b.to_pylist() for q in r["queries"]]
    want = [(q, i) for q, ts in queries for i, has in held if set(ts) <= set(has)]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 100


def test_queries_in_groups(index, spark, monkeypatch):
    want = found(index, spark, QUERIES)
    monkeypatch.setattr("muster.operators.fulltext.BROADCAST_QUERIES", 5)
    assert found(index, spark, QUERIES) == want


def test_compounds_of_any_text(spark):
    """Random texts against the pattern of a compound without what keeps its scan short."""
    import random

    from pyspark.sql import functions as F

    from muster.functions.text import compound_tokens, text_tokens
    rng = random.Random(3)
    parts = ["a", "B", "é", "1", "日", "𝒳", "-", "-", "-", " ", "_", ".", "\n", "\u0301", "--"]
    df = spark.createDataFrame([("".join(rng.choices(parts, k=rng.randint(0, 16))),) for _ in range(3000)] + [(None,)], "t string")
    low = F.lower(F.coalesce("t", F.lit("")))
    plain = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+"), 0)
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), 0)
    wrong = df.where((compound_tokens("t") != plain) | (text_tokens("t") != words))
    assert wrong.count() == 0 and df.where(F.size(plain) > 0).count() > 500


@pytest.mark.parametrize("text,want", [
    ("Mail joe.x@Example.com, now!", ["mail", "joe.x@example.com", "now"]),
    ("see https://www.example.com/a/b.html?x=1 or ftp://example.org",
     ["see", "www.example.com/a/b.html?x=1", "www.example.com", "/a/b.html?x=1", "or", "example.org"]),
    ("host.example.net:8080 up", ["host.example.net:8080", "up"]),
    ("pi is 3.14, -7 or +1 and 1.5e-3", ["pi", "is", "3.14", "-7", "or", "+1", "and", "1.5e-3"]),
    ("release 8.3.0, 10.1.2.3", ["release", "8.3.0", "10.1.2.3"]),
    ("state-of-the-art beta-1x", ["state-of-the-art", "state", "of", "the", "art", "beta-1x", "beta", "1x"]),
    ("room-12", ["room", "-12"]),
    ("/usr/local/bin and src/main.go", ["/usr/local/bin", "and", "src/main.go"]),
    ("<b class='x'>bold</b> a&nbsp;b &#38;", ["bold", "a", "b"]),
    ("3rd ÜBER 日本 foo_bar 42", ["3rd", "über", "日本", "foo", "bar", "42"]),
    ("End. Start... (x)", ["end", "start", "x"]),
    ("", []), (None, []), (" -- ?! ", []),
])
def test_tokens_by_class(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(class_tokens("t").alias("x")).first().x == want


@pytest.mark.parametrize("text,q,want", [
    ("write to ann@mail.example.com", "ann@mail.example.com", True), ("write to ann@mail.example.com", "mail.example.com", False),
    ("write to ann@mail.example.com", "ann", False), ("version 2.0 of", "2.0", True), ("version 2.0.1 of", "2.0", False),
    ("it is -5 outside", "-5", True), ("it is -5 outside", "5", False), ("x", "", False), (None, "x", False),
    ("art of the state", "state-of-the-art", False), ("a state-of-the-art hall", "state hall", True)])
def test_matching_by_class(spark, text, q, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert bool(df.select(matches_all_class_terms("t", q).alias("x")).first().x) is want


@pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no driver test data")
def test_classes_stay_in_the_jvm(spark):
    df = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").where(matches_all_class_terms("text", "2.0"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_plain_class_changes_no_token(spark, monkeypatch):
    """Random texts of the characters that classes turn on, cut with and without the short cut for plain runs."""
    import random

    from muster.functions import text as X
    rng = random.Random(7)
    parts = ["a", "b1", "e5", "1", "2.0", "1e", "com", "é", "日", ".", "-", "_", "@", "/", ":", "://", "+", "~", "<", ">", "&amp;", ";", " ", " ", ",", "\u00a0", "\n"]
    df = spark.createDataFrame([("".join(rng.choices(parts, k=rng.randint(1, 14))),) for _ in range(4000)], "t string").repartition(4)
    got = {r.t: r.x for r in df.select("t", X.class_tokens("t").alias("x")).collect()}
    monkeypatch.setattr(X, "_PLAIN", "(?!)")
    assert got == {r.t: r.x for r in df.select("t", X.class_tokens("t").alias("x")).collect()}


def test_a_text_is_cut_once_for_all_queries(spark):
    from muster.functions.text import matching_class_queries
    texts = ["write to ann@mail.example.com, version 2.0", "2.0.1 of +1", "", None, "license 2.0 or +1"]
    queries = ["2.0", "mail.example.com", "+1", "License 2.0", " - ", "+1 license"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", matching_class_queries("t", queries).alias("q"))
    assert {r.t: r.q for r in got.collect()} == {
        texts[0]: ["2.0"], texts[1]: ["+1"], "": [], None: [], texts[4]: ["2.0", "+1", "License 2.0", "+1 license"]}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
