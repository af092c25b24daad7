"""Secret scan: base spans against Python's matcher, the tests against their formulas, planted strings."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from muster.llm import queries, secrets

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    spans.sort(key=lambda s: (s[1], order.index(s[0])))
    return spans


def check(rows, docs):
    expected = []
    for doc_id, text in docs:
        spans = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(k == kind for k, *_ in spans) for kind in ("assign", "access", "hex")]
        expected.append((doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest()))
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    for r in rows:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = ",".join(":".join(s) for s in spans if s[0] != "random")
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
        assert len(spans) == r.n_assign + r.n_access + r.n_hex + r.n_random
        order = ["assign", "access", "hex", "random"]
        assert spans == sorted(spans, key=lambda s: (int(s[1]), order.index(s[0])))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries.op6_randomness_secrets(spark, sf).collect(), docs)


def fuzz():
    rnd = random.Random(11)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIkey", "apikey", '"', "'", " ", "  ", ":", "=", "==",
            "abcdef", "ab", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef01234567", "deadbeef", "é🙂", "\n",
            "x", ".", "-", "ſ", "K", "paſſword"]
    return [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 30)))) for i in range(400)]


def test_base_spans_on_awkward_texts(make_docs):
    docs = [*fuzz(), (900, None), (901, ""), (902, "token=abcdefg " * 2000), (903, "🙂" * 50 + "token: abcdefgh"),
            (904, "token=x"), (904, "token=x"), (None, "secret = hunter22")]
    check(secrets.scan(make_docs(docs)).collect(), docs)


def plain_battery(v, k):
    n = len(v)
    chi = k / n * sum(v.count(x) ** 2 for x in set(v)) - n
    side = [2 * x >= k for x in v]
    high, runs = sum(side), 1 + sum(a != b for a, b in zip(side, side[1:], strict=False))
    mean_runs = 2 * high * (n - high) / n + 1
    var = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    mean = sum(v) / n
    r = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / sum((x - mean) ** 2 for x in v)
    return chi, (runs - mean_runs) / math.sqrt(var), (r + 1 / n) * math.sqrt(n)


def test_battery_formulas_and_encodings(spark):
    rnd = random.Random(2)
    alphabets = dict(secrets.ALPHABETS)
    strings = [("".join(rnd.choice(a) for _ in range(n)), name) for name, a in alphabets.items() for n in (40, 200)]
    df = spark.createDataFrame([(s,) for s, _ in strings] + [("a" * 30 + "1",), ("ab1é" * 9,)], "token string")
    got = {r.token: r for r in secrets.battery(df).collect()}
    for s, _ in strings:
        r = got[s]
        name = next(n for n, a in secrets.ALPHABETS if set(s) <= set(a))
        assert r.encoding == name
        v = [alphabets[name].index(c) for c in s]
        for a, b in zip((r.chi_squared, r.z_runs, r.z_serial), plain_battery(v, len(alphabets[name])), strict=True):
            assert abs(a - b) < 1e-6
        assert 0 <= r.p_random <= 1 and 0 <= r.p_structured <= 1
    assert got["ab1é" * 9].encoding is None and got["a" * 30 + "1"].p_random < 1e-6


def test_random_strings_are_found_and_structured_ones_are_not(make_docs):
    rnd = random.Random(4)
    a64 = dict(secrets.ALPHABETS)["base64"]
    words = "the quick brown fox jumps over lazy dogs and runs away from small bears".split()
    docs = [(i, f"key {''.join(rnd.choice(a64) for _ in range(48))} end") for i in range(60)]
    docs += [(100 + i, "see " + "_".join(rnd.choice(words) for _ in range(12)) + f"_{i:03d} for more") for i in range(60)]
    docs += [(200, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa111"), (201, "0123456789abcdefghijklmnopqrstuvwxyz0123456789")]
    got = {r.doc_id: r.n_random for r in secrets.scan(make_docs(docs)).collect()}
    assert sum(got[i] for i in range(60)) >= 55
    assert sum(got[i] for i in got if i >= 100) <= 4 and got[200] == got[201] == 0


def test_tokens_with_few_digits_and_after_a_path(make_docs):
    rnd = random.Random(6)
    letters, url = (dict(secrets.ALPHABETS)[a] for a in ("base62", "base64url"))
    plain = ["".join(rnd.choice(letters[:52]) for _ in range(48)) for _ in range(40)]
    mixed = ["".join(rnd.choice(url) for _ in range(22)) + "-" + "".join(rnd.choice(url) for _ in range(25)) for _ in range(40)]
    docs = [(i, f"key {t} end") for i, t in enumerate(plain)] + [(100 + i, f"see a/b/{t} end") for i, t in enumerate(mixed)]
    got = {r.doc_id: r.spans for r in secrets.scan(make_docs(docs)).collect()}
    assert sum("random:4:52" in got[i] for i in range(40)) >= 34
    assert sum("random:8:56" in got[100 + i] for i in range(40)) >= 34


def test_discoveries_follow_benjamini_hochberg(spark):
    rnd = random.Random(8)
    grid = [(0, rnd.randrange(0, 120)) for _ in range(300)] + [(0, rnd.randrange(200, 500)) for _ in range(40)] + [(1, 3)]
    df = spark.createDataFrame(grid, "length_class int, grid int")
    got = {r["_class"]: r.cut for r in secrets.discoveries(df, 0.05).collect()}
    ps = sorted(10 ** (-g / secrets.GRID) for c, g in grid if c == 0)
    passing = [p for i, p in enumerate(ps, 1) if p <= 0.05 * i / len(ps)]
    assert set(got) == {0} and abs(10 ** (-got[0] / secrets.GRID) - max(passing)) < 1e-12


def test_redaction_and_other_columns(make_docs):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = make_docs([(1, f'a token = "{secret}" b {secret} c', "en", "s", 5, "x", 9), (2, "clean", None, None, None, None, 1),
                      (3, None, None, None, None, None, 1), (4, "", None, None, None, None, 1)], ", key string, spans long")
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert out[1].text == 'a [secret]" b [secret] c' and out[1].key == "x" and out[1].spans == 9
    assert (out[2].text, out[3].text, out[4].text) == ("clean", None, "")
    assert out[1].asDict().keys() == set(docs.columns)
    assert secrets.scan(make_docs([])).collect() == [] and secrets.redact(make_docs([])).collect() == []


def test_plan_has_no_python(spark):
    plan = queries.op6_randomness_secrets(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Pandas", "Arrow"))
    assert F is not None
