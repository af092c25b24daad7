"""Language of pages: text alone, fusion where the text is silent, priors by host, awkward rows."""

import random

import numpy as np
import pytest

from muster.llm import langid, queries

SF = "/root/testdata/sf0.01"
WORDS = {"aa": "kato maru sidelo panti goreva timaso", "bb": "xyqu zwerf brunck thyllg vrask schmunt"}


def text(rnd, lang, n=60):
    return " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture
def model(make_docs):
    rnd = random.Random(1)
    docs = make_docs([(i, text(rnd, lang), lang, "s", 1) for i, lang in enumerate(["aa", "bb"] * 30)]
                     + [(100, None, "aa"), (101, "x", None), (None, "kato", "aa")])
    return langid.train(docs, per_language=20)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_query_on_the_whole_table_agrees_with_the_declared_language(spark):
    got = queries.op5_language_fusion(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    named = [r for r in got if r.declared]
    assert sum(r.lang == r.declared for r in named) >= 0.9 * len(named)
    assert all(0 < r.confidence <= 1 for r in got)


def test_text_model_tells_the_languages(model):
    rnd = random.Random(2)
    for i, lang in enumerate(model.languages):
        assert np.argmax(model.log_likelihoods(text(rnd, lang, 5))) == i
    assert not model.log_likelihoods("123 !?").any()


def test_other_evidence_decides_where_the_text_is_silent(spark, model):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, f"https://h{i % 10}.{'one' if lang == 'aa' else 'two'}.{lang}/p{i}",
                     f"<html lang='{lang}-XX'><body><p>{text(rnd, lang)}</p></body></html>"))
    rows += [(200, "http://h1.one.aa/empty", ""), (201, "https://user@h2.two.bb:80/e", None),
             (202, "http://new.bb", "<p>1 2 3</p>"), (203, None, '<HTML LANG="aa"><p>77</p>'), (204, "no address", "")]
    got = {r.page_id: r for r in langid.identify(pages(spark, rows), model).collect()}
    assert all(got[i].lang == ("aa" if i % 2 else "bb") for i in range(120))
    assert [got[i].lang for i in (200, 201, 202, 203)] == ["aa", "bb", "bb", "aa"]
    assert got[201].host == "h2.two.bb" and got[202].suffix == "bb" and got[203].host == got[204].host == ""
    assert got[200].confidence < got[1].confidence


def test_repeats_empty_tables_and_clashing_columns(spark, model, make_docs):
    row = (1, "http://a.b.aa/", "<p>kato maru sidelo</p>")
    got = langid.identify(pages(spark, [row, row, (None, None, None), (2, "http://a.b.aa/", "kato " * 50_000)]), model)
    assert sorted((r.lang for r in got.collect() if r.page_id), key=str) == ["aa"] * 3 and got.count() == 4
    assert langid.identify(pages(spark, []), model).collect() == []
    clash = spark.createDataFrame([(*row, "x", 1.0)], "page_id long, url string, html string, host string, t0 double")
    assert langid.identify(clash, model).first().host == "a.b.aa"
    with pytest.raises(ValueError):
        langid.train(make_docs([(1, "text", None)]))


def test_hidden_parts_are_not_text(spark, model):
    html = f"<html><script>{WORDS['bb'] * 20}</script><!-- {WORDS['bb']} --><style>x</style><p>{WORDS['aa']}</p></html>"
    assert langid.identify(pages(spark, [(1, "u", html)]), model).first().text_lang == "aa"


def test_every_language_is_learned_from_its_smallest_hashes(spark, make_docs):
    rows = [(i, f"{chr(0x4E00 + 3 * i)}{chr(0x4E01 + 3 * i)}{chr(0x4E02 + 3 * i)} " * 5, f"l{i:02}") for i in range(70)]
    rows += [(1_000 + i, f"word{i} common", "hot") for i in range(3_000)]
    model = langid.train(make_docs(rows), per_language=10)
    assert model.languages == sorted({r[2] for r in rows})
    assert all(np.argmax(model.log_likelihoods(t)) == model.languages.index(lang) for _, t, lang in rows[:70])
    order = {r.id: r.h for r in spark.range(1_000, 4_000).selectExpr("id", "xxhash64(id) AS h").collect()}
    least = sorted(order, key=lambda i: (order[i], i))[:10]
    grams = np.concatenate([langid.trigram_buckets(f"word{i - 1_000} common") for i in least])
    table = 0.5 + np.bincount(grams, minlength=langid.BUCKETS)
    assert np.allclose(model.log_chances[model.languages.index("hot")], np.log(table / table.sum()))
