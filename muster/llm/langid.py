"""Language of web pages by Bayesian fusion of four kinds of evidence.

* Text: character trigrams of the visible text, hashed, under one multinomial model per language.
  Trigrams of running text are not independent, so a text counts as at most ``TEXT_GRAMS`` of them.
* The declared language of the markup: P(declared | language).
* The suffix of the address (its last label): P(suffix | language).
* The host: a prior P(language | host), smoothed towards the registered domain, and that towards all
  pages, by pseudo-counts; a page's own share is taken out of the counts first.

The text models are learned from a sample of ``per_language`` documents of each language, whatever their number. All other
tables come from grouped aggregations over all pages of the text posteriors (soft counts), with
partial aggregation, so a host with a third of the pages is one row per task in the shuffle. Joined
tables have one row per value and are broadcast only if counted small.

Defined results: null, empty and tagless pages carry no text evidence; a null or unparsable address
has no suffix and no host and takes the prior of all pages; a missing declaration is a value of its
own; ties go to the first language in alphabetical order; repeated rows give one result row each; an
empty table gives an empty result; without labelled documents there is no model (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import stored
from muster.llm.words import small

BUCKETS = 1 << 14
PER_LANGUAGE = 1_500
SPARE = 4  # times as many ids as needed go to the choice of a sample
TEXT_GRAMS = 40
PSEUDO_ROWS = 10.0  # weight of the parent level

# Parts of a page that are not its running text.
HIDDEN = r"(?is)<!--.*?-->|<(script|style|noscript|template|nav|head)\b.*?</\1\s*>|<[^>]*>|&[a-z#0-9]+;"
DECLARED = r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b"""
HOST = r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:\s]+)"


def trigram_buckets(text: str) -> np.ndarray:
    """Hashed trigrams of the letters of a text; everything else is one blank."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    codes = np.array([ord(c) for c in " " + " ".join(letters.split()) + " "], np.uint64)
    if len(codes) < 4:
        return np.zeros(0, np.int64)
    h = (codes[:-2] * np.uint64(1_000_003) + codes[1:-1]) * np.uint64(1_000_003) + codes[2:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    log_chances: np.ndarray  # languages x buckets

    def log_likelihoods(self, text: str) -> np.ndarray:
        grams = trigram_buckets(text)
        if not len(grams):
            return np.zeros(len(self.languages))
        return self.log_chances[:, grams].mean(axis=1) * min(len(grams), TEXT_GRAMS)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          per_language: int = PER_LANGUAGE) -> TextModel:
    """Trigram counts of a bounded sample: of every language, the ``per_language`` ids of smallest hash.

    Hashes beyond a cut, set from the language's number of ids, can't be among them and are left out
    first, so the choice reads some ``SPARE`` times ``per_language`` ids of a language, however common."""
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("language"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    common = stored(named.groupBy("language").agg(F.approx_count_distinct("id").alias("ids")), "lang-languages")
    languages = sorted(r.language for r in common.select("language").collect())
    if not languages:
        raise ValueError("no document names its language")
    nth = Window.partitionBy("language").orderBy("order", "id")
    place = F.col("order") / F.lit(2.0**64) + 0.5  # of a hash among all hashes, 0 to 1
    chosen = (named.select("language", "id", F.xxhash64("id").alias("order"))
              .join(small(common, len(languages)), "language")
              .where(place * F.col("ids") <= SPARE * per_language + 100).select("language", "id", "order").distinct()
              .withColumn("n", F.row_number().over(nth)).where(F.col("n") <= per_language).select("language", "id"))
    chosen = stored(chosen, "lang-sample")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for language, text in zip(pdf["language"], pdf["text"], strict=True):
                totals.setdefault(language, np.zeros(BUCKETS, np.int64))
                totals[language] += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        for language, counts in totals.items():
            found = np.flatnonzero(counts)
            yield pd.DataFrame({"language": language, "bucket": found, "n": counts[found]})

    sample = named.join(small(chosen, chosen.count()), ["language", "id"], "left_semi").select("language", "text")
    counts = (sample.mapInPandas(counted, "language string, bucket int, n long")
              .groupBy("language", "bucket").agg(F.sum("n").alias("n")).collect())
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in counts:
        table[languages.index(r.language), r.bucket] += r.n
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def page_evidence(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """id, declared, suffix, domain, host, and one log-likelihood ``t<i>`` per language."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit(""))), HOST, 1)
    labels = F.split(host, r"\.")

    @F.pandas_udf("array<double>")
    def likelihoods(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.log_likelihoods(t).tolist() for t in texts])

    named = F.contains(host, F.lit(".")) & F.rlike(host, F.lit(r"[a-z]$"))
    rows = pages.select(
        F.col(id_col).alias("id"), F.lower(F.regexp_extract(html, DECLARED, 1)).alias("declared"),
        F.when(named, F.element_at(labels, -1)).otherwise("").alias("suffix"),
        F.when(named, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host).alias("domain"), host.alias("host"),
        likelihoods(F.regexp_replace(html, HIDDEN, " ")).alias("t"))
    return rows.select("id", "declared", "suffix", "domain", "host",
                       *[F.element_at("t", i + 1).alias(f"t{i}") for i in range(len(model.languages))])


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    total = sum((F.exp(x - top) for x in logs), F.lit(0.0))
    return [F.exp(x - top) / total for x in logs]


def fuse(evidence: DataFrame, languages: list[str], pseudo_rows: float = PSEUDO_ROWS) -> DataFrame:
    """id, lang, confidence, text_lang, declared, suffix, host from the table of :func:`page_evidence`."""
    n = range(len(languages))
    soft = evidence.withColumns({f"r{i}": p for i, p in zip(n, _softmax([F.col(f"t{i}") for i in n]), strict=True)})

    def counts(keys: list[str], prefix: str) -> DataFrame:
        grouped = soft.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(f"{prefix}_n"),
                                          *[F.sum(f"r{i}").alias(f"{prefix}{i}") for i in n])
        return grouped.withColumnsRenamed({k: f"{prefix}_{k}" for k in keys})

    def attach(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        found = stored(counts(keys, prefix), f"lang-{prefix}")
        on = [F.col(k) == F.col(f"{prefix}_{k}") for k in keys]
        return df.join(small(found, found.count()), on).drop(*[f"{prefix}_{k}" for k in keys])

    overall = soft.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"r{i}").alias(f"c{i}") for i in n]).first()
    rows, total = overall.n, [overall[f"c{i}"] or 0.0 for i in n]
    df = soft
    for key, prefix in ((["declared"], "d"), (["suffix"], "s"), (["domain"], "m"), (["host"], "h")):
        df = attach(df, key, prefix)

    logs = []
    for i in n:
        own = F.col(f"r{i}")
        whole = (F.lit(total[i]) - own + 1) / F.lit(rows - 1.0 + len(languages))
        domain = (F.col(f"m{i}") - own + pseudo_rows * whole) / (F.col("m_n") - 1 + pseudo_rows)
        host = (F.col(f"h{i}") - own + pseudo_rows * domain) / (F.col("h_n") - 1 + pseudo_rows)
        prior = F.when(F.col("host") == "", whole).otherwise(host)

        def value_chance(prefix: str, i: int = i) -> Column:
            # P(value | language), smoothed towards the value's share of all pages
            return (F.col(f"{prefix}{i}") + pseudo_rows * F.col(f"{prefix}_n") / max(rows, 1)) / (total[i] + pseudo_rows)

        logs.append(F.col(f"t{i}") + F.log(value_chance("d")) + F.log(value_chance("s"))
                    + F.log(F.greatest(prior, F.lit(1e-12))))

    def argmax(values: list[Column]) -> Column:
        best = F.array_max(F.array(*values))
        return F.element_at(F.array(*map(F.lit, languages)), F.array_position(F.array(*values), best).cast("int"))

    df = df.withColumns({f"p{i}": p for i, p in zip(n, _softmax(logs), strict=True)})
    return df.select("id", argmax([F.col(f"p{i}") for i in n]).alias("lang"),
                     F.array_max(F.array(*[F.col(f"p{i}") for i in n])).alias("confidence"),
                     argmax([F.col(f"t{i}") for i in n]).alias("text_lang"), "declared", "suffix", "host")


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """One row per page. Markup and text are read once, into a narrow table of evidence."""
    evidence = stored(page_evidence(pages, model, id_col, url_col, html_col), "lang-evidence")
    return fuse(evidence, model.languages).withColumnRenamed("id", id_col)
