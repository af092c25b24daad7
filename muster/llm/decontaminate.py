"""Benchmark decontamination by spaced seeds (built-in functions only).

A seed is a fixed mask over neighbouring words: the words at its positions are hashed, the others are
ignored, so a substituted word between them does not hide a passage. Seeds of the documents and of
the benchmark items are joined on the hash; a hit names a diagonal (document position minus item
position). Around every hit diagonal the item's words are compared with the document's: a document is
contaminated if in some stretch of ``STRETCH`` item words at least ``AGREE`` agree, place by place.
The two masks together hit every such stretch, whichever words were substituted (tested by
enumeration). Items of 13 to 19 words may differ in one word, items of 8 to 12 words in none; shorter
items prove nothing and are never reported.

The benchmark side is counted and broadcast only within a bound; beyond it the join shuffles both
sides. Only hits are shuffled otherwise, and only texts with hits are read for comparison.

Defined results: null and empty texts match nothing; one row per document id and item id, so repeated
rows are reported once and equal items each under their own id; an empty table on either side gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import stored
from muster.llm.words import gram_hashes, normalized, small, text_key, word_array

MASKS = ((0, 4, 6, 7, 8), (0, 1, 2, 3, 7))
STRETCH, AGREE = 20, 16
ONE_OFF_WORDS, EXACT_WORDS = 13, 8


def _seeds(words: Column) -> Column:
    """(place, seed) of all masks."""
    return F.concat(*[F.transform(gram_hashes(words, mask, salt),
                                  lambda h, i: F.struct(i.alias("place"), h.alias("seed")))
                      for salt, mask in enumerate(MASKS)])


def _words(df: DataFrame, id_col: str, text_col: str, prefix: str) -> DataFrame:
    return df.select(F.col(id_col).alias(f"{prefix}_id"), text_key(F.col(text_col)).alias(f"{prefix}_key"),
                     word_array(normalized(F.col(text_col))).alias(f"{prefix}_words"))


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (document, item, diagonal) that share a seed."""
    item_seeds = stored(
        items.select("item_id", "item_key", F.explode(_seeds(F.col("item_words"))).alias("s"))
        .select("item_id", "item_key", F.col("s.place").alias("item_place"), F.col("s.seed").alias("seed")),
        "spaced-seeds")
    doc_seeds = (_words(docs, id_col, text_col, "doc")
                 .select("doc_id", "doc_key", F.explode(_seeds(F.col("doc_words"))).alias("s"))
                 .select("doc_id", "doc_key", F.col("s.place").alias("doc_place"), F.col("s.seed").alias("seed")))
    return stored(
        doc_seeds.join(small(item_seeds, item_seeds.count()), "seed")
        .groupBy("doc_id", "doc_key", "item_id", "item_key",
                 (F.col("doc_place") - F.col("item_place")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("hits")), "spaced-hits")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Contaminated texts: doc_id, doc_key (of the text), item_id, agreeing words of the best stretch,
    its length, and the words (start, end exclusive) that passing stretches cover on its diagonal."""
    items = _words(benchmark, item_id_col, item_text_col, "item").distinct() \
        .where(F.size("item_words") >= EXACT_WORDS)
    hits = _hits(docs, items, id_col, text_col)
    n = hits.count()
    met = hits.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")).distinct()
    texts = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
             .withColumn("doc_key", text_key(F.col("text")))
             .join(small(met, n), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_key") == F.col("_key")),
                   "left_semi").dropDuplicates(["doc_id", "doc_key"])
             .select("doc_id", "doc_key", word_array(normalized(F.col("text"))).alias("doc_words")))
    lined_up = hits.withColumnsRenamed({"doc_id": "_id", "doc_key": "_key", "item_id": "_item", "item_key": "_ikey"})
    pairs = (texts.join(small(lined_up, n), F.col("doc_id").eqNullSafe(F.col("_id"))
                        & (F.col("doc_key") == F.col("_key")))
             .join(items, F.col("_item").eqNullSafe(F.col("item_id")) & (F.col("_ikey") == F.col("item_key"))))
    size = F.size("item_words")
    agree = F.transform("item_words", lambda w, j: F.coalesce(
        (F.get(F.col("doc_words"), F.col("diagonal") + j) == w).cast("int"), F.lit(0)))
    counts = F.transform(F.sequence(F.lit(0), F.size("agree") - F.col("stretch")), lambda s: F.aggregate(
        F.slice("agree", s + 1, F.col("stretch")), F.lit(0), lambda a, b: a + b))
    spare = F.when(size >= STRETCH, STRETCH - AGREE).when(size >= ONE_OFF_WORDS, 1).otherwise(0)
    best = (pairs.withColumn("stretch", F.least(size, F.lit(STRETCH)))
            .withColumn("need", F.col("stretch") - spare)
            .select("doc_id", "doc_key", "item_id", "diagonal", "stretch", "need", agree.alias("agree"))
            .withColumn("counts", counts)
            .withColumn("passing", F.filter(F.transform("counts", lambda c, s: F.when(c >= F.col("need"), s)),
                                            lambda s: s.isNotNull()))
            .where(F.size("passing") > 0)
            .select("doc_id", "doc_key", "item_id", F.struct(
                F.array_max("counts").alias("agreeing"), "stretch",
                (-(F.col("diagonal") + F.array_min("passing"))).alias("back"),
                (F.col("diagonal") + F.array_max("passing") + F.col("stretch")).alias("end")).alias("found")))
    return (best.groupBy("doc_id", "doc_key", "item_id").agg(F.max("found").alias("f"))
            .select("doc_id", "doc_key", "item_id", "f.agreeing", "f.stretch", (-F.col("f.back")).alias("start"),
                    "f.end"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **names: str) -> DataFrame:
    """The best match per document id and item id."""
    found = matches(docs, benchmark, id_col, text_col, **names)
    best = found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("agreeing", "stretch", "start", "end")).alias("f"))
    return best.select(F.col("doc_id").alias(id_col), "item_id", "f.*")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          **names: str) -> DataFrame:
    """``docs`` without the rows whose text holds a passage of the benchmark."""
    found = stored(matches(docs, benchmark, id_col, text_col, **names)
                   .select(F.col("doc_id").alias("_leak"), F.col("doc_key").alias("_leak_key")).distinct(), "leaks")
    return docs.join(small(found, found.count()), F.col(id_col).eqNullSafe(F.col("_leak"))
                     & (text_key(F.col(text_col)) == F.col("_leak_key")), "left_anti")
