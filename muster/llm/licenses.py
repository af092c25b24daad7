"""License scan by diagonal voting (built-in functions only).

All rolling word k-grams of the documents are hashed and joined to the positions of the same k-grams
in license templates. A match votes for its diagonal, document position minus template position;
votes are added up per document, template and diagonal; diagonals at most ``DRIFT`` apart are merged,
so an inserted or missing word does not split a text. A merged run with votes from at least half of
the template's k-grams becomes a span, and the span's words are compared with the template's: it
stands if the words in common are at least ``COVER`` of the larger of the two.

Beside the method's labels, the places of fixed phrases are counted exactly.

The template side is constant in size and broadcast. Only matches are shuffled, one row per
(document, template, diagonal) after voting, and only texts with candidate spans are read again.

Defined results: null and empty texts have no words, no labels (empty strings) and score 0; repeated
rows give one result row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.common import stored
from muster.llm.words import gram_hashes, normalized, small, text_key, word_array

# Phrases and the labels they stand for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Public license notices, as (label, text).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

GRAM = 4
DRIFT = 3
VOTES = 0.5
COVER = 0.8


def _templates(spark: SparkSession, templates) -> DataFrame:
    """template, label, words, grams: a constant table."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"))
                     for i, (label, text) in enumerate(templates)])
    return (spark.range(1).select(F.explode(rows).alias("t"))
            .select("t.template", "t.label", word_array(normalized(F.col("t.text"))).alias("template_words"))
            .where(F.size("template_words") >= GRAM))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                       normalized(F.col(text_col)).alias("norm"))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(norm: Column, n_words: Column, phrases=PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word, base_labels of normalised text; ``n_words`` is its length.

    Every place is cut at the space before it, so the words on either side give its number.
    """
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        here = F.contains(padded, F.lit(f" {phrase} "))
        cut = F.split(padded, f" (?={phrase} )")
        places.append(F.when(here, F.size(cut) - 1).otherwise(0))
        firsts.append(F.when(here, _spaces(F.element_at(cut, 1))))
        lasts.append(F.when(here, n_words - _spaces(F.element_at(cut, -1))))
        labels.append(F.when(here, F.lit(label)))
    found = F.filter(F.array(*labels), lambda x: x.isNotNull())
    return {"n_base": reduce(lambda a, b: a + b, places).cast("long"),
            "first_word": F.array_min(F.array(*firsts)).cast("long"),
            "last_word": F.array_max(F.array(*lasts)).cast("long"),
            "base_label_list": F.array_sort(F.array_distinct(found))}


def spans(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: id, key (of the text), label, first word, end (exclusive), likeness."""
    known = _templates(docs.sparkSession, templates)
    template_grams = known.select(
        "template", F.size("template_words").alias("template_size"),
        F.posexplode(gram_hashes(F.col("template_words"), tuple(range(GRAM)))).alias("template_place", "gram"))
    rows = _rows(docs, id_col, text_col)
    # the words are a column of their own: inside the lambda they would be split again for every place
    grams = (rows.select("id", "key", word_array(F.col("norm")).alias("words"))
             .select("id", "key", F.posexplode(gram_hashes(F.col("words"), tuple(range(GRAM)))).alias("place", "gram")))
    votes = (grams.join(F.broadcast(template_grams), "gram")  # a constant table
             .groupBy("id", "key", "template", "template_size", (F.col("place") - F.col("template_place")).alias("diagonal"))
             # repeated rows vote for the same places; a place counts once
             .agg(F.min("place").alias("first"), F.max("place").alias("last"),
                  F.array_size(F.collect_set("place")).alias("votes")))
    order = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(False))
    candidates = stored(
        votes.withColumn("run", F.sum(apart.cast("int")).over(order))
        .groupBy("id", "key", "template", "template_size", "run")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + GRAM).alias("end"))
        .where(F.col("votes") >= VOTES * (F.col("template_size") - GRAM + 1))
        .select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("template").alias("_template"), "first", "end"),
        "license-candidates")
    n = candidates.count()
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .withColumn("key", text_key(F.col("text")))
             .join(small(candidates.select("_id", "_key").distinct(), n), same, "left_semi")
             .dropDuplicates(["id", "key"])
             .select("id", "key", word_array(normalized(F.col("text"))).alias("words")))
    span_words = F.array_distinct(F.slice("words", F.col("first") + 1, F.col("end") - F.col("first")))
    own = F.array_distinct("template_words")
    return (texts.join(small(candidates, n), same)
            .join(F.broadcast(known), F.col("_template") == F.col("template"))  # a constant table
            .withColumn("likeness", F.size(F.array_intersect(span_words, own))
                        / F.greatest(F.size(own), F.size(span_words)))
            .where(F.col("likeness") >= COVER)
            .select("id", "key", "label", "first", "end", "likeness"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: phrase places, both kinds of labels, the best likeness, and the spans.

    ``score`` is the best span's likeness, at least 0.5 where a phrase was found.
    """
    found = stored(
        spans(docs, templates, id_col, text_col).groupBy(F.col("id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.collect_set("label").alias("more"), F.max("likeness").alias("likeness"),
             F.array_sort(F.collect_set(F.struct("first", "end", "label"))).alias("spans")), "license-spans")
    rows = _rows(docs, id_col, text_col)
    n_words = F.when(F.col("norm") == "", F.lit(0)).otherwise(_spaces(F.col("norm")) + 1).cast("long")
    rows = rows.withColumn("n_words", n_words)
    base = rows.select("id", "key", "n_words",
                       *[c.alias(n) for n, c in phrase_places(F.col("norm"), F.col("n_words"), phrases).items()])
    joined = base.join(small(found, found.count()), F.col("id").eqNullSafe(F.col("_id"))
                       & (F.col("key") == F.col("_key")), "left")
    labels = F.array_sort(F.array_union("base_label_list", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_label_list", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("likeness", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,end:int,label:string>>")).alias("spans"))
