"""Registered queries: full-text search by stored postings, and by token classes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from muster.functions.text import compound_tokens, matching_class_queries, text_tokens
from muster.operators.fulltext import Postings
from muster.plans.catalog import query
from muster.plans.oracle_sql import toks
from muster.session import checkpoint_dir


@query("fulltext_postings", f"""
    WITH d AS (SELECT doc_id, {toks('text')} AS t FROM documents),
    q AS (SELECT doc_id AS query_id, list_distinct(list_filter([t[3], t[5], t[40]], lambda x: x IS NOT NULL)) AS terms
          FROM d WHERE doc_id % 50 = 0)
    SELECT query_id, doc_id FROM q JOIN d ON len(terms) > 0 AND list_has_all(t, terms)""")
def fulltext_postings(t):
    """F3 in bulk: all documents are indexed; every document whose id 50 divides asks for three of its words. The
    pairs are stored as lists, so that whoever reads them runs no Python."""
    docs = t.raw("documents")
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    index = Postings.build(docs, "doc_id", "text", path)
    words = F.concat(text_tokens("text"), compound_tokens("text")).alias("words")
    queries = docs.where("doc_id % 50 = 0").select("doc_id", words).select("doc_id", F.concat_ws(
        " ", *[F.try_element_at("words", F.lit(i)) for i in (3, 5, 40)]).alias("text"))
    index.matches(queries, "doc_id", "text").write.parquet(f"{path}/matches")
    return t.spark.read.parquet(f"{path}/matches").select(F.explode("queries").alias("query_id"), F.col("id").alias("doc_id"))


#: queries, and what they mean in SQL over the lower-case text
CLASS_QUERIES = {
    "License 2.0": r"regexp_matches(t, '(^|[^\p{L}\p{N}@./_-])license([^\p{L}\p{N}@./_-]|[.][^\p{L}\p{N}]|[.]?$)') "
                   r"AND regexp_matches(t, '(^|[^\p{L}\p{N}@./_+-])2\.0([^\p{L}\p{N}.]|[.][^\p{N}]|[.]?$)')",
    "+1": r"regexp_matches(t, '(^|[^\p{L}\p{N}@./_+-])\+1([^\p{L}\p{N}./_@]|$)')",
    "hein.19@mail5.example.com": r"regexp_matches(t, '(^|[^\p{L}\p{N}._-])hein\.19@mail5\.example\.com([^\p{L}\p{N}._:-]|[.]?$)')",
    "mail5.example.com": r"regexp_matches(t, '(^|[^\p{L}\p{N}@._/-])mail5\.example\.com([^\p{L}\p{N}._:/-]|[.]?$)')",
}


@query("filter_fulltext_classes", "WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) " + " UNION ALL ".join(
    f"SELECT '{q}' AS query, doc_id FROM d WHERE {sql}" for q, sql in CLASS_QUERIES.items()))
def filter_fulltext_classes(t):
    """F3 by token classes: a number, a signed number and an address are found as wholes, a host is not found
    inside an address."""
    docs = t.raw("documents")
    hits = matching_class_queries("text", list(CLASS_QUERIES))
    return docs.select("doc_id", F.explode(hits).alias("query")).select("query", "doc_id")
