"""A corpus pipeline of five stages over ``documents``, each calling one operator of ``muster.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read back as the next stage's input. All but the last return the columns of
``documents``; rows leave only by a stage's decision.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join (five words, similarity 0.8): one document of each group stays;
3. benchmark decontamination: documents that hold a benchmark passage go;
4. secret scan: secrets are replaced by a mark, ``n_chars`` follows the text;
5. byte-level BPE: ids are encoded and decoded, one row of digests per document.

Null and empty texts are scored like any text of no words, link with nothing, match nothing and encode
to no ids; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import bpe, decontaminate, jaccard, quality, secrets
from muster.llm.common import stored, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows of ``docs``; keep what the classifier accepts.

    Stored here, as ``stored`` hands whole texts to Python in small batches, whoever writes the result."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = "_".join(["score", *docs.columns])  # a name that no column has
    scored = quality.score(docs, model, out_col=score)
    kept = scored.where(quality.accepted(f"`{score}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
    return stored(kept, "pipeline-accepted")


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the smallest id."""
    return jaccard.deduplicate(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; documents without secrets stay as they are."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = dict(docs.dtypes)["n_chars"]
    length = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind))
    return clean.withColumn("n_chars", length).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left and show that it decodes: one row of digests per document."""
    return stored(bpe.round_trip(docs), "pipeline-digests")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_ngrams),
    ("benchmark decontamination", decontaminate_benchmark),
    ("secret scans", scan_secrets),
    ("byte-level BPE encoding and decoding", encode_bpe),
]

#: a chain with a trained classifier can't be written in SQL; tests/llm compare it with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every intermediate is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
    return docs
