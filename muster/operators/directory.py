"""Stored page directory: a listing sorted once, any page of it read from one or two files.

``build_directory`` writes the public columns in listing order (a distributed range sort) and beside them one
row per file: its number, its row count and the position of its first row, a prefix sum over files. A page
is then found by arithmetic: the files that overlap its positions, and in them the rows by
``_metadata.row_index``. Nothing is sorted or counted again but the rows of the page.

A directory is of one table version, one sort and one set of filters; a new version needs a new one.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.operators.listing import apply_filters, sort_columns, validate_page_args
from muster.plans.specs import MAX_PAGE, ListSpec, PageArgs
from muster.schemas import PUBLIC


def build_directory(df: DataFrame, spec: ListSpec, path: str, sort: str | None = None, filters: dict | None = None,
                    columns=None) -> None:
    """Write the sorted rows to ``path``/rows and the files' counts and starts to ``path``/files."""
    spark = df.sparkSession
    rows = apply_filters(df, spec, filters or {}).select(*(columns or PUBLIC[spec.table]))
    rows.orderBy(*sort_columns(spec, sort)).write.mode("errorifexists").parquet(f"{path}/rows")
    file = F.col("_metadata.file_path").alias("file")
    counts = spark.read.schema(rows.schema).parquet(f"{path}/rows").groupBy(file).agg(F.count(F.lit(1)).alias("rows"))
    # a range sort's partitions are in order, and a file's name begins with its partition's number
    numbered = counts.withColumn("number", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long"))
    before = Window.orderBy("number", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    numbered.select("number", "file", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")) \
        .coalesce(1).write.mode("errorifexists").parquet(f"{path}/files")


def directory_total(spark: SparkSession, path: str) -> int:
    """Rows of the listing."""
    return spark.read.parquet(f"{path}/files").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n


def read_page(spark: SparkSession, path: str, spec: ListSpec, page: int, page_size: int,
              max_page: int | None = MAX_PAGE) -> DataFrame:
    """The rows of ``listing.list_page`` for this page, with ``total_records``, in listing order.

    Raises ``ValueError`` with the error map for invalid page arguments; a page past the end is empty. A request is held
    to the bound of page numbers; ``max_page=None`` reads any page of a long listing, at the same cost.
    """
    errors = validate_page_args(spec, PageArgs(page, page_size), max_page)
    if errors:
        raise ValueError(errors)
    first = (page - 1) * page_size
    listed = spark.read.parquet(f"{path}/files")
    # files that overlap the page hold a row of it each: at most page_size names
    hit = listed.where((F.col("start") < first + page_size) & (F.col("start") + F.col("rows") > first)) \
        .select("file", "start").collect()
    stored = spark.read.parquet(f"{path}/rows")
    total = F.lit(directory_total(spark, path)).cast("bigint").alias("total_records")
    if not hit:
        return stored.limit(0).select(total, *stored.columns)
    # the metadata column gives paths URL-encoded, readers take them plain
    rows = spark.read.schema(stored.schema).parquet(*[unquote(r.file) for r in hit])
    starts = F.create_map(*[x for r in hit for x in (F.lit(r.file), F.lit(r.start))])
    position: Column = starts[F.col("_metadata.file_path")] + F.col("_metadata.row_index")
    placed = rows.select("*", position.alias("_position"))
    return placed.where(F.col("_position").between(first, first + page_size - 1)).orderBy("_position") \
        .select(total, *stored.columns)
