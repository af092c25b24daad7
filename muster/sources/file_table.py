"""Table versions as plain lists of Parquet files: a mutation rewrites the files that it touches, the rest stay.

Open-source Spark can't change a Parquet table in place. A version here is its schema and the list of its files;
a mutation finds the files that hold a hit row (one scan of the key column and ``_metadata.file_path``, joined to
the keys), reads those alone, writes what becomes of their rows to a new folder and returns the list with
the new files in their place. Untouched files are neither read in full nor written; both versions stay readable.
There is no log: whoever holds the list holds the version (``write_list`` stores it as a table).

Only file names reach the driver, as for any scan that Spark lists. Laid out by what mutations select on
(``store_table`` by ranges), a mutation of one period or one range of keys costs that part of the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.operators.mutate import table_update
from muster.schemas import UNIQUE_KEYS

_FILE = "_metadata.file_path"


def _plain(path: str) -> str:
    """A listed path without the URL encoding that Spark gives it, as readers take it."""
    return unquote(path)


@dataclass(frozen=True)
class FileTable:
    """One version of a table. ``rewritten``: files of the version before that it replaces."""

    schema: T.StructType
    files: tuple[str, ...]
    rewritten: tuple[str, ...] = ()

    def read(self, spark: SparkSession, files=None) -> DataFrame:
        """The rows of the version (or of some of its files); no files: an empty table."""
        files = self.files if files is None else files
        return spark.read.schema(self.schema).parquet(*files) if files else spark.createDataFrame([], self.schema)


def open_table(spark: SparkSession, path: str) -> FileTable:
    """The table whose files lie under ``path``."""
    df = spark.read.parquet(path)
    return FileTable(df.schema, tuple(sorted(_plain(f) for f in df.inputFiles())))


def store_table(df: DataFrame, path: str, order: list[str], files: int | None = None) -> FileTable:
    """Write ``df`` in ranges of ``order``, ``files`` of them (as many as the session's shuffle partitions)."""
    spark = df.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)
    return open_table(spark, path)


def write_list(spark: SparkSession, table: FileTable, path: str) -> None:
    """Store the version's file list; ``read_list`` gives the version back."""
    spark.createDataFrame([(f,) for f in table.files], "file string").write.mode("errorifexists").parquet(path)


def read_list(spark: SparkSession, path: str, schema: T.StructType) -> FileTable:
    return FileTable(schema, tuple(sorted(r.file for r in spark.read.parquet(path).select("file").collect())))


def touched_files(spark: SparkSession, table: FileTable, keys: DataFrame, on: list[str]) -> tuple[str, ...]:
    """Files with a row whose ``on`` columns equal a row of ``keys`` (NULL equals nothing)."""
    if not table.files:
        return ()
    lies = table.read(spark).select(*on, F.col(_FILE).alias("_file"))
    hit = lies.join(keys.select(*on), on, "left_semi").select("_file").distinct()
    names = {f.split(":", 1)[-1].lstrip("/"): f for f in table.files}  # file:/x and file:///x are one file
    found = (_plain(r["_file"]).split(":", 1)[-1].lstrip("/") for r in hit.collect())
    return tuple(sorted(names[f] for f in found))


def rewrite(spark: SparkSession, table: FileTable, files: tuple[str, ...], change: Callable[[DataFrame], DataFrame],
            out_dir: str) -> FileTable:
    """The version in which ``change`` has been applied to the rows of ``files``; nothing touched: the same files."""
    if not files:
        return FileTable(table.schema, table.files)
    part = table.read(spark, files)
    change(part).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in table.schema.fields]) \
        .write.mode("errorifexists").parquet(out_dir)
    gone = set(files)
    new = tuple(_plain(f) for f in spark.read.schema(table.schema).parquet(out_dir).inputFiles())
    return FileTable(table.schema, tuple(f for f in table.files if f not in gone) + tuple(sorted(new)), tuple(files))


def delete_rows(spark: SparkSession, table: FileTable, keys: DataFrame, on: list[str], out_dir: str) -> FileTable:
    """M3, M4 and the cascade of M5: rows whose ``on`` columns equal a row of ``keys`` go."""
    files = touched_files(spark, table, keys, on)
    return rewrite(spark, table, files, lambda part: part.join(keys.select(*on), on, "left_anti"), out_dir)


def clear_reference(spark: SparkSession, table: FileTable, keys: DataFrame, column: str, out_dir: str) -> FileTable:
    """SET NULL of M5: ``column`` is cleared where it holds a value of ``keys``' column of that name."""
    def clear(part: DataFrame) -> DataFrame:
        gone = keys.select(F.col(column).alias("_gone")).distinct()
        met = part.join(gone, F.col(column) == F.col("_gone"), "left")
        return met.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")

    return rewrite(spark, table, touched_files(spark, table, keys, [column]), clear, out_dir)


def update_rows(spark: SparkSession, table: FileTable, patches: DataFrame, entity: str, columns, as_of, out_dir: str,
                parents: dict[str, DataFrame] | None = None) -> tuple[FileTable, DataFrame]:
    """M1 (``mutate.table_update``) on the files that hold a patched id. Returns the new version and the report.

    Files with a row that holds a wanted value of a unique key are read and rewritten as well, so that the
    uniqueness check sees every holder. A unique key of which only some columns are patched is an error, as the
    value wanted is not known before the row is read.
    """
    files = set(touched_files(spark, table, patches, ["id"]))
    for key in UNIQUE_KEYS.get(entity, ()):
        written = [c for c in key if c in columns]
        if key != ("id",) and written:
            if len(written) < len(key):
                raise ValueError(f"{entity}: a patch of {', '.join(written)} is a part of a unique key")
            files |= set(touched_files(spark, table, patches, list(key)))
    files = tuple(sorted(files))
    new, report = table_update(table.read(spark, files), patches, entity, columns, as_of, parents=parents)
    return rewrite(spark, table, files, lambda _: new, out_dir), report
