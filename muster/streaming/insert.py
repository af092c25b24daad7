"""Bulk insert on Structured Streaming (S3): batches of rows arrive as files, unique keys hold across batches.

Every micro-batch is first written as it came to a folder of its batch id, then judged by the batch operator
against the base table and the rows created by *earlier* batches (folders of smaller ids), then its created rows and
its report are written to folders of its id. All three overwrite, and a batch never looks at its own folder or
a later one: a batch that runs again after a crash at any point gives the same rows and inserts nothing twice.

The keys held so far are the key columns of the base and of the folders, joined to the batch; only those columns are
read, and a hot key is one row after the map-side ``min`` of its batch. A batch is judged once, pinned, and written from there. ``compact`` is the caller's: a
new base (``read_created`` added) and a new ``out_dir`` start a shorter list of folders.

Equal to ``ingest.bulk_insert`` of all rows at once if batches come in the order of ``seq`` and the table has one
unique key besides a generated id; with several, a row that fails on one key still holds its others within its own
batch, as in the batch form, but not beyond it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.ingest import insert_rows

_LAYERS = ("landed", "created", "report")


def _folder(out_dir: str, layer: str, batch_id: int) -> str:
    return f"{out_dir}/{layer}/batch_id={batch_id}"


def _created_before(spark: SparkSession, base: DataFrame, out_dir: str, batch_id: int) -> DataFrame:
    """Rows created by batches before this one. Every earlier batch has its folder, an empty one if it created none."""
    if batch_id == 0:
        return base.limit(0)
    earlier = spark.read.schema(base.schema).option("basePath", f"{out_dir}/created").parquet(f"{out_dir}/created")
    return earlier.where(F.col("batch_id") < batch_id).select(*base.columns)


def insert_batch(batch: DataFrame, batch_id: int, base: DataFrame, table: str, as_of, out_dir: str,
                 parents: Callable[[], dict[str, DataFrame]], **kw) -> None:
    """Judge and insert one micro-batch; running it again with the same id changes nothing."""
    spark = base.sparkSession
    landed, created, report = (_folder(out_dir, layer, batch_id) for layer in _LAYERS)
    batch.write.mode("overwrite").parquet(landed)
    held = base.unionByName(_created_before(spark, base, out_dir, batch_id))
    rows, said = insert_rows(held, spark.read.schema(batch.schema).parquet(landed), table, as_of, parents=parents(),
                             pin_batch=True, **kw)  # judged once for both writes
    rows.write.mode("overwrite").parquet(created)
    said.write.mode("overwrite").parquet(report)


def run_insert_stream(rows: DataFrame, base: DataFrame, table: str, as_of, out_dir: str,
                      parents: Callable[[], dict[str, DataFrame]] = dict, available_now: bool = True, **kw):
    """Start the stream of ``rows`` (``seq`` and the table's columns). ``parents`` gives the parent tables as they
    are when a batch is judged; other arguments are those of ``bulk_insert``."""
    w = rows.writeStream.option("checkpointLocation", f"{out_dir}/_checkpoint").foreachBatch(
        lambda batch, batch_id: insert_batch(batch, batch_id, base, table, as_of, out_dir, parents, **kw))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_created(base: DataFrame, out_dir: str) -> DataFrame:
    """All rows created so far, in the columns of ``base``."""
    return base.sparkSession.read.schema(base.schema).parquet(f"{out_dir}/created").select(*base.columns)


def read_report(spark: SparkSession, out_dir: str) -> DataFrame:
    """The reports of all batches, with ``batch_id``."""
    return spark.read.parquet(f"{out_dir}/report")
