"""Strict JSON ingest on Structured Streaming: request bodies arriving as NDJSON files.

The decode is stateless, so the batch operator runs unchanged on the stream. Each micro-batch is
decoded and written once, to a folder named by its batch id that a repeated batch overwrites, with one
partition for accepted rows and one for rejects: a crash at any point neither repeats nor loses rows.
Rejects keep their text, file and line id (a hash of file and text, with the number of equal lines
before it in the file left out: equal lines of a file are equal rejects).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.sources.ndjson import InputField, ingest_ndjson


def decode_stream(spark: SparkSession, source_dir: str, spec: tuple[InputField, ...],
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of decoded bodies (typed fields + ``reject_code``)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.option("lineSep", "\n").load(source_dir).select(
        F.input_file_name().alias("source_file"), F.col("value").alias("line"), "value")
    lines = lines.withColumn("line_id", F.sha2(F.concat_ws("\n", "source_file", "line"), 256))
    return ingest_ndjson(lines, spec, "value")


def run_ingest_stream(spark: SparkSession, source_dir: str, spec: tuple[InputField, ...],
                      out_dir: str, available_now: bool = True):
    """Start the stream. ``read_results`` reads the accepted rows and the rejects of ``out_dir``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("status", F.when(F.col("reject_code").isNull(), "accepted").otherwise("rejected"))
         .withColumn("line", F.when(F.col("reject_code").isNotNull(), F.col("line")))
         .write.mode("overwrite").partitionBy("status").parquet(f"{out_dir}/batches/batch_id={batch_id}"))

    w = decode_stream(spark, source_dir, spec).writeStream.foreachBatch(write) \
        .option("checkpointLocation", f"{out_dir}/_checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_results(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejects with code, text, file, line id and batch id) written so far."""
    both = spark.read.parquet(f"{out_dir}/batches")
    good = both.where("status = 'accepted'").drop("status", "reject_code", "line")
    bad = both.where("status = 'rejected'").select("reject_code", "line", "source_file", "line_id", "batch_id")
    return good, bad
