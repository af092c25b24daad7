"""Life cycle of import jobs from a log of status changes (S7): every change is applied or reported as illegal.

A job is created as ``pending``; it runs, and ends as ``completed`` or ``failed``; a failed job may run again, which is
its next attempt; ``completed`` is final. An illegal change leaves the job as it was.

No state has to be walked event by event, as the last start or end before an event says whether the job runs: a start
of a running job and an end of a job that does not run change nothing, legal or not. So an event is legal if it
follows the opposite one, and all ends with the first ``completed`` that follows a start. That is a lookup of the
previous event and two minima a job. Events are dealt by (job, time bucket); what a bucket inherits comes from one
row per (job, bucket), so a job that holds a third of the log is as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.time import epoch_micros
from muster.operators.ingest import PENDING

RUNNING, COMPLETED, FAILED = "running", "completed", "failed"  # the states after ``pending``
BUCKET_SECONDS = 86_400


def import_job_history(events: DataFrame, job: str = "job_id", at: str = "at", seq: str = "seq", status: str = "status",
                       bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``events`` with outcome (``applied`` or ``illegal``), state (of the job after the event) and attempt (how often it
    has been started).

    Events of a job come in the order of ``at``, then ``seq`` (unique within the log). Illegal are: a change before the
    job is created (state NULL, attempt 0), creating it again, an unknown or NULL status, and what the life cycle
    does not allow. An event without a job or a time belongs to no history: illegal, state and attempt NULL.
    """
    columns = events.columns
    e = events.select(F.struct(*columns).alias("_row"), F.col(job).alias("_job"), F.col(status).alias("_status"),
                      epoch_micros(F.col(at), events.schema[at].dataType).alias("_t"), F.col(seq).alias("_seq"))
    known = F.col("_job").isNotNull() & F.col("_t").isNotNull()
    lost = e.where(~known).select("_row.*", F.lit("illegal").alias("outcome"), F.lit(None).cast("string").alias("state"),
                                  F.lit(None).cast("bigint").alias("attempt"))
    e = e.where(known).withColumn("_b", F.floor(F.col("_t") / (bucket_seconds * 1_000_000))) \
        .withColumn("_at", F.struct("_t", "_seq"))
    created = e.where(F.col("_status") == PENDING).groupBy("_job").agg(F.min("_at").alias("_created"))
    e = e.join(created, "_job", "left")
    exists = F.coalesce(F.col("_at") >= F.col("_created"), F.lit(False))
    side = F.when(F.col("_status") == RUNNING, "start").when(F.col("_status").isin(COMPLETED, FAILED), "end")
    e = e.withColumn("_exists", exists).withColumn("_side", F.when(exists, side))
    # the last start or end before each event: within its bucket, else what the buckets before it left
    buckets = e.groupBy("_job", "_b").agg(F.max(F.when(F.col("_side").isNotNull(), F.struct("_at", "_side"))).alias("_last"))
    before = Window.partitionBy("_job").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inherited = buckets.select("_job", "_b", F.last("_last._side", ignorenulls=True).over(before).alias("_inherited"))
    inside = Window.partitionBy("_job", "_b").orderBy("_t", "_seq")
    e = e.join(inherited, ["_job", "_b"]).withColumn("_previous", F.coalesce(
        F.last("_side", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_inherited")))
    runs = F.coalesce(F.col("_previous") == "start", F.lit(False))
    done = e.where((F.col("_status") == COMPLETED) & F.col("_exists") & runs).groupBy("_job").agg(F.min("_at").alias("_done"))
    e = e.join(done, "_job", "left")
    open_ = F.col("_done").isNull() | (F.col("_at") <= F.col("_done"))
    legal = open_ & F.col("_exists") & F.coalesce(
        F.when(F.col("_side") == "start", ~runs).when(F.col("_side") == "end", runs)
        .otherwise(F.col("_at") == F.col("_created")), F.lit(False))
    e = e.withColumn("_legal", legal).withColumn("_began", (F.col("_legal") & (F.col("_status") == RUNNING)).cast("int"))
    e = e.withColumn("_began", F.coalesce("_began", F.lit(0)))
    sums = e.groupBy("_job", "_b").agg(F.sum("_began").alias("_n"))
    earlier = sums.select("_job", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    e = e.join(earlier, ["_job", "_b"]).withColumn("_attempt", F.col("_earlier") + F.sum("_began").over(so_far))
    last = F.coalesce(F.col("_side"), F.col("_previous"))
    state = (F.when(~F.col("_exists"), None).when(F.col("_at") >= F.col("_done"), COMPLETED)
             .when(last == "start", RUNNING).when(F.col("_attempt") > 0, FAILED).otherwise(PENDING))
    return e.select("_row.*", F.when(F.col("_legal"), "applied").otherwise("illegal").alias("outcome"),
                    state.alias("state"), F.col("_attempt").cast("bigint").alias("attempt")).unionByName(lost)
