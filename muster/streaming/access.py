"""Access decisions on Structured Streaming: requests meet the tokens that live at their time.

Two streams, the registered tokens and the requests, meet in a left outer stream-stream join with a watermark
on each side and a time interval: a token lives from its issue to its expiry, which is at most the lifetime of
its scope later. So state is bounded by time: a token leaves it when no request of its lifetime can come any
more; a request leaves it when no token issued before it can come any more, and comes out without an owner,
which is ``invalid_token``. Requests that present no token are decided at once and never enter the state.

Each micro-batch of owned requests is written to a folder of its batch id, and the users' versions (a table)
are found by the as-of join of the batch form from what was written, so that the state is read once a batch.
A repeated batch overwrites its folder: a crash at any point neither repeats nor loses requests.

* Equal to ``operators.access.access_asof`` on the same rows if no row is later than ``delay``. A token later
  than that is not seen (its requests are ``invalid_token``); a request later than that is dropped by Spark.
* The outer rows wait for the watermark, which moves with both streams (the slower one counts).
* Token hashes are unique, as in the token table; a hash registered twice doubles its requests.
* A request without a time that presents a token is ``invalid_token``, as in the batch form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.time import epoch_micros
from muster.functions.tokens import token_hash
from muster.operators.access import decide_asof, presented
from muster.schemas import SCOPE_AUTHENTICATION, TOKEN_LIFETIME_SECONDS


def own_requests(requests: DataFrame, tokens: DataFrame, header_col: str, at_col: str, delay: str) -> DataFrame:
    """Streaming requests with ``_state`` (what the header is) and ``_user`` (owner of the token live at that time)."""
    def instant(df: DataFrame, name: str):
        return F.timestamp_micros(epoch_micros(F.col(name), df.schema[name].dataType))

    state, tok = presented(F.col(header_col))
    read = requests.withColumn("_state", state)
    asks = (F.col("_state") == "lookup") & F.col(at_col).isNotNull()
    asked = (read.where(asks).withColumn("_key", token_hash(tok)).withColumn("_at", instant(requests, at_col))
             .withWatermark("_at", delay))
    live = (tokens.where(F.col("scope") == SCOPE_AUTHENTICATION)
            .select(F.col("hash").alias("_token"), F.col("user_id").alias("_user"), instant(tokens, "issued_at").alias("_from"),
                    instant(tokens, "expiry").alias("_until")).withWatermark("_from", delay))
    # an expiry is rounded to the second, so a token may live half a second longer than its scope says
    longest = TOKEN_LIFETIME_SECONDS[SCOPE_AUTHENTICATION] + 1
    met = asked.join(live, F.expr(f"_key = _token AND _from <= _at AND _at <= _from + INTERVAL {longest} SECONDS "
                                  "AND _at < _until"), "left")
    at_once = read.where(~asks).withColumn("_user", F.lit(None).cast("string"))
    return met.select(*requests.columns, "_state", "_user").unionByName(at_once)


def run_access_stream(requests: DataFrame, tokens: DataFrame, versions: Callable[[], DataFrame], out_dir: str,
                      header_col: str = "auth_header", guarded_col: str = "guarded", at_col: str = "at",
                      version_tie: str | None = None, delay: str = "10 minutes", available_now: bool = True):
    """Start the stream; ``versions`` gives the users' versions as they are known when a batch is decided.

    ``read_decisions`` reads what has been decided so far."""
    spark = requests.sparkSession

    def decide(batch: DataFrame, batch_id: int) -> None:
        owned = f"{out_dir}/owned/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(owned)
        found = decide_asof(spark.read.parquet(owned), versions(), guarded_col, at_col, version_tie)
        found.write.mode("overwrite").parquet(f"{out_dir}/decided/batch_id={batch_id}")

    w = own_requests(requests, tokens, header_col, at_col, delay).writeStream.foreachBatch(decide) \
        .option("checkpointLocation", f"{out_dir}/_checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_decisions(spark: SparkSession, out_dir: str) -> DataFrame:
    """Decided requests: their columns, user_id, outcome, status and batch_id."""
    return spark.read.parquet(f"{out_dir}/decided")
