"""Point-in-time (as-of) join: each left row gets the latest right row of its key at its own time.

Spark has no as-of join. Both sides are dealt by (key, time bucket). What was valid before a bucket comes from
one row per (key, bucket): the bucket's last right row, carried forward over the key's buckets. So only
rows of one bucket meet, in a running ``last`` over them. A (key, bucket) with more than ``HOT_ROWS`` left
rows is cut into salted parts, each with a copy of the bucket's right rows; a key that holds a third
of all left rows is many tasks. Left rows of buckets without right rows take what is carried and are not
sorted at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.time import epoch_micros

BUCKET_SECONDS, HOT_ROWS = 86_400, 500_000


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, values: list[str],
              tie: str | None = None, bucket_seconds: int = BUCKET_SECONDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` with ``values`` of the right row of the same ``on`` with the latest ``right_time`` <= ``left_time``.

    Equal right times: the larger ``tie`` wins (then the larger values). Without such a row, and where key
    or time is NULL, the values are NULL. Every left row comes out once.
    """
    width = bucket_seconds * 1_000_000
    clash = sorted(set(values) & set(left.columns))
    if clash:
        raise ValueError(f"left has columns named {', '.join(clash)}")
    value = F.struct(*values)
    order = F.struct(F.col("_t"), *([F.col(tie).alias("_tie")] if tie else []), value.alias("_v"))
    r = right.withColumn("_t", epoch_micros(F.col(right_time), right.schema[right_time].dataType)) \
        .where(F.col(on).isNotNull() & F.col("_t").isNotNull()) \
        .select(F.col(on).alias("_k"), F.floor(F.col("_t") / width).alias("_b"), order.alias("_o"))
    lt = left.select(F.struct(*left.columns).alias("_row"), F.col(on).alias("_k"),
                     epoch_micros(F.col(left_time), left.schema[left_time].dataType).alias("_t")) \
        .withColumn("_b", F.floor(F.col("_t") / width))
    # one row per (key, bucket): its last right row, and how many rows of each side it has
    none = F.lit(None).cast(r.schema["_o"].dataType)
    lasts = r.groupBy("_k", "_b").agg(F.max("_o").alias("_last"), F.count(F.lit(1)).alias("_rights")) \
        .withColumn("_lefts", F.lit(0).cast("long"))
    asked = lt.where("_k is not null and _t is not null").groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_lefts")) \
        .select("_k", "_b", none.alias("_last"), F.lit(0).cast("long").alias("_rights"), "_lefts")
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    line = (lasts.unionByName(asked).groupBy("_k", "_b")
            .agg(F.max("_last").alias("_last"), F.sum("_rights").alias("_rights"), F.sum("_lefts").alias("_lefts"))
            .withColumn("_carried", F.last("_last", ignorenulls=True).over(before)["_v"])
            .where("_lefts > 0").select("_k", "_b", "_carried", "_rights",
                                        F.ceil(F.col("_lefts") / hot_rows).alias("_salts")))
    placed = lt.join(line, ["_k", "_b"], "left")
    alone = placed.where(F.coalesce(F.col("_rights"), F.lit(0)) == 0).select("_row", F.col("_carried").alias("_found"))
    busy = placed.where("_rights > 0").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")))
    copies = r.join(line.where("_rights > 0").select("_k", "_b", "_salts"), ["_k", "_b"]).select(
        "_k", "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"),
        F.col("_o._t").alias("_t"), F.lit(0).alias("_side"), "_o", F.lit(None).cast(placed.schema["_row"].dataType).alias("_row"),
        F.lit(None).cast(placed.schema["_carried"].dataType).alias("_carried"))
    both = copies.unionByName(busy.select("_k", "_b", "_salt", "_t", F.lit(1).alias("_side"), none.alias("_o"), "_row", "_carried"))
    so_far = Window.partitionBy("_k", "_b", "_salt").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_found", F.coalesce(F.last("_o", ignorenulls=True).over(so_far)["_v"], F.col("_carried"))) \
        .where("_side = 1").select("_row", "_found")
    return met.unionByName(alone).select("_row.*", *[F.col("_found")[v].alias(v) for v in values])
