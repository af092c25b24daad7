"""Filtered totals for a log of list requests: every argument combination's count in one pass (A1/A2 in bulk).

Counting per request would scan the table once for each. Grouping sets over the filter columns count all
combinations of given and absent arguments in one scan with partial aggregation; a request then looks its
total up by its arguments. There are at most 2^filters sets, and only the sets that the log uses are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _norm(col: Column, kind: str) -> Column:
    if kind not in ("ci", "id"):
        raise ValueError(f"filter kind {kind}: ci (equal but for case) or id (equal)")
    text = col.cast("string")
    return F.lower(text) if kind == "ci" else text


def totals_for_requests(rows: DataFrame, requests: DataFrame, filters: dict[str, str], request_col: str = "request_id") -> DataFrame:
    """(request, total): rows that pass the request's filters. ``filters``: column -> kind, the same column
    name in ``rows`` and ``requests``; a NULL or empty argument filters nothing, as in the listings; a NULL in a
    row equals no argument. A repeated request comes out as often as it is there.
    """
    names = list(filters)
    args = requests.select(F.col(request_col), *[
        F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), _norm(F.col(c), k)).alias(f"_a{i}")
        for i, (c, k) in enumerate(filters.items())])
    bits = [F.when(F.col(f"_a{i}").isNull(), F.lit(1 << i)).otherwise(0) for i in range(len(names))]
    args = args.withColumn("_set", reduce(lambda a, b: a + b, bits, F.lit(0)))
    used = [r["_set"] for r in args.select("_set").distinct().collect()]  # at most 2^filters numbers
    cells = rows.select(*[_norm(F.col(c), k).alias(f"_c{i}") for i, (c, k) in enumerate(filters.items())])
    each = F.explode(F.array(*[F.lit(s) for s in used])) if used else F.explode(F.array().cast("array<int>"))
    # what an absent argument leaves open is one value; a NULL of the row under a given argument matches nothing
    kept = reduce(lambda a, b: a & b, [(F.col("_set").bitwiseAND(F.lit(1 << i)) != 0) | F.col(f"_c{i}").isNotNull()
                                       for i in range(len(names))], F.lit(True))
    keyed = cells.groupBy(*[f"_c{i}" for i in range(len(names))]).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_set", each).where(kept)
    open_ = [F.when(F.col("_set").bitwiseAND(F.lit(1 << i)) != 0, F.lit("")).otherwise(F.col(f"_c{i}")).alias(f"_k{i}")
             for i in range(len(names))]
    counts = keyed.select("_set", "_n", *open_).groupBy("_set", *[f"_k{i}" for i in range(len(names))]) \
        .agg(F.sum("_n").alias("_total"))
    asked = args.withColumns({f"_k{i}": F.coalesce(f"_a{i}", F.lit("")) for i in range(len(names))})
    return asked.join(counts, ["_set", *[f"_k{i}" for i in range(len(names))]], "left") \
        .select(request_col, F.coalesce("_total", F.lit(0)).cast("long").alias("total_records"))
