"""Sharding along a Hilbert curve over several metadata dimensions (built-in functions only).

Every dimension is quantised to ``2**bits`` cells at its own quantiles: numbers directly, strings by
an order-preserving number made of the six bytes after their common prefix. The cell's place on the
Hilbert curve orders the rows; equal cells are ordered by a hash. The ordered rows are cut into
runs, the shards, whose sizes in rows are at most one apart (law ``rows``). As neighbours on
the curve are neighbours in every dimension, a shard spans a small box of the metadata, and a reader
with a predicate on any of the dimensions skips most shards by their minima and maxima.

Positions are exact and need no sort in one task. Rows per cell are counted (at most
``2**(bits * dimensions)`` cells, a constant); a cell is split by hash into buckets of about
``BUCKET_ROWS`` rows, so a hot cell is many tasks; a row's position is the start of its cell, plus the
start of its bucket in the cell, plus its place in the bucket. Rows that agree in everything the
result needs are counted before they are placed. The text is read once; what is shuffled is narrow.

Defined results: a null text has size 16 and checksum 0; null dimensions fall in the first cell;
equal rows take neighbouring slots; an empty table gives an empty result; further columns are
ignored (``place``) or kept (``write_shards``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.llm.common import stored

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 5
BUCKET_ROWS = 50_000
ROW_OVERHEAD = 16  # bytes added to a text's size (fixed value)
QUANTILE_ACCURACY = 10_000


# --- the curve -----------------------------------------------------------------------------------
def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell given by one number of ``bits`` bits per dimension.

    The axes are rotated and reflected from the top bit down, Gray-coded, and their bits interleaved.
    """
    n = len(axes)
    levels = [1 << b for b in range(bits - 1, 0, -1)]
    cell = F.array(*[a.cast("long") for a in axes])
    steps = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i"))
                      for q in levels for i in range(n)]) if levels else None

    def turn(x: Column, step: Column) -> Column:
        low = step.q - 1
        first, own = F.element_at(x, 1), F.get(x, step.i)
        swap = F.when(own.bitwiseAND(step.q) != 0, F.lit(0).cast("long")) \
            .otherwise(first.bitwiseXOR(own).bitwiseAND(low))
        flip = F.when(own.bitwiseAND(step.q) != 0, low).otherwise(F.lit(0).cast("long"))
        return F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(swap).bitwiseXOR(flip))
                           .when(j == step.i, v.bitwiseXOR(swap)).otherwise(v))

    if steps is not None:
        cell = F.aggregate(steps, cell, turn)
    gray = F.aggregate(
        cell, F.array().cast("array<long>"),
        lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)),
                                                                     F.lit(0).cast("long"))))))

    def interleave(x: Column) -> Column:
        last = F.element_at(x, n)
        fix = reduce(lambda t, q: t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(q)) != 0, F.lit(q - 1))
                                               .otherwise(F.lit(0)).cast("long")),
                     levels, F.lit(0).cast("long"))
        fixed = F.transform(F.array(fix), lambda t: F.aggregate(
            F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"),
            lambda place, b: F.aggregate(x, place, lambda p, v: p * 2 + F.getbit(v.bitwiseXOR(t), b))))
        return F.element_at(fixed, 1)

    # one-element transforms bind a value once instead of repeating its expression
    return F.element_at(F.transform(F.array(gray), interleave), 1)


# --- quantising ----------------------------------------------------------------------------------
def _as_number(df: DataFrame, dims: list[str]) -> list[Column]:
    """An order-preserving number per dimension; strings lose their common prefix first."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [d for d in dims if not isinstance(kinds[d], (T.NumericType, T.DateType, T.TimestampType,
                                                          T.TimestampNTZType, T.BooleanType))]
    ends = df.agg(F.lit(0).alias("_"), *[f(F.col(d).cast("string")).alias(f"{f.__name__}_{i}")
                                         for i, d in enumerate(texts) for f in (F.min, F.max)]).first()
    out = []
    for d in dims:
        if d in texts:
            i = texts.index(d)
            low, high = ends[f"min_{i}"] or "", ends[f"max_{i}"] or ""
            shared = next((k for k, (a, b) in enumerate(zip(low, high, strict=False)) if a != b),
                          min(len(low), len(high)))
            six = F.rpad(F.substring(F.hex(F.encode(F.substr(F.col(d).cast("string"), F.lit(shared + 1)),
                                                    "UTF-8")), 1, 12), 12, "0")
            out.append(F.conv(six, 16, 10).cast("double"))
        elif isinstance(kinds[d], (T.DateType, T.TimestampNTZType)):
            out.append(F.unix_micros(F.col(d).cast("timestamp")).cast("double"))
        elif isinstance(kinds[d], T.TimestampType):
            out.append(F.unix_micros(d).cast("double"))
        else:
            out.append(F.col(d).cast("double"))
    return out


def cells(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """A number below ``2**bits`` per dimension; the cuts are quantiles over all rows.

    What reaches the driver is a constant: ``2**bits - 1`` cuts per dimension.
    """
    numbers = _as_number(df, dims)
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(x, at, QUANTILE_ACCURACY).alias(f"c{i}")
                    for i, x in enumerate(numbers)]).first()

    def cell(x: Column, bounds: list[float]) -> Column:
        above = F.aggregate(F.array(*map(F.lit, bounds)).cast("array<double>"), F.lit(0),
                            lambda n, cut: n + (x > cut).cast("int"))
        return F.when(x.isNull(), 0).otherwise(above)

    return [cell(x, sorted(set(cuts[f"c{i}"] or []))) for i, x in enumerate(numbers)]


# --- positions -----------------------------------------------------------------------------------
def _positions(keyed: DataFrame) -> DataFrame:
    """``start`` (position of the first) for rows (curve, tie, ..., n), n equal rows each."""
    cell = keyed.groupBy("curve").agg(F.sum("n").alias("cell_rows"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # at most all cells
    cell = cell.withColumn("cell_start", F.coalesce(F.sum("cell_rows").over(before), F.lit(0))) \
        .withColumn("buckets", F.ceil(F.col("cell_rows") / BUCKET_ROWS))
    placed = (keyed.join(cell.select("curve", "cell_start", "buckets"), "curve")
              .withColumn("bucket", F.pmod(F.col("tie"), F.col("buckets"))))
    inside = Window.partitionBy("curve").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket = (placed.groupBy("curve", "bucket").agg(F.sum("n").alias("bucket_rows"))
              .select("curve", "bucket",
                      F.coalesce(F.sum("bucket_rows").over(inside), F.lit(0)).alias("bucket_start")))
    rest = [c for c in keyed.columns if c not in ("curve", "tie", "n")]
    within = Window.partitionBy("curve", "bucket").orderBy("tie", *rest) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(bucket, ["curve", "bucket"])
            .withColumn("start", F.col("cell_start") + F.col("bucket_start")
                        + F.coalesce(F.sum("n").over(within), F.lit(0))))


def _keyed(docs: DataFrame, dims, bits: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        hilbert_index(cells(docs, list(dims), bits), bits).alias("curve"))


def place(docs: DataFrame, shards: int, dims=DIMENSIONS, bits: int = BITS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, curve, shard and slot of every row; shards are at most one row apart."""
    if shards < 1 or not 1 <= bits * len(dims) <= 24:
        raise ValueError("need a shard, a dimension and at most 24 bits of curve")
    narrow = stored(_keyed(docs, dims, bits, id_col, text_col)
                    .groupBy("id", "size", "text_crc32", "curve").agg(F.count(F.lit(1)).alias("n"))
                    .withColumn("tie", F.xxhash64("id", "text_crc32", "size")), "hilbert")
    total = narrow.agg(F.sum("n").alias("n")).first().n or 0
    return (_positions(narrow)
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
            .withColumn("position", F.col("start") + F.col("copy"))
            .withColumn("shard", F.expr(f"cast(position * {shards} div {max(1, total)} as int)"))
            .withColumn("slot", F.expr(f"position - (shard * {total}L + {shards - 1}) div {shards}"))
            .select("id", "size", "text_crc32", "curve", "shard", "slot")
            .withColumnRenamed("id", id_col))


def write_shards(docs: DataFrame, folder: str, shards: int, dims=DIMENSIONS, bits: int = BITS,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """All columns of ``docs``, one Parquet folder per shard, each in curve order.

    Rows that agree in id and text are told apart only by a running number.
    """
    keys = ["_id", "_crc", "_size"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.withColumns({"_id": F.col(id_col), "_crc": F.crc32(F.encode(text, "UTF-8")),
                            "_size": F.octet_length(text).cast("long") + ROW_OVERHEAD,
                            "_curve": hilbert_index(cells(docs, list(dims), bits), bits)})
    of = place(docs, shards, dims, bits, id_col, text_col).select(
        F.col(id_col).alias("_of_id"), F.col("size").alias("_of_size"), F.col("text_crc32").alias("_of_crc"),
        F.col("curve").alias("_of_curve"), "shard", F.col("slot").alias("_slot"))
    nth = Window.partitionBy("_curve", *keys).orderBy(F.lit(0))
    of_nth = Window.partitionBy("_of_curve", "_of_id", "_of_crc", "_of_size").orderBy("shard", "_slot")
    same = (F.col("_id").eqNullSafe(F.col("_of_id")) & (F.col("_crc") == F.col("_of_crc"))
            & (F.col("_size") == F.col("_of_size")) & (F.col("_curve") == F.col("_of_curve"))
            & (F.col("_n") == F.col("_of_n")))
    joined = (own.withColumn("_n", F.row_number().over(nth))
              .join(of.withColumn("_of_n", F.row_number().over(of_nth)), same))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    (joined.repartition("shard").sortWithinPartitions("shard", "_slot").select(*kept, "shard")
     .write.partitionBy("shard").parquet(folder))


def shard_ranges(sharded: DataFrame, dims=DIMENSIONS) -> DataFrame:
    """Rows and the minimum and maximum of every dimension per shard: what file pruning reads."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)])
