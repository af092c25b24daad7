"""Strict JSON ingest (S2): one JSON object per line, decoded the way the reference's
request reader decodes a body, with a reject code instead of an HTTP 400.

Decision order (first hit wins):

1. ``too_large``        more than 1,048,576 bytes
2. ``empty``            nothing but JSON whitespace
3. ``malformed``        the first value is not valid JSON
4. ``wrong_type`` / ``wrong_type:<field>`` / ``bad_time:<field>`` / ``unknown_field:<key>``
                        the first problem in document order: a top-level value that is
                        not an object, a member of the wrong JSON type, a time that is
                        not RFC 3339, a key matching no field (keys match
                        case-insensitively)
5. ``multiple_values``  anything but whitespace after the first value

Everything is built-in JVM expressions in one projection (no UDF, no shuffle):
``from_json(v, 'map<string,variant>')`` keeps every member in document order, repeats
included, and ``schema_of_variant`` names each member's JSON type; an array wrap
``[v]`` tells one value from several; ``try_parse_json`` accepts a first value that
is followed by trailing text. For accepted lines, each field takes the last non-null
occurrence of its (case-insensitive) key, as sequential decoding does.

A first value that is the literal ``null`` decodes to an empty body (every field
absent); with trailing text it is ``multiple_values``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.predicates import RFC3339_PATTERN
from muster.functions.time import instant_to_utc_ntz

MAX_BODY_BYTES = 1_048_576
# what Spark's reader takes beyond JSON
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedFieldNames": "false"}

_SPARK_TYPE = {"string": "string", "time": "timestamp_ntz", "bool": "boolean", "int": "bigint",
               "number": "double"}


@dataclass(frozen=True)
class InputField:
    name: str
    kind: str  # string | number | int | bool | time


def fields(*spec: str) -> tuple[InputField, ...]:
    """``fields("title:string", "default_credit_hours:number")``."""
    return tuple(InputField(*s.split(":")) for s in spec)


# fixed values: the JSON bodies each create / patch request accepts
INPUTS: dict[str, tuple[InputField, ...]] = {
    "officers": fields("regulation_number:string", "first_name:string", "last_name:string",
                       "sex:string", "rank_code:string"),
    "courses": fields("title:string", "category:string", "default_credit_hours:number",
                      "description:string"),
    "sessions": fields("course_id:string", "start_datetime:time", "end_datetime:time",
                       "location_text:string"),
    "facilitators": fields("first_name:string", "last_name:string", "notes:string"),
    "attendance": fields("officer_id:string", "session_id:string", "status:string",
                         "credited_hours:number"),
    "attendance_patch": fields("status:string", "credited_hours:number"),
    "session_feedback": fields("session_id:string", "officer_id:string", "facilitator_id:string",
                               "rating:number", "comments:string"),
    "session_facilitators": fields("session_id:string", "facilitator_id:string", "role:string"),
    "import_jobs": fields("type:string"),
    "users": fields("email:string", "password:string", "role:string"),
    "users_patch": fields("email:string", "role:string"),
    "token": fields("token:string"),
}


# JSON type codes of a member value (from ``schema_of_variant``)
T_NULL, T_STRING, T_BOOL, T_INT, T_FRACTION, T_OTHER = 0, 1, 2, 3, 4, 5
_ACCEPT_CODES = {"string": (T_STRING,), "time": (T_STRING,), "bool": (T_BOOL,), "int": (T_INT,),
                 "number": (T_INT, T_FRACTION)}
_KIND_CODE = {"string": 1, "time": 2, "bool": 3, "int": 4, "number": 5}


def _type_code(x: Column) -> Column:
    s = F.schema_of_variant(x)
    return (F.when(s == "STRING", T_STRING).when(s == "VOID", T_NULL)
            .when(s == "BIGINT", T_INT).when(s == "BOOLEAN", T_BOOL)
            .when((s == "DOUBLE") | (s == "FLOAT") | s.startswith("DECIMAL"), T_FRACTION)
            .when(s.isin("INT", "SMALLINT", "TINYINT"), T_INT).otherwise(T_OTHER))


def members(v: Column) -> Column:
    """Every member of the top-level object in document order, repeats included, as
    struct(k, lk = lower(k), x = value, tc = JSON type code); NULL when ``v`` does not
    start with a JSON object. Each member's key case and type are computed once here."""
    raw = F.map_entries(F.from_json(v, "map<string,variant>", STRICT))
    return F.transform(raw, lambda e: F.struct(
        e["key"].alias("k"), F.lower(e["key"]).alias("lk"), e["value"].alias("x"),
        _type_code(e["value"]).alias("tc")))


def parsed_time(text: Column) -> Column:
    """The instant an RFC 3339 text names; NULL if it breaks the format or names no time
    (30 February, hour 25, offset +99:00). Digits past the microsecond are dropped."""
    short = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(RFC3339_PATTERN), F.try_to_timestamp(short))


def value_count(v: Column) -> Column:
    """Number of comma-separated JSON values in ``v`` (NULL when ``[v]`` is not valid JSON)."""
    return F.size(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>", STRICT))


def classify(v: Column, spec: tuple[InputField, ...], entries: Column | None = None,
             n_values: Column | None = None, first_ok: Column | None = None) -> Column:
    """Reject code of one line (NULL when the line is accepted).

    ``entries`` = members(v), ``n_values`` = value_count(v), ``first_ok`` = whether the
    first value parses; pass precomputed columns to parse each line only once.
    """
    entries = members(v) if entries is None else entries
    n_values = value_count(v) if n_values is None else n_values
    first_ok = F.try_parse_json(v).isNotNull() if first_ok is None else first_ok
    kind_of = F.create_map(*[x for f in spec
                             for x in (F.lit(f.name.lower()), F.lit(_KIND_CODE[f.kind]))])
    name_of = F.create_map(*[x for f in spec for x in (F.lit(f.name.lower()), F.lit(f.name))])

    def accepted(kind: Column, tc: Column) -> Column:
        cond = None
        for k, code in _KIND_CODE.items():
            term = (kind == code) & tc.isin(list(_ACCEPT_CODES[k]))
            cond = term if cond is None else cond | term
        return cond

    def member_problem(e: Column) -> Column:
        kind = kind_of[e["lk"]]
        name = name_of[e["lk"]]
        return (F.when(kind.isNull(), F.concat(F.lit("unknown_field:"), e["k"]))
                .when(e["tc"] == T_NULL, F.lit(None).cast("string"))
                .when(~accepted(kind, e["tc"]), F.concat(F.lit("wrong_type:"), name))
                .when((kind == _KIND_CODE["time"]) & parsed_time(e["x"].cast("string")).isNull(),
                      F.concat(F.lit("bad_time:"), name)))

    first_problem = F.try_element_at(
        F.filter(F.transform(entries, member_problem), lambda p: p.isNotNull()), F.lit(1))
    head = F.ltrim(v, F.lit(" \t\n\r"))
    is_object = head.startswith("{")
    is_null = F.rtrim(head, F.lit(" \t\n\r")) == "null"
    null_first = first_ok & head.startswith("null")  # a JSON null, maybe with trailing text
    single = F.coalesce(n_values == 1, F.lit(False))
    malformed = n_values.isNull() & ~first_ok & entries.isNull() & ~is_null
    return (F.when(F.octet_length(v) > MAX_BODY_BYTES, F.lit("too_large"))
            .when(v.isNull() | (head == ""), F.lit("empty"))
            .when(malformed, F.lit("malformed"))
            .when(~is_object & ~null_first, F.lit("wrong_type"))
            .when(is_object & entries.isNull(), F.lit("malformed"))
            .when(first_problem.isNotNull(), first_problem)
            .when(~single & ~is_null, F.lit("multiple_values")))


def field_value(entries: Column, f: InputField) -> Column:
    """Typed value of one field: the last non-null occurrence of its key (any case)."""
    hits = F.filter(entries, lambda e: (e["lk"] == f.name.lower()) & (e["tc"] != T_NULL))
    x = F.try_element_at(hits, F.lit(-1))["x"]
    if f.kind == "time":
        return instant_to_utc_ntz(parsed_time(x.cast("string")))
    return x.cast(_SPARK_TYPE[f.kind])


def ingest_ndjson(df: DataFrame, spec: tuple[InputField, ...], text_col: str = "value",
                  keep=None) -> DataFrame:
    """Decode every line: the typed fields plus ``reject_code`` (NULL = accepted).

    Fields of rejected lines are NULL. ``keep`` names input columns to carry along
    (default: all but the text).
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else list(keep)
    # The parse and the reject code are produced as generator outputs (a one-row
    # inline): a later filter on them (e.g. "accepted rows only") cannot be pushed
    # below the generator, so the optimizer never copies the parse into a predicate
    # and each line is parsed exactly once.
    v = F.col(text_col)
    parsed = df.select(*keep, F.inline(F.array(F.struct(
        v.alias("_v"), members(v).alias("_e"), value_count(v).alias("_n"),
        F.try_parse_json(v).isNotNull().alias("_p")))))
    with_code = parsed.select(*keep, F.inline(F.array(F.struct(
        F.col("_e").alias("_e"),
        classify(F.col("_v"), spec, F.col("_e"), F.col("_n"), F.col("_p")).alias("reject_code")))))
    ok = F.col("reject_code").isNull()
    return with_code.select(
        *keep, "reject_code",
        *[F.when(ok, field_value(F.col("_e"), f)).alias(f.name) for f in spec])


def split_rejects(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows) of an ``ingest_ndjson`` result."""
    return (decoded.where(F.col("reject_code").isNull()),
            decoded.where(F.col("reject_code").isNotNull()))


def read_ndjson(spark, path: str, spec: tuple[InputField, ...], keep_text: bool = False) -> DataFrame:
    """Read NDJSON text files, one body per line feed (a carriage return is JSON whitespace), with
    the file's name; ``keep_text`` carries the line along."""
    df = spark.read.option("lineSep", "\n").text(path).withColumn("source_file", F.input_file_name())
    if keep_text:
        df = df.withColumn("line", F.col("value"))
    return ingest_ndjson(df, spec, "value")
