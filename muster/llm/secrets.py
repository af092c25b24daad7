"""Secret scan with a battery of randomness tests (built-in functions only).

Three fixed patterns give the base spans. The method adds spans of kind ``random``: every maximal run of
``RUN_CHARS`` or more characters of base 62, of base 64 or of its URL form (with closing ``=``) is a
candidate, whatever it mixes, so a token after a path's ``/`` is one of its own; of candidates inside
each other the widest that is found counts. A candidate's encoding is the smallest alphabet that holds it
(hexadecimal in either case, base 32, base 36, base 62, base 64 in either form). Over the symbols'
numbers three tests are computed:

* chi-squared uniformity over the alphabet,
* the number of runs above and below the middle of the alphabet (Wald-Wolfowitz),
* the lag-1 serial correlation.

Their z-scores are combined (Stouffer's sum over absolute deviations) to ask whether the string is
consistent with random symbols. That a *structured* string (words, identifiers) passes by luck is the
false discovery to control: under a structured null with a higher chance that two symbols agree, the
uniformity statistic has a mean and a spread that depend on the length, so short strings cannot get a
small p-value. The p-values of all distinct candidate strings of the corpus go through the
Benjamini-Hochberg procedure within each length class, on a fixed grid of p-values (rounded up), so
only a constant number of counts decides the cut. Copies count once.

A document's texts are read twice (base spans; candidates); candidates alone are shuffled.

Defined results: null and empty texts have no spans (empty strings; the hash of the empty string);
repeated rows give one result row each; without candidates nothing is added; an empty table gives an
empty result; further columns are ignored (``scan``) or kept (``redact``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import stored
from muster.llm.words import small, text_key

# The base kinds in order, with pattern, counted group and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: what a text must hold before a pattern is run over it; each follows from its pattern and length
GATES = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{16}",
         "hex": "[0-9a-f]{24}"}
#: runs shorter than 24 cannot count, so they need not be matched: maximal runs stay the same
MATCHED = {"hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
RANDOM = "random"

RUN_CHARS = 20
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: runs of one alphabet inside a run of all
INNER = tuple(rf"(?<![{a}])[{a}]{{20,}}={{0,2}}" for a in ("A-Za-z0-9", "A-Za-z0-9+/", "A-Za-z0-9_-"))
# Alphabets by name, smallest first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
CONSISTENT = 0.001  # least combined p-value of the battery
DISCOVERY_RATE = 0.05
TEXT_AGREES = 0.066  # chance that two letters of running text agree
GRID, GRID_END = 100, 800  # p-values are kept as hundredths of -log10, up to 10^-8


# --- matches with places -------------------------------------------------------------------------
def places(text: Column, kind: str, pattern: str, group: int, least: int, gate: str) -> Column:
    """array<struct<start,kind,end>> of all matches whose group is long enough, in code points."""
    whole = f"({pattern})"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("m"),
                         F.regexp_extract_all(text, F.lit(whole), F.lit(group + 1)).alias("g"),
                         F.split(text, whole, -1).alias("between"))
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    walked = F.aggregate(
        found, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc.at + F.length(x["between"]) + F.coalesce(F.length(x.m), F.lit(0))).alias("at"),
            F.when(F.length(x.g) >= least, F.array_append(acc.out, F.struct(
                (acc.at + F.length(x["between"])).alias("start"), F.lit(kind).alias("kind"),
                (acc.at + F.length(x["between"]) + F.length(x.m)).alias("end")))).otherwise(acc.out).alias("out")),
        lambda acc: acc.out)
    return F.when(F.rlike(text, F.lit(gate)), walked).otherwise(empty)


def base_spans(text: Column) -> dict[str, Column]:
    return {kind: places(text, kind, MATCHED.get(kind, pattern), group, least, GATES[kind])
            for kind, pattern, group, least in BASE}


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    kinds = F.array(*[F.lit(k) for k, *_ in BASE], F.lit(RANDOM))
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.array_position(kinds, s.kind).alias("rank"),
                                                  s.kind.alias("kind"), s.end.alias("end")))
    return F.array_sort(keyed)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(_ordered(spans), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


# --- the battery ---------------------------------------------------------------------------------
def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution (the usual five-term rational approximation)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    terms = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * terms
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(strings: DataFrame, col: str = "token") -> DataFrame:
    """``strings`` with encoding, symbols, the tests' z-scores, ``p_random`` and ``p_structured``.

    Strings outside every alphabet get null throughout.
    """
    body = F.rtrim(F.col(col), F.lit("="))
    name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, letters in reversed(ALPHABETS):
        fits = F.translate(body, letters, "") == ""
        name, alphabet = F.when(fits, n).otherwise(name), F.when(fits, letters).otherwise(alphabet)
    df = strings.withColumns({"encoding": name, "_alphabet": alphabet})
    df = df.withColumn("_v", F.transform(F.split(body, ""), lambda c: F.instr(F.col("_alphabet"), c) - 1))
    # one pass over the symbols in order: runs and serial products; one over them sorted: equal symbols
    df = df.withColumns({"symbols": F.size("_v").cast("double"), "_k": F.length("_alphabet").cast("double")})
    df = df.withColumn("_walk", F.expr("""
        aggregate(_v, named_struct('prev', -1, 'high', 0D, 'runs', 0D, 's', 0D, 'ss', 0D, 'sp', 0D),
          (a, x) -> named_struct(
            'prev', x, 'high', a.high + if(x * 2 >= _k, 1D, 0D),
            'runs', a.runs + if(a.prev < 0 or (x * 2 >= _k) <> (a.prev * 2 >= _k), 1D, 0D),
            's', a.s + x, 'ss', a.ss + cast(x as double) * x,
            'sp', a.sp + if(a.prev < 0, 0D, cast(a.prev as double) * x)))"""))
    df = df.withColumn("_pairs", F.expr("""
        aggregate(array_sort(_v), named_struct('prev', -1, 'run', 0D, 'sq', 0D),
          (a, x) -> named_struct('prev', x, 'run', if(x = a.prev, a.run + 1, 1D),
                                 'sq', a.sq + if(x = a.prev, 2 * a.run + 1, 1D)),
          a -> a.sq)"""))
    n, k = F.col("symbols"), F.col("_k")
    high, low = F.col("_walk.high"), n - F.col("_walk.high")
    chi = k / n * F.col("_pairs") - n
    mean_runs = 2 * high * low / n + 1
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    mean = F.col("_walk.s") / n
    spread = F.col("_walk.ss") - n * mean * mean
    first_last = F.element_at("_v", 1) + F.element_at("_v", -1)
    lagged = F.col("_walk.sp") - mean * (2 * F.col("_walk.s") - first_last) + (n - 1) * mean * mean
    df = df.withColumns({
        "chi_squared": chi,
        "z_uniform": (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n),
        # all symbols on one side or all equal: as far from random as it gets
        "z_runs": F.when(var_runs > 0, (F.col("_walk.runs") - mean_runs) / F.sqrt(var_runs)).otherwise(-8.0),
        "z_serial": F.when(spread > 0, (lagged / spread + 1 / n) * F.sqrt(n)).otherwise(8.0)})
    worst = (F.greatest(F.col("z_uniform"), F.lit(0.0)) + F.abs("z_runs") + F.abs("z_serial")) / F.sqrt(F.lit(3.0))
    # the sum of one half-normal and two folded normals, centred and scaled
    centred = (worst - 1.1517) / 0.5966
    agrees = F.greatest(F.lit(TEXT_AGREES), 2 / k)
    structured_mean = k + k * (n - 1) * agrees - n
    structured_sd = k / n * F.sqrt(4 * n * n * n * 0.28 * agrees * agrees + 2 * n * n * agrees)
    return (df.withColumn("p_random", _upper_tail(centred))
            .withColumn("p_structured", 1 - _upper_tail((F.col("chi_squared") - structured_mean) / structured_sd))
            .drop("_alphabet", "_v", "_walk", "_pairs", "_k"))


def _length_class(symbols: Column) -> Column:
    """Half octaves of the length."""
    return F.floor(2 * F.log2(symbols)).cast("int")


def discoveries(tested: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """The cut of every length class, as a grid value: strings at or beyond it are discoveries.

    ``tested`` has one row per distinct string with ``length_class`` and ``grid``. A constant number
    of counts (classes times grid values) is ordered.
    """
    counts = tested.groupBy("length_class", "grid").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("length_class").orderBy(F.desc("grid"))
    rank = F.sum("n").over(down)
    total = F.sum("n").over(Window.partitionBy("length_class"))
    p = F.pow(F.lit(10.0), -F.col("grid") / GRID)
    return (counts.withColumns({"rank": rank, "total": total})
            .where(p <= F.lit(rate) * F.col("rank") / F.col("total"))
            .groupBy(F.col("length_class").alias("_class")).agg(F.min("grid").alias("cut")))


def _widest(spans: Column) -> Column:
    """Those that no other span holds; the spans are distinct. One pass in order of the starts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), s.alias("span"))))
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return F.aggregate(
        ordered, F.struct(F.lit(-1).alias("reach"), none.alias("out")),
        lambda acc, x: F.struct(F.greatest(acc.reach, x.span.end).alias("reach"),
                                F.when(x.span.end > acc.reach, F.array_append(acc.out, x.span)).otherwise(acc.out).alias("out")),
        lambda acc: acc.out)


def random_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rate: float = DISCOVERY_RATE) -> DataFrame:
    """id, key (of the text), random_spans: an array per text that has any."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    runs = (docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), text.alias("text"))
            .select("id", "key", "text", F.explode(places(F.col("text"), RANDOM, RUN, 0, RUN_CHARS, "[A-Za-z0-9+/_-]{20}"))
                    .alias("span"))
            .select("id", "key", F.col("span.start").alias("at"),
                    F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start")).alias("run")))
    inner = F.concat(*[places(F.col("run"), RANDOM, pattern, 0, RUN_CHARS, "[A-Za-z0-9]{20}|[+/]|[_-]") for pattern in INNER])
    runs = (runs.select("id", "key", "at", "run", F.explode(F.array_distinct(inner)).alias("in"))
            .select("id", "key",
                    F.struct((F.col("at") + F.col("in.start")).alias("start"), F.col("in.kind").alias("kind"),
                             (F.col("at") + F.col("in.end")).alias("end")).alias("span"),
                    F.substring(F.col("run"), F.col("in.start") + 1, F.col("in.end") - F.col("in.start")).alias("token")))
    runs = stored(runs, "secret-runs")
    tested = stored(
        battery(runs.select("token").distinct())
        .where(F.col("encoding").isNotNull())
        .withColumn("length_class", _length_class(F.col("symbols")))
        # rounded towards 1, so that the grid never makes a p-value smaller
        .withColumn("grid", F.least(F.lit(GRID_END), F.floor(
            -F.log10(F.greatest("p_structured", F.lit(1e-300))) * GRID)).cast("int"))
        .select("token", "length_class", "grid", "p_random"), "secret-tests")
    cuts = discoveries(tested, rate)
    chosen = (tested.join(F.broadcast(cuts), F.col("length_class") == F.col("_class"))  # one row a class
              .where((F.col("grid") >= F.col("cut")) & (F.col("p_random") >= CONSISTENT)).select("token"))
    return (runs.join(chosen, "token")
            .groupBy("id", "key").agg(F.collect_set("span").alias("random_spans"))
            .withColumn("random_spans", _widest(F.col("random_spans"))))


# --- whole documents -----------------------------------------------------------------------------
def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__base`` (struct of arrays by kind) and ``__random``."""
    found = stored(random_spans(docs, id_col, text_col)
                   .withColumnsRenamed({"id": "__id", "key": "__key", "random_spans": "__random"}), "secret-spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    base = F.struct(*[c.alias(kind) for kind, c in base_spans(text).items()])
    own = [F.col(f"`{c}`") for c in docs.columns]
    return (docs.select(*own, base.alias("__base"), text_key(F.col(text_col)).alias("__text_key"))
            .join(small(found, found.count()), F.col(id_col).eqNullSafe(F.col("__id"))
                  & (F.col("__text_key") == F.col("__key")), "left")
            .withColumn("__random", F.coalesce("__random", none)).drop("__id", "__key", "__text_key"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: counts and a digest of the base spans, all spans, and those the method adds."""
    df = _with_spans(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    kinds = [k for k, *_ in BASE]
    base = F.concat(*[F.col(f"__base.{k}") for k in kinds])
    return df.select(
        F.col(id_col), *[F.size(f"__base.{k}").cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, F.col("__random"))).alias("spans"),
        F.size("__random").cast("long").alias("n_random"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one); texts without stay as they are."""
    df = _with_spans(docs, id_col, text_col)
    spans = F.array_sort(F.concat(*[F.col(f"__base.{k}") for k, *_ in BASE], F.col("__random")))
    text = F.col(text_col)

    def step(acc, s):
        gap = F.substring(text, acc.at + 1, s.start - acc.at)
        return F.when(s.start >= acc.at, F.struct(s.end.alias("at"), F.concat(acc.out, gap, F.lit(mark)).alias("out"))) \
            .otherwise(F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out")))

    cut = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                      lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    clean = F.when(F.size(spans) > 0, cut).otherwise(text)
    return df.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
