"""Words and their k-gram hashes in built-in functions, and joins with a side of checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import lower_ascii

#: what separates words (fixed value): all ASCII but digits and lower-case letters
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: a side is broadcast only up to this many (narrow) rows
BROADCAST_ROWS = 100_000
#: and one of single numbers up to so many
KEY_ROWS = 400_000


def normalized(text: Column) -> Column:
    """The words of a text, A-Z in lower case, joined by single spaces; null counts as empty.

    ``lower`` is much faster than a character map. It also changes letters beyond A-Z, but only two
    of those become ASCII letters; texts that hold one of them take the map.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = ~(F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K")))
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(lower_ascii(text)), NOT_WORD, " "))


def word_array(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def gram_hashes(words: Column, offsets: tuple[int, ...], salt: int = 0) -> Column:
    """Hash of the words at ``offsets`` from every position where they all exist, in order.

    ``words`` must be a plain column: an expression would be computed again at every position.
    """
    last = F.size(words) - F.lit(offsets[-1] + 1)
    grams = F.transform(F.sequence(F.lit(0), last),
                        lambda i: F.xxhash64(F.lit(salt), *[F.get(words, i + o) for o in offsets]))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<bigint>"))


def text_key(text: Column) -> Column:
    """Together with the id, tells apart rows that repeat an id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def small(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within the bound; else as it is."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df
