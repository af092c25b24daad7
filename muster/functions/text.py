"""Full-text matching: every query term occurs as a whole token of the column.

Semantics (plain text query, 'simple' configuration): the column is lower-cased and
split on every run of characters that are neither letters nor digits; a hyphenated
compound (``state-of-the-art``) is also a token of its own, next to its parts, as the
PostgreSQL parser emits it. The query is tokenised the same way; a row matches when
each query term is one of its tokens, in any order. No stemming, no stop words. A
query with no terms matches nothing.

All of it is one JVM-side expression (``split`` / ``regexp_extract_all`` + ``forall``
+ ``array_contains``) and needs no UDF. Compound tokens of the text are only
extracted when the query has a compound term, and only from texts with a joining hyphen.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: a token is a maximal run of letters and digits
SEPARATOR_PATTERN = r"[^\p{L}\p{N}]+"
# fixed value: a hyphenated compound is two or more such runs joined by single hyphens
# (a run is entered at its beginning and never given back, so a text without compounds is scanned once)
COMPOUND_PATTERN = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++(?:-[\p{L}\p{N}]++)+"
# what every compound holds; tried at hyphens alone (no look back over a hyphen: Java's fails past the 16-bit plane)
JOINT_PATTERN = r"-[\p{L}\p{N}]"


def compound_tokens(col: Column | str) -> Column:
    """array<string> of the hyphenated compounds of ``col``, lower-cased."""
    c = F.col(col) if isinstance(col, str) else col
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(low, F.lit("-")) & low.rlike(JOINT_PATTERN), F.regexp_extract_all(low, F.lit(COMPOUND_PATTERN), 0)) \
        .otherwise(F.array().cast("array<string>"))


def text_tokens(col: Column | str) -> Column:
    """array<string> of the lower-case tokens of ``col`` (NULL text → no tokens)."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), SEPARATOR_PATTERN, -1)
    return F.array_remove(parts, "")


def matches_all_terms(col: Column | str, q: str) -> Column:
    """Boolean column: every term of ``q`` is a token of ``col``.

    The query is tokenised by the same expressions as the column; as a literal it is folded to
    constant arrays when the query is planned.
    """
    if not q.strip():
        return F.lit(False)
    wanted = text_tokens(F.lit(q))
    found = (F.size(wanted) > 0) & (F.size(F.array_except(wanted, text_tokens(col))) == 0)
    if "-" not in q:
        return found
    return found & (F.size(F.array_except(compound_tokens(F.lit(q)), compound_tokens(col))) == 0)


# --- token classes ------------------------------------------------------------------------------
# fixed values: the token classes of PostgreSQL's default parser, longest class first at every place
_HOST = r"(?:[a-z0-9][a-z0-9_-]*\.)+[a-z][a-z0-9-]*[a-z0-9](?::[0-9]+)?"
_END = r"(?![\p{L}\p{N}])"
_WORD = r"\p{N}*\p{L}[\p{L}\p{N}]*"
TOKEN_CLASSES = {
    "tag": r"<[a-z/!?][^<>]*>",
    "entity": r"&(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);",
    "protocol": r"[a-z][a-z0-9]*://",
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._-]*@" + _HOST,
    "url": _HOST + r"/[^\s\"<>\\^`{|}]*",
    "file": r"(?:~?/|[a-z0-9_][a-z0-9_.-]*/)[a-z0-9_.-]*[a-z0-9_](?:/[a-z0-9_.-]*[a-z0-9_])*",
    "host": _HOST + _END,
    "version": r"[0-9]+(?:\.[0-9]+){2,}" + _END,
    "sfloat": r"[+-]?[0-9]+(?:\.[0-9]+)?e[+-]?[0-9]+" + _END,
    "float": r"[+-]?[0-9]+\.[0-9]+" + _END,
    "hword": _WORD + "(?:-" + _WORD + ")+",
    "int": r"[+-][0-9]+" + _END,
    "word": _WORD,
    "uint": r"\p{N}+",
}
# a maximal run of letters and digits that no longer class can begin with, by the characters after it; the
# last two classes give the same token there, but tried in their order every class would scan the run first
_PLAIN = r"[\p{L}\p{N}]++(?![_@/+-]|://|\.\S)"
#: classes that are read and not indexed
SILENT_CLASSES = ("tag", "entity", "protocol")


def class_tokens(col: Column | str) -> Column:
    """array<string> of the lower-case tokens of ``col`` by class, as PostgreSQL's default parser cuts a text.

    E-mail addresses, hosts, URLs, file paths, versions and signed, decimal or scientific numbers are
    tokens of their own. A URL gives itself, its host and its path; a hyphenated word gives itself and its parts;
    tags, entities and protocols give nothing. At every place the class listed first that matches wins. NULL
    and empty texts have no tokens. One scan of the text by one pattern, no UDF.
    """
    c = F.col(col) if isinstance(col, str) else col
    every = "|".join(f"(?:{p})" for p in [_PLAIN, *TOKEN_CLASSES.values()])
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(every), 0)

    def given(t: Column) -> Column:
        def is_a(name: str) -> Column:
            return t.rlike(f"^(?:{TOKEN_CLASSES[name]})$")

        silent = is_a("tag") | is_a("entity") | is_a("protocol")
        path = F.locate("/", t)
        url = F.array(t, F.substring(t, F.lit(1), path - 1), F.substring(t, path, F.length(t)))
        # most tokens are letters and digits alone and need no test of a class
        return (F.when(~t.rlike(SEPARATOR_PATTERN), F.array(t))
                .when(silent, F.array().cast("array<string>")).when(is_a("email"), F.array(t)).when(is_a("url"), url)
                .when(is_a("hword"), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t)))

    return F.flatten(F.transform(found, given))


def matches_all_class_terms(col: Column | str, q: str) -> Column:
    """Boolean column: every token of ``q`` by class is a token of ``col`` by class."""
    return F.size(matching_class_queries(col, [q])) > 0


def matching_class_queries(col: Column | str, queries: Sequence[str]) -> Column:
    """array<string> of those of ``queries`` whose every token by class is a token of ``col`` by class.

    A text is cut at most once for all queries, and only if it contains the tokens of one of them as
    substrings: every token is a substring of the lower-case text.
    """
    c = F.col(col) if isinstance(col, str) else col

    def once(value: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of the value, which a lambda binds: it is computed once however often ``then`` uses it."""
        return F.transform(F.array(value), then)[0]

    # the queries are constants: their tokens are folded when the query is planned
    asked = F.array(*[F.struct(F.lit(q).alias("q"), class_tokens(F.lit(q)).alias("wanted")) for q in queries])

    def likely(low: Column) -> Column:
        return F.filter(asked, lambda a: (F.size(a["wanted"]) > 0) & F.forall(a["wanted"], lambda w: F.contains(low, w)))

    def held(some: Column) -> Column:
        return F.when(F.size(some) > 0, once(class_tokens(c), lambda tokens: F.transform(
            F.filter(some, lambda a: F.size(F.array_except(a["wanted"], tokens)) == 0), lambda a: a["q"]))) \
            .otherwise(F.array().cast("array<string>"))

    return once(once(F.lower(F.coalesce(c, F.lit(""))), likely), held)
