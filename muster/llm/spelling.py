"""Spelling variants: words one edit apart, found by a frontier that walks a trie held as a table.

**Words.** Tasks count the words of their documents and hand on one row per distinct word they met.

**Trie.** A node is a prefix of a word, a row of the edge table holds its children, at most one for each
letter of the alphabet, with the letters that follow each child. There are two tries, of the words and
of the reversed words.

**Frontier.** A state is (word, position, node, edits): ``rest`` is what lies behind the position. All
states of one depth are joined with that depth's nodes, and so on level by level, so every edge is read
once. A state without an edit follows its own letter, takes any other child instead (a replaced letter),
or skips its own letter (a deleted one); a state with an edit can only follow its letters. A state that
has read its whole word on a word's node with one edit has found a neighbour. Inserted letters are
deleted ones seen from the other word. An edit lies in the second half of a word or in the first half,
which is the second of the reversed word; so states start in the middle of a word in both tries, where
tries are sparse, and a step is taken only if the child can go on.

**Long words.** A word of over ``SHORT`` letters would ask for as many levels. Pairs with such a word meet
by the hashes of all their one-letter deletions (rolling, a row per letter) and are verified.

**Roots.** Forms are followed by pointer doubling; counts at least double along a chain, so chains are short.

Defined results: null texts hold no words; a null id counts as an empty string in a word's hash; repeated
rows count again; a text of one run of any length is a word like any other; empty tables give an empty
result; further columns are ignored, whatever their names. Ties of counts go to the word that is smaller in
code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import stored
from muster.llm.divergence import HELD_TERMS, pieces

#: letters of a word and its occurrences, at least; a run whose hash this number divides loses a letter
LEAST_LETTERS, LEAST_COUNT, LOSES = 5, 3, 97
#: words up to so many letters are found in the trie; beyond, by deletions
SHORT = 32

#: of Latin-1: letters stay, A-Z in lower case; all else separates
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: two odd multipliers of rolling hashes
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

Batches = Iterator[pa.RecordBatch]


def variant(doc: bytes, word: bytes) -> bytes:
    """The word (Latin-1) that a document's run counts as; ``doc`` is the id in UTF-8."""
    utf8 = word if word.isascii() else word.decode("latin-1").encode()
    h = zlib.crc32(doc + b":" + utf8)
    at = h % len(word)
    return word if h % LOSES else word[:at] + word[at + 1:]


def _count_words(batches: Batches, least: int) -> Batches:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in held]
        counts = list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own: Counter[bytes] = Counter()
            for part in pieces(text.encode("latin-1", "replace").translate(_RUNS)):
                own.update(part.split())
            name = doc.encode()
            for word, n in own.items():
                if len(word) >= least:
                    held[variant(name, word)] += n
        if len(held) > HELD_TERMS:
            yield flush()
    if held:
        yield flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
               least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), text.alias("text"))
    return (rows.mapInArrow(lambda b: _count_words(b, least_letters), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.col("n") >= least_count) & (F.length("word") >= least_letters)))


# --- the trie ------------------------------------------------------------------------------------
def _both_ways(words: DataFrame) -> DataFrame:
    """(word, way, read): each word as it is and reversed; ``way`` marks the trie."""
    return words.select("word", F.explode(F.array(
        F.struct(F.lit(">").alias("way"), F.col("word").alias("read")),
        F.struct(F.lit("<").alias("way"), F.reverse("word").alias("read")))).alias("w")).select("word", "w.way", "w.read")


def edge_table(words: DataFrame, least_depth: int) -> DataFrame:
    """(depth, node, final, children): nodes from ``least_depth`` letters on with their children.

    A node is its trie's mark and a prefix; a child is its letter, whether it ends a word, and the letters
    that follow it.
    """
    depths = F.explode(F.sequence(F.lit(least_depth), F.length("read"))).alias("depth")
    nodes = (_both_ways(words).where(F.length("read") >= least_depth).select("way", "read", depths)
             .select("depth", F.concat("way", F.substring("read", F.lit(1), F.col("depth"))).alias("node"),
                     F.substring("read", F.col("depth") + 1, F.lit(1)).alias("letter"))
             .groupBy("depth", "node").agg(F.concat_ws("", F.collect_set("letter")).alias("next"),
                                           F.max(F.col("letter") == "").alias("final")))
    own = nodes.select("depth", "node", "final", F.lit(None).cast("struct<letter:string,final:boolean,next:string>").alias("child"))
    child = F.struct(F.substring("node", -1, 1).alias("letter"), "final", "next")
    above = nodes.where(F.col("depth") > least_depth).select(
        F.col("depth") - 1, F.expr("substring(node, 1, length(node) - 1)").alias("node"), F.lit(False), child)
    table = own.union(above).groupBy("depth", "node").agg(F.max("final").alias("final"), F.collect_list("child").alias("children"))
    return stored(table.repartitionByRange("depth", "node").sortWithinPartitions("depth", "node"), "spelling-trie")


def _letter(text: Column, at: int) -> Column:
    return F.substring(text, at, 1)


def _behind(text: Column, n: int) -> Column:
    return F.substring(text, n + 1, 1 << 30)


def _goes_on(child: Column, rest: Column) -> Column:
    """Whether ``rest`` can be read from a child: its first letter follows, or it is empty at a word's end."""
    return F.when(rest == "", child["final"]).otherwise(F.contains(child["next"], _letter(rest, 1)))


def _steps() -> Column:
    """The states one level down from (node, rest, edits) and the node's row."""
    rest, after, behind = F.col("rest"), _behind(F.col("rest"), 1), _behind(F.col("rest"), 2)

    def down(keep, left: Column, edits: int) -> Column:
        return F.transform(F.filter("children", keep), lambda c: F.struct(
            F.concat("node", c["letter"]).alias("node"), left.alias("rest"), F.lit(edits).alias("edits")))

    follow = down(lambda c: (c["letter"] == _letter(rest, 1)) & _goes_on(c, after), after, 1)
    same = down(lambda c: (c["letter"] == _letter(rest, 1)) & (after != ""), after, 0)
    replaced = down(lambda c: (c["letter"] != _letter(rest, 1)) & _goes_on(c, after), after, 1)
    # a skipped letter and the step behind it; if none is left, the node itself must end a word
    skipped = down(lambda c: (after != "") & (c["letter"] == _letter(after, 1)) & _goes_on(c, behind), behind, 1)
    at_end = F.filter(F.array(F.struct("node", after.alias("rest"), F.lit(1).alias("edits"))),
                      lambda s: (s["rest"] == "") & F.col("final"))
    return F.when(F.col("edits") == 1, follow).otherwise(F.concat(same, replaced, skipped, at_end))


def trie_pairs(words: DataFrame, least_letters: int, longest: int) -> DataFrame:
    """(word, near) for words of up to ``SHORT`` letters: replaced letters both ways, deleted ones one way."""
    least_depth = least_letters // 2
    trie = edge_table(words, least_depth)
    half = F.expr("length(word) div 2")
    start = F.when(F.col("way") == ">", half).otherwise(F.length("word") - half)
    starts = stored(_both_ways(words).withColumn("depth", start.cast("int")).select(
        "word", "depth", F.concat("way", F.expr("substring(read, 1, depth)")).alias("node"),
        F.expr("substring(read, depth + 1)").alias("rest"), F.lit(0).alias("edits"))
        .repartitionByRange("depth", "node"), "spelling-starts")
    found, frontier = [], None
    for depth in range(least_depth, longest + 1):
        states = starts.where(F.col("depth") == depth).drop("depth")
        if frontier is not None:
            states = states.unionByName(frontier.where("rest <> ''"))
        nodes = trie.where(F.col("depth") == depth).drop("depth")
        frontier = stored(states.join(nodes, "node").select("word", F.explode(_steps()).alias("s"))
                          .select("word", "s.node", "s.rest", "s.edits"), "spelling-frontier")
        found.append(frontier.where("rest = '' and edits = 1"))
    read = F.substring("node", 2, 1 << 30)
    near = F.when(F.substring("node", 1, 1) == ">", read).otherwise(F.reverse(read))
    return reduce(DataFrame.unionByName, found).select("word", near.alias("near")) if found else words.select(
        "word", F.col("word").alias("near")).limit(0)


# --- long words ----------------------------------------------------------------------------------
def _deletions(batches: Batches) -> Batches:
    """(h1, h2, letters, at, word): hashes of a word (at = -1) and of it without its letter ``at``."""
    for batch in batches:
        for word in batch.column("word").to_pylist():
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) * np.uint64(_STEPS[1]) + np.uint64(1)
            n, hashes = len(codes), []
            for step in _STEPS:
                powers = np.cumprod(np.full(n, step, np.uint64), dtype=np.uint64)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
                back = np.uint64(pow(step, -1, 1 << 64))
                hashes.append(np.concatenate([sums[-1:], sums[:-1] + (sums[-1] - sums[1:]) * back]).view(np.int64))
            letters = np.full(n + 1, n - 1, np.int32)
            letters[0] = n
            for at in range(0, n + 1, 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[0][part]), pa.array(hashes[1][part]), pa.array(letters[part]),
                     pa.array(np.arange(-1, n, dtype=np.int32)[part]), pa.array([word] * len(letters[part]), pa.string())],
                    names=["h1", "h2", "letters", "at", "word"])


def long_pairs(words: DataFrame) -> DataFrame:
    """(word, near) where one of the two has over ``SHORT`` letters; words of ``SHORT`` letters on take part.

    The rows carry a number for the word; its text is joined for the pairs that meet.
    """
    numbered = stored(words.where(F.length("word") >= SHORT).withColumn("w", F.monotonically_increasing_id()), "spelling-long")
    short = numbered.select("word")
    number = numbered.select("word", "w")
    rows = stored(short.mapInArrow(_deletions, "h1 long, h2 long, letters int, at int, word string")
                  .join(number, "word").drop("word"), "spelling-deletions")
    cut = rows.where("at >= 0")
    # words that differ in one and the same letter: at most as many as the alphabet has letters
    several = cut.groupBy("h1", "h2", "letters", "at").agg(F.collect_set("w").alias("ws")).where(F.size("ws") > 1)
    replaced = several.select("at", F.explode("ws").alias("a"), "ws").select("at", "a", F.explode("ws").alias("b")).where("a <> b")
    whole = rows.where("at < 0").select("h1", "h2", "letters", F.col("w").alias("b"))
    deleted = cut.join(whole, ["h1", "h2", "letters"]).select("at", F.col("w").alias("a"), "b")
    pairs = replaced.unionByName(deleted).groupBy("a", "b").agg(F.min("at").alias("at"))
    named = (pairs.join(number.select(F.col("w").alias("a"), "word"), "a")
             .join(number.select(F.col("w").alias("b"), F.col("word").alias("near")), "b"))
    without = F.expr("concat(substring(word, 1, at), substring(word, at + 2))")
    other = F.when(F.length("word") == F.length("near"), F.expr("concat(substring(near, 1, at), substring(near, at + 2))")
                   ).otherwise(F.col("near"))
    return named.where((F.greatest(F.length("word"), F.length("near")) > SHORT) & (without == other)).select("word", "near")


# --- forms ---------------------------------------------------------------------------------------
def neighbours(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """Distinct (word, near), both ways, of a table of distinct words (column ``word``)."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    pairs = trie_pairs(words.where(F.length("word") <= SHORT).select("word"), least_letters, min(longest, SHORT))
    if longest > SHORT:
        pairs = pairs.unionByName(long_pairs(words.select("word")))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: where following forms ends."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        there = at.select(F.col("word").alias("_w"), F.col("root").alias("further"))
        step = stored(at.join(there, F.col("root") == F.col("_w"), "left").select("word", "root", "further"), "spelling-roots")
        at = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.where("further is not null").isEmpty():
            return at


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
          least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    if least_letters < 4:
        raise ValueError("words need four letters at least")
    words = stored(vocabulary(docs, id_col, text_col, least_letters, least_count), "spelling-words")
    near = neighbours(words, least_letters).join(words.select(F.col("word").alias("near"), "n"), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    leads = -F.col("best.less") >= 2 * F.col("n")
    known = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.near")).alias("form"),
        F.when(leads, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return (known.join(roots(known.where("form is not null").select("word", "form")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
