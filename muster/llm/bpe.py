"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap by ``overlap_chars``. Every
chunk is pre-tokenised on its own, in parallel, starting at its first character whether or not a
pre-token starts there. The pattern looks only forward, so once two streams share a boundary they
agree from there on; neighbouring chunks are stitched at their first common boundary inside the
overlap. Between two stitches a chunk's pre-tokens are those of the whole text, and its pieces are
merged into ids independently. A boundary closer than ``EDGE`` characters to a chunk's right end is
not trusted (a contraction or a run of spaces could continue), nor is a match that ends there.

Where two chunks share no trusted boundary (an unbroken run longer than the overlap), the whole
text is pre-tokenised in one piece, so the result is always exact.

Short texts are one chunk and take no shuffle. Long ones shuffle their chunk texts once.
Decoding concatenates the raw bytes of the tokens.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows give one
result row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import stored, tidy

Batches = Iterator[pa.RecordBatch]

EDGE = 4
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: entries of a worker's piece cache; it is emptied when full, so memory stays bounded
CACHE_ENTRIES = 400_000
DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"


class PieceIds(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes, filled on demand."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[piece] = np.asarray(self._encode(piece), dtype="<u4").tobytes()
        return ids


@lru_cache(maxsize=4)
def codec(ranks_path: str | None):
    """(pre-token pattern, piece cache, token bytes by id) of a rank file; once per worker."""
    import public_tokenizers
    import regex
    import tiktoken

    path = ranks_path or public_tokenizers.path(DEFAULT_RANKS)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=ranks, special_tokens={})
    token_bytes = {rank: token for token, rank in ranks.items()}
    return regex.compile(public_tokenizers.PATTERN), PieceIds(encoding.encode_ordinary), token_bytes


def encode_text(text: str, ranks_path: str | None = None) -> bytes:
    """Ids of one text as little-endian unsigned 32-bit bytes."""
    pattern, ids, _ = codec(ranks_path)
    return b"".join(map(ids.__getitem__, pattern.findall(text)))


def decode_ids(ids: bytes, ranks_path: str | None = None) -> bytes:
    """Raw bytes of the tokens, concatenated."""
    token_bytes = codec(ranks_path)[2]
    return b"".join(map(token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _lists(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


@tidy
def _cut(batches: Batches, chunk: int, overlap: int) -> Batches:
    """One row per chunk; a batch per text, so no more than one text's chunks are held."""
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            starts = list(range(0, max(1, len(text) - overlap), chunk))
            yield pa.RecordBatch.from_arrays([
                batch.column("row").take(pa.array([i] * len(starts))),
                pa.array(range(len(starts)), pa.int64()), pa.array(starts, pa.int64()),
                pa.array([text[s:s + chunk + overlap] for s in starts], pa.string()),
                pa.array([s == starts[-1] for s in starts])],
                names=["row", "chunk", "start", "body", "last"])


@tidy
def _edges(batches: Batches, chunk: int, overlap: int, ranks_path: str | None) -> Batches:
    """Trusted boundaries of each chunk inside the overlaps with its two neighbours."""
    pattern = codec(ranks_path)[0]
    for batch in batches:
        heads, tails = [], []
        for start, body, last in _lists(batch, "start", "body", "last"):
            trusted = len(body) if last else len(body) - EDGE
            ends = [0, *(m.end() for m in pattern.finditer(body))]
            heads.append([start + e for e in ends if e <= min(overlap, trusted)])
            tails.append([start + e for e in ends if chunk <= e <= trusted])
        bounds = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("chunk"), pa.array(heads, bounds), pa.array(tails, bounds)],
            names=["row", "chunk", "head", "tail"])


@tidy
def _pieces(batches: Batches, ranks_path: str | None) -> Batches:
    """Ids of the pieces between a chunk's two stitches, matched with the text that follows them."""
    pattern, cache, _ = codec(ranks_path)
    for batch in batches:
        ids = []
        for start, body, cut, until in _lists(batch, "start", "body", "cut", "until"):
            pieces = takewhile(lambda m, end=until - start: m.start() < end,
                               pattern.finditer(body, cut - start))
            ids.append(b"".join(cache[m.group()] for m in pieces))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("chunk"), pa.array(ids, pa.binary())],
            names=["row", "chunk", "ids"])


@tidy
def _whole(batches: Batches, ranks_path: str | None) -> Batches:
    for batch in batches:
        ids = [encode_text(text, ranks_path) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array([0] * len(ids), pa.int64()), pa.array(ids, pa.binary())],
            names=["row", "chunk", "ids"])


def _branches(docs: DataFrame, id_col: str, text_col: str, longest: int) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk, and the distinct longer ones with their number of ``copies``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text)
    is_long = F.length("text") > longest
    long = (rows.where(is_long)
            .select(F.struct("id", F.sha2("text", 256).alias("key")).alias("row"), "text")
            .groupBy("row").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")))
    return rows.where(~is_long), long


def _stitched(long: DataFrame, ranks_path: str | None, chunk: int, overlap: int) -> DataFrame:
    """row, chunk, ids, copies of the longer texts."""
    row = f"row {dict(long.dtypes)['row']}"
    part = f"{row}, chunk long, ids binary"
    long = stored(long, "bpe-long")
    chunks = stored(long.select("row", "text").mapInArrow(
        lambda b: _cut(b, chunk, overlap), f"{row}, chunk long, start long, body string, last boolean")
        .repartition("row", "chunk"), "bpe-chunks")
    edges = chunks.mapInArrow(lambda b: _edges(b, chunk, overlap, ranks_path),
                              f"{row}, chunk long, head array<long>, tail array<long>")
    by_chunk = Window.partitionBy("row").orderBy("chunk")
    shared = F.array_min(F.array_intersect(F.lag("tail").over(by_chunk), F.col("head")))
    cuts = stored(
        edges.withColumn("cut", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(shared))
        .withColumn("until", F.lead("cut").over(by_chunk))
        .withColumn("torn", F.max(F.col("cut").isNull()).over(Window.partitionBy("row")))
        .select("row", "chunk", "cut", "until", "torn"), "bpe-cuts")
    pieces = (chunks.join(cuts.where(~F.col("torn")), ["row", "chunk"])
              .withColumn("until", F.coalesce("until", F.col("start") + F.length("body")))
              .select("row", "chunk", "start", "body", "cut", "until")
              .mapInArrow(lambda b: _pieces(b, ranks_path), part))
    torn = (long.join(cuts.where(F.col("torn")).select("row").distinct(), "row", "left_semi")
            .select("row", "text").mapInArrow(lambda b: _whole(b, ranks_path), part))
    return pieces.unionByName(torn).join(long.select("row", "copies"), "row")


def _check(chunk: int, overlap: int) -> None:
    if not 2 * EDGE <= overlap < chunk:
        raise ValueError("need 2 * EDGE <= overlap_chars < chunk_chars")


def encode(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id",
           text_col: str = "text", chunk_chars: int = CHUNK_CHARS,
           overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Ids of every text, in parts: ``row`` struct(id, key), ``chunk``, ``ids``, ``copies``.

    The parts of a text, in order of ``chunk``, are its ids as little-endian unsigned 32-bit
    numbers. ``row.key`` is null for texts of one chunk, else the text's SHA-256; equal rows of
    that kind are encoded once and carry their number in ``copies``.
    """
    _check(chunk_chars, overlap_chars)
    short, long = _branches(docs, id_col, text_col, chunk_chars + overlap_chars)
    row = f"row {dict(long.dtypes)['row']}"
    whole = (short.select(F.struct("id", F.lit(None).cast("string").alias("key")).alias("row"), "text")
             .mapInArrow(lambda b: _whole(b, ranks_path), f"{row}, chunk long, ids binary")
             .withColumn("copies", F.lit(1).cast("long")))
    return whole.unionByName(_stitched(long, ranks_path, chunk_chars, overlap_chars))


@tidy
def _digest(batches: Batches, ranks_path: str | None) -> Batches:
    """Digests of texts of one chunk: encode, decode, hash."""
    for batch in batches:
        ids = [encode_text(text, ranks_path) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(decode_ids(x, ranks_path)).hexdigest() for x in ids], pa.string())],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


@tidy
def _digest_parts(batches: Batches, ranks_path: str | None) -> Batches:
    """The same from parts that come in order of text and chunk; one part is held at a time."""
    names = ["row", "copies", "n_tokens", "ids_sha256", "decoded_sha256"]

    def done(row, copies, n, ids_sha, raw_sha):
        return pa.RecordBatch.from_arrays([
            row, pa.array([copies], pa.int64()), pa.array([n], pa.int64()),
            pa.array([ids_sha.hexdigest()], pa.string()), pa.array([raw_sha.hexdigest()], pa.string())],
            names=names)

    current, state = None, None
    for batch in batches:
        for i, (row, copies, ids) in enumerate(_lists(batch, "row", "copies", "ids")):
            if row != current:
                if state is not None:
                    yield done(*state)
                current = row
                state = [batch.column("row").slice(i, 1), copies, 0, hashlib.sha256(), hashlib.sha256()]
            state[2] += len(ids) // 4
            state[3].update(ids)
            state[4].update(decode_ids(ids, ranks_path))
    if state is not None:
        yield done(*state)


def round_trip(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id",
               text_col: str = "text", chunk_chars: int = CHUNK_CHARS,
               overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Per row of ``docs``: number of ids, SHA-256 of the ids and of the bytes they decode to."""
    _check(chunk_chars, overlap_chars)
    short, long = _branches(docs, id_col, text_col, chunk_chars + overlap_chars)
    digests = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    single = short.mapInArrow(lambda b: _digest(b, ranks_path), f"id {dict(short.dtypes)['id']}, {digests}")
    parts = (_stitched(long, ranks_path, chunk_chars, overlap_chars).repartition("row")
             .sortWithinPartitions("row", "chunk").select("row", "copies", "ids"))
    several = (parts.mapInArrow(lambda b: _digest_parts(b, ranks_path),
                                f"row {dict(long.dtypes)['row']}, copies long, {digests}")
               .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
               .select("row.id", "n_tokens", "ids_sha256", "decoded_sha256"))
    return single.unionByName(several).withColumnRenamed("id", id_col)
