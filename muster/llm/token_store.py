"""Token-id shards with a minimal perfect hash index.

Layout of a store::

    payload/shard-<n>-<attempt>.bin   raw ids, little-endian, 16 bits if the vocabulary fits, else 32
    entries/                          Parquet: one row per document (where its ids lie)
    manifest/                         Parquet: one row per shard (file, ids before it, ids in it)
    index/bucket-<n>-<attempt>.mph    one minimal perfect hash per bucket of keys, with its entries
    buckets/                          Parquet: one row per bucket (file, keys)

Documents lie in ascending id order over the shards (nulls first): one range shuffle of the texts,
then each task encodes and writes its own shard, streaming. A key is (document id, copy), hashed to
two 64-bit words; the first picks a bucket, and inside a bucket a cascade of bit arrays sends every
key to its own slot without storing keys. A slot holds a 32-bit fingerprint of the key, the shard,
the offset and the length, so keyed access takes a constant number of steps and tells absent keys
(up to a chance of 2^-32) from present ones.

File names carry the writing attempt; only names in committed Parquet rows are ever read, so a
retried task leaves at most an unreferenced file.

Defined results: a null text counts as empty (only the end id is stored); null ids are a key of their
own; rows that repeat an id are copies 0, 1, ... in the order of their text's hash; an empty table
gives a store without shards; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.common import small_batches

Batches = Iterator[pa.RecordBatch]

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SHARD_BYTES = 16 << 20  # bytes of text in a shard, about
BUCKET_KEYS = 1 << 16  # keys in an index bucket, about
CACHE_ENTRIES = 300_000
SLICE_BYTES = 8 << 20  # of text that are encoded at once
LONG_TEXT = 4 << 20  # bytes from which a text is encoded by itself
#: a chunk that is a word of Latin letters and closing punctuation, two pre-tokens
CHUNK_PARTS = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<tail>[,.;:!?]*)$"
MAGIC = b"MPHIDX01"
ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("count", "<u8")])


# --- files ---------------------------------------------------------------------------------------
def file_system(uri: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def _new_file(folder: str, stem: str, ending: str):
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}.{ending}"
    return name, system.open_output_stream(f"{path}/{name}")


# --- encoding ------------------------------------------------------------------------------------
class _Odd(Exception):
    """A space that may not be a pre-token's start."""


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet of such tokenizers: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(rest)}


class _ChunkIds(dict):
    """Text between two single spaces -> id bytes of ``prefix`` + text, filled on demand.

    A space followed by a printable ASCII or alphanumeric character always starts a pre-token, and
    a line feed between two such characters always is one; texts are cut only there. A chunk that is a
    word of Latin letters and closing punctuation is two pre-tokens.
    """

    LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")

    def __init__(self, encode, encode_word, prefix: str, bare: _ChunkIds | None = None):
        super().__init__()
        self._encode, self._encode_word, self._prefix, self._bare = encode, encode_word, prefix, bare

    def __missing__(self, chunk: str) -> bytes:
        if self._bare is not None and not (chunk and ("!" <= chunk[0] <= "~" or chunk[0].isalnum())):
            raise _Odd
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[chunk] = self._of(chunk)
        return ids

    def _of(self, chunk: str) -> bytes:
        if self._bare is None:
            return self._encode(chunk)
        if "\n" in chunk:
            first, *rest = chunk.split("\n")
            if first and not first[-1].isspace() and all(
                    x and ("!" <= x[0] <= "~" or x[0].isalnum()) and not x[-1].isspace() for x in rest):
                feed = self._bare["\n"]
                return self[first] + b"".join(feed + self._bare[x] for x in rest)
            return self._encode(self._prefix + chunk)
        word = chunk.rstrip(",.;:!?")
        if not (word.isascii() and word.isalpha() or self.LETTERS.fullmatch(word)):
            return self._encode(self._prefix + chunk)
        if len(word) < len(chunk):
            return self[word] + self._bare[chunk[len(word):]]
        return self._encode_word(self._prefix, word)


class Encoder:
    """Ids of a text by the tokenizers library, as little-endian bytes of ``dtype``."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._tokenizer.encode_special_tokens = True
        self.dtype = "<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self._cut = re.compile(r" (?=[!-~]|\w)")
        self._letters = _byte_letters()
        self._blank = chr(self._letters[ord(" ")])
        self._code = "H" if self.dtype == "<u2" else "I"
        self._tokenize = self._tokenizer.model.tokenize
        self._bare = _ChunkIds(self._ids, self._word_ids, "")
        self._spaced = _ChunkIds(self._ids, self._word_ids, " ", self._bare)

    def _ids(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word_ids(self, prefix: str, word: str) -> bytes:
        """The library's model on one pre-token, without splitting again."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
        blank = "" if not prefix else self._blank
        return array(self._code, [t.id for t in self._tokenize(blank + letters)]).tobytes()

    def __call__(self, text: str) -> bytes:
        try:
            first, *rest = text.split(" ")
            return self._bare[first] + b"".join(map(self._spaced.__getitem__, rest))
        except _Odd:
            first, *rest = self._cut.split(text)
            return self._bare[first] + b"".join(map(self._spaced.__getitem__, rest))


    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, each with its space."""
        known, out = self._spaced, []
        get, tokenize, code, blank, letters = known.get, self._tokenize, self._code, self._blank, self._letters
        for word in words:
            ids = get(word)
            if ids is None:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
                ids = array(code, [t.id for t in tokenize(blank + spelled)]).tobytes()
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                known[word] = ids
            out.append(ids)
        return out

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text), the end id after each.

        Texts are cut at single spaces; the distinct chunks of the batch, split into words and closing
        punctuation, are encoded once and their ids gathered by place. A text with
        a space that may not start a pre-token, or beyond ``LONG_TEXT`` bytes, is encoded by itself.
        """
        n = len(texts)
        long = np.asarray(pc.greater(pc.binary_length(texts), LONG_TEXT))
        chunks = pc.split_pattern(pc.if_else(pa.array(long), "", texts), " ")
        ends = np.asarray(chunks.offsets)[1:] - chunks.offsets[0].as_py()
        firsts = np.concatenate([[0], ends[:-1]])
        coded = chunks.flatten().dictionary_encode()
        places, entries = np.asarray(coded.indices), coded.dictionary
        parts = pc.extract_regex(entries, CHUNK_PARTS)
        plain = np.asarray(parts.is_valid())
        words, tails = (pc.struct_field(parts, f).dictionary_encode() for f in ("word", "tail"))
        others = entries.filter(pa.array(~plain)).to_pylist()
        unsafe = np.array([not (c and ("!" <= c[0] <= "~" or c[0].isalnum())) for c in others], bool)
        table = [*self._words(words.dictionary.to_pylist()), *map(self._bare.__getitem__, tails.dictionary.to_pylist()),
                 *(b"" if u else self._spaced[c] for c, u in zip(others, unsafe, strict=True))]
        odd_entry = np.zeros(len(entries), bool)
        odd_entry[~plain] = unsafe
        odd = odd_entry[places]
        odd[firsts] = False
        alone = long | (np.add.reduceat(odd, firsts, dtype=np.int64) > 0)
        # every chunk is two places of the table: word and tail, or itself and nothing
        begins, nothing = len(table), len(table) + n
        two = np.full((len(entries), 2), nothing, np.int32)
        two[plain, 0] = pc.drop_null(words.indices)
        two[plain, 1] = np.asarray(pc.drop_null(tails.indices)) + len(words.dictionary)
        two[~plain, 0] = len(words.dictionary) + len(tails.dictionary) + np.arange(len(others))
        first_chunks = entries.take(pa.array(places[firsts])).to_pylist()
        table += [self(texts[i].as_py()) if alone[i] else self._bare[c] for i, c in enumerate(first_chunks)]
        table += [b"", np.asarray([end_id], self.dtype).tobytes()]
        slots = two[places]
        slots[np.repeat(alone, ends - firsts)] = nothing
        slots[firsts, 0], slots[firsts, 1] = begins + np.arange(n), nothing
        slots = np.insert(slots.ravel(), 2 * ends, nothing + 1)
        sizes = (np.fromiter(map(len, table), np.int64, len(table)) // np.dtype(self.dtype).itemsize)
        flat = np.frombuffer(b"".join(table), self.dtype)
        here = sizes[slots]
        after = np.cumsum(here)
        small = np.int32 if after[-1] + len(flat) < 1 << 31 else np.int64
        shift = ((np.cumsum(sizes) - sizes)[slots] - (after - here)).astype(small)
        ids = flat[np.repeat(shift, here) + np.arange(after[-1], dtype=small)]
        return ids, np.add.reduceat(here, 2 * firsts + np.arange(n))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``SLICE_BYTES`` of text, so that a gather stays small."""
    total = np.cumsum(np.asarray(pc.binary_length(batch.column(column))).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, before + SLICE_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str | None) -> Encoder:
    import public_tokenizers

    return Encoder(tokenizer_path or public_tokenizers.path(DEFAULT_TOKENIZER))


def _write_shard(batches: Batches, folder: str, tokenizer_path: str | None, end_id: int) -> Batches:
    """Write one partition, which is in id order, as one shard; a row per document."""
    encode, file, name, start, copy, before = encoder(tokenizer_path), None, "", 0, 0, object()
    shard, width = TaskContext.get().partitionId(), np.dtype(encode.dtype).itemsize
    try:
        for batch in batches:
            for rows in _slices(batch, "text"):
                if file is None:
                    name, file = _new_file(folder, f"shard-{shard:06d}", "bin")
                ids, counts = encode.batch(rows.column("text"), end_id)
                file.write(ids.tobytes())
                copies = []
                for doc_id in rows.column("id").to_pylist():
                    copy = copy + 1 if doc_id == before else 0
                    before = doc_id
                    copies.append(copy)
                starts, start = start + np.cumsum(counts) - counts, start + int(counts.sum())
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), pa.array(copies, pa.int64()), pa.array([shard] * n, pa.int32()),
                    pa.array([name] * n, pa.string()), pa.array([width] * n, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                    names=["id", "copy", "shard", "file", "width", "start", "count"])
    finally:
        if file is not None:
            file.close()


# --- minimal perfect hashing ---------------------------------------------------------------------
def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A new 64-bit hash of a key for every level."""
    with np.errstate(over="ignore"):
        x = h1 + h2 * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@dataclass
class PerfectHash:
    """Distinct keys -> 0 .. n-1. Level by level, keys that have a bit to themselves stay there;
    the others go on to the next level. A key's slot is the number of set bits before its own."""

    sizes: list[int]
    bits: np.ndarray  # of all levels, one byte each while in memory
    ranks: np.ndarray

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, room: float = 2.0) -> PerfectHash:
        sizes, levels, level = [], [], 0
        while len(h1):
            if level > 200:
                raise ValueError("keys are not distinct")
            m = max(8, int(room * len(h1)))
            at = (_mix(h1, h2, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(alone)
            rest = ~alone[at]
            h1, h2, level = h1[rest], h2[rest], level + 1
        return cls.of(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    @classmethod
    def of(cls, sizes: list[int], bits: np.ndarray) -> PerfectHash:
        return cls(sizes, bits, np.concatenate([[0], np.cumsum(bits)]).astype(np.int64))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 for some keys that were not in the build, any slot for others."""
        out = np.full(len(h1), -1, np.int64)
        left, base = np.arange(len(h1)), 0
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = base + (_mix(h1[left], h2[left], level) % np.uint64(m)).astype(np.int64)
            found = self.bits[at]
            out[left[found]] = self.ranks[at[found]]
            left, base = left[~found], base + m
        return out


def pack_index(h1: np.ndarray, h2: np.ndarray, shard, start, count) -> bytes:
    hashed = PerfectHash.build(h1, h2)
    entries = np.zeros(len(h1), ENTRY)
    slots = hashed.slots(h1, h2)
    entries["fingerprint"][slots] = (h2 >> np.uint64(32)).astype(np.uint32)
    entries["shard"][slots], entries["start"][slots], entries["count"][slots] = shard, start, count
    head = MAGIC + struct.pack(f"<QI{len(hashed.sizes)}Q", len(h1), len(hashed.sizes), *hashed.sizes)
    return head + np.packbits(hashed.bits).tobytes() + entries.tobytes()


def unpack_index(data: bytes) -> tuple[PerfectHash, np.ndarray]:
    if data[:8] != MAGIC:
        raise ValueError("not an index file")
    n, levels = struct.unpack_from("<QI", data, 8)
    sizes = list(struct.unpack_from(f"<{levels}Q", data, 20))
    at, total = 20 + 8 * levels, sum(sizes)
    packed = np.frombuffer(data, np.uint8, (total + 7) // 8, at)
    entries = np.frombuffer(data, ENTRY, n, at + len(packed))
    return PerfectHash.of(sizes, np.unpackbits(packed, count=total).astype(bool)), entries


def _hashes(id_col: Column, copy: Column) -> tuple[Column, Column]:
    key = [id_col.isNull(), id_col, copy]
    return F.xxhash64(F.lit("slot"), *key), F.xxhash64(F.lit("check"), *key)


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name)).astype(np.int64).view(np.uint64)


def _write_bucket(batches: Batches, folder: str) -> Batches:
    """All keys of one bucket (about ``BUCKET_KEYS``, as keys are distinct) as one index file."""
    held = [b for b in batches if b.num_rows]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        name, file = _new_file(folder, f"bucket-{whole.column('bucket')[0].as_py():06d}", "mph")
        with file:
            file.write(pack_index(_unsigned(whole, "h1"), _unsigned(whole, "h2"),
                                  *(np.asarray(whole.column(c)) for c in ("shard", "start", "count"))))
        yield pa.RecordBatch.from_arrays(
            [whole.column("bucket").slice(0, 1), pa.array([name]), pa.array([whole.num_rows], pa.int64())],
            names=["bucket", "file", "keys"])


# --- the store -----------------------------------------------------------------------------------
class TokenStore:
    """A store in a shared folder. ``TokenStore.write(docs, folder)``, ``TokenStore(spark, folder)``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @classmethod
    def write(cls, docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID,
              id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
              bucket_keys: int = BUCKET_KEYS) -> TokenStore:
        store = cls(docs.sparkSession, folder)
        rows = docs.select(F.col(id_col).alias("id"),
                           F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        size = rows.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("b")).first().b or 0
        # the text's hash lets a repeated id go to several shards
        ranged = (rows.withColumn("tie", F.xxhash64("text"))
                  .repartitionByRange(max(1, math.ceil(size / shard_bytes)), "id", "tie")
                  .sortWithinPartitions("id", "tie", "text").select("id", "text"))
        payload = f"{store.folder}/payload"
        id_type = dict(rows.dtypes)["id"]
        entries = ranged.mapInArrow(
            lambda b: _write_shard(b, payload, tokenizer_path, end_id),
            f"id {id_type}, copy long, shard int, file string, width int, start long, count long")
        with small_batches(docs.sparkSession, 4_000):  # about as many texts as are encoded at once
            entries.write.parquet(f"{store.folder}/entries")
        entries = store._table("entries")
        shards = entries.groupBy("shard").agg(
            F.first("file").alias("file"), F.first("width").alias("width"),
            F.sum("count").alias("ids"), F.count(F.lit(1)).alias("documents"),
            F.min_by("id", F.struct("start", "copy")).alias("first_id"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
        shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))) \
            .write.parquet(f"{store.folder}/manifest")
        store._write_index(bucket_keys)
        return store

    def _numbered(self) -> DataFrame:
        """Entries whose ``copy`` counts on over shard borders.

        Only the first id of a shard can have copies in shards before it, so the numbers to add
        are one row per shard, from counts of those ids alone.
        """
        entries = self._table("entries")
        firsts = self._table("manifest").select(F.col("first_id"), "shard")
        spans = (entries.join(firsts.select("first_id").distinct(), F.col("id").eqNullSafe(F.col("first_id")),
                              "left_semi").groupBy("id", "shard").agg(F.count(F.lit(1)).alias("n")))
        earlier = Window.partitionBy("id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        carried = (spans.withColumn("carry", F.sum("n").over(earlier)).where("carry > 0")
                   .select(F.col("id").alias("_id"), F.col("shard").alias("_shard"), "carry"))
        return (entries.join(carried, (F.col("shard") == F.col("_shard"))
                             & F.col("id").eqNullSafe(F.col("_id")), "left")
                .withColumn("copy", F.col("copy") + F.coalesce("carry", F.lit(0)))
                .select("id", "copy", "shard", "start", "count"))

    def _write_index(self, bucket_keys: int) -> None:
        n = self._table("manifest").agg(F.sum("documents").alias("n")).first().n or 0
        buckets = max(1, math.ceil(n / bucket_keys))
        h1, h2 = _hashes(F.col("id"), F.col("copy"))
        index = f"{self.folder}/index"
        keyed = (self._numbered().select(h1.alias("h1"), h2.alias("h2"), "shard", "start", "count")
                 .withColumn("bucket", F.pmod("h1", F.lit(buckets)).cast("int")))
        (keyed.repartitionById(buckets, "bucket")
         .mapInArrow(lambda b: _write_bucket(b, index), "bucket int, file string, keys long")
         .withColumn("buckets", F.lit(buckets)).write.parquet(f"{self.folder}/buckets"))

    def lookup(self, keys: DataFrame, id_col: str = "doc_id", copy_col: str | None = None) -> DataFrame:
        """Distinct (id, copy) with shard, start and count; null where the key is not in the store."""
        copy = F.col(copy_col).cast("long") if copy_col else F.lit(0).cast("long")
        asked = keys.select(F.col(id_col).alias("id"), copy.alias("copy")).distinct()
        files = self._table("buckets")
        buckets = files.agg(F.max("buckets").alias("n")).first().n or 1
        h1, h2 = _hashes(F.col("id"), F.col("copy"))
        index = f"{self.folder}/index"
        hashed = (asked.withColumns({"h1": h1, "h2": h2})
                  .withColumn("bucket", F.pmod("h1", F.lit(buckets)).cast("int"))
                  .join(files.select("bucket", "file"), "bucket", "left"))
        id_type = dict(asked.dtypes)["id"]
        return hashed.repartitionById(buckets, "bucket").mapInArrow(
            lambda b: _find(b, index), f"id {id_type}, copy long, shard int, start long, count long")

    def fetch(self, found: DataFrame) -> DataFrame:
        """id, copy, global start, n_tokens and the ids (little-endian unsigned 32-bit) of lookups."""
        manifest = self._table("manifest").select("shard", "file", "width", "base")
        payload = f"{self.folder}/payload"
        at = (found.where(F.col("shard").isNotNull()).join(manifest, "shard")
              .repartition("shard").sortWithinPartitions("shard", "start"))
        id_type = dict(found.dtypes)["id"]
        return at.mapInArrow(lambda b: _read(b, payload),
                             f"id {id_type}, copy long, start long, n_tokens long, ids binary")


def _find(batches: Batches, folder: str) -> Batches:
    system, path = file_system(folder)
    name, loaded = None, None
    for batch in batches:
        files = np.asarray(batch.column("file").to_pylist(), object)
        h1, h2 = _unsigned(batch, "h1"), _unsigned(batch, "h2")
        shard, start, count = (np.full(len(h1), -1, np.int64) for _ in range(3))
        for file in {f for f in files if f is not None}:
            if file != name:
                with system.open_input_file(f"{path}/{file}") as source:
                    name, loaded = file, unpack_index(source.read())
            hashed, entries = loaded
            here = np.flatnonzero(files == file)
            slots = hashed.slots(h1[here], h2[here])
            here, slots = here[slots >= 0], slots[slots >= 0]
            same = entries["fingerprint"][slots] == (h2[here] >> np.uint64(32)).astype(np.uint32)
            here, hit = here[same], entries[slots[same]]
            shard[here], start[here], count[here] = hit["shard"], hit["start"], hit["count"]
        none = shard < 0
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("copy"), pa.array(shard.astype(np.int32), mask=none),
            pa.array(start, mask=none), pa.array(count, mask=none)],
            names=["id", "copy", "shard", "start", "count"])


def _read(batches: Batches, folder: str) -> Batches:
    system, path = file_system(folder)
    name, source = None, None
    try:
        for batch in batches:
            ids = []
            for file, width, start, count in zip(*(batch.column(c).to_pylist() for c in
                                                   ("file", "width", "start", "count")), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, system.open_input_file(f"{path}/{file}")
                raw = source.read_at(count * width, start * width)
                ids.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
            starts = np.asarray(batch.column("start")) + np.asarray(batch.column("base"))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("copy"), pa.array(starts, pa.int64()),
                batch.column("count"), pa.array(ids, pa.binary())],
                names=["id", "copy", "start", "n_tokens", "ids"])
    finally:
        if source is not None:
            source.close()


def every_copy(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, copy) of every row, from counts per id."""
    counts = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(F.col(id_col), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("copy"))

