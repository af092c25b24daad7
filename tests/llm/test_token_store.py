"""Token shards and their index: against the tokenizers library, and by keyed access."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from muster.llm import queries, token_store
from muster.llm.common import scratch
from muster.llm.token_store import PerfectHash, TokenStore, every_copy


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path(token_store.DEFAULT_TOKENIZER))
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_query_on_the_whole_table(spark, documents, tokenizer):
    expected, start = [], 0
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        ids = ids_of(tokenizer, r.text)
        expected.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = queries.op10_token_store(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == expected


def test_encoder_equals_library_on_awkward_texts(tokenizer):
    rnd = random.Random(5)
    bits = ["'re", "'", " ", "  ", "\n", "\n\n ", "\t", "a", "Zq", "é", "ß", "9", "12 ", "!?", "漢", "🙂", " ", " ",
            "\u0085", "\x1c", "\x1f", "​", "﻿", "　", "<|endoftext|>", " x", " é", "_", "\r\n", " \n", "\na"]
    encode = token_store.Encoder(public_tokenizers.path(token_store.DEFAULT_TOKENIZER))
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))
        got = np.frombuffer(encode(text), encode.dtype).tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("long", [1 << 20, 40])
def test_batches_equal_single_texts(tokenizer, monkeypatch, long):
    monkeypatch.setattr(token_store, "LONG_TEXT", long)
    rnd = random.Random(6)
    bits = ["one", "two,", " ", " ", " ", "  ", "\n", "é", "x\ny", "　", "'s", "12", ""]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(500)] + ["", " ", "a"]
    encode = token_store.Encoder(public_tokenizers.path(token_store.DEFAULT_TOKENIZER))
    for part in (texts, texts[5:9], [""], texts[200:]):
        ids, counts = encode.batch(pa.array(["skipped", *part]).slice(1), 0)
        cuts = np.cumsum(counts)[:-1]
        assert [x.tolist() for x in np.split(ids, cuts)] == [ids_of(tokenizer, t) for t in part]


def test_cache_that_overflows_stays_right(tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_ENTRIES", 3)
    encode = token_store.Encoder(public_tokenizers.path(token_store.DEFAULT_TOKENIZER))
    text = "one two\nthree four five\nsix seven one two"
    assert np.frombuffer(encode(text), encode.dtype).tolist() == tokenizer.encode(text).ids


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
    hashed = PerfectHash.build(h1, h2)
    assert sorted(hashed.slots(h1, h2)) == list(range(n))
    assert sum(hashed.sizes) <= 4 * n + 64


def test_equal_keys_are_refused():
    same = np.full(2, 7, np.uint64)
    with pytest.raises(ValueError):
        PerfectHash.build(same, same)


def test_keyed_access_absent_keys_nulls_and_repeats(spark, make_docs, tokenizer):
    rows = [(5, "five five"), (1, "one"), (5, "five five"), (5, "other"), (None, "no id"), (7, None), (8, ""),
            (2**53 + 1, "big")]
    store = TokenStore.write(make_docs(rows), scratch(spark, "t"), shard_bytes=20, bucket_keys=2)
    found = store.lookup(every_copy(make_docs(rows)), copy_col="copy")
    got = {}
    for r in store.fetch(found).collect():
        got.setdefault(r.id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    expected = {}
    for doc_id, text in rows:
        expected.setdefault(doc_id, []).append(ids_of(tokenizer, text))
    assert {k: sorted(x[1] for x in v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    starts = sorted((s, len(ids)) for v in got.values() for s, ids in v)
    assert [s for s, _ in starts] == list(np.cumsum([0, *(n for _, n in starts)])[:-1])
    assert got[None][0][0] == 0  # nulls first
    absent = store.lookup(make_docs([(i, "") for i in range(100, 400)]))
    assert absent.where("shard is not null").count() == 0


def test_empty_table_and_clashing_columns(spark, make_docs, tokenizer):
    empty = TokenStore.write(make_docs([]), scratch(spark, "t"))
    assert empty.fetch(empty.lookup(make_docs([(1, "x")]))).collect() == []
    docs = make_docs([(1, "a b", "en", "s", 3, "x", 9)], ", id string, shard long")
    store = TokenStore.write(docs, scratch(spark, "t"))
    r = store.fetch(store.lookup(docs)).first()
    assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids_of(tokenizer, "a b")
