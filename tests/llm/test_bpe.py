"""Byte-level BPE: against the tiktoken library itself, over awkward cuts and texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from muster.llm import bpe


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path(bpe.DEFAULT_RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(reference, doc_id, text):
    ids = np.asarray(reference.encode_ordinary(text or ""), "<u4")
    raw = (text or "").encode()
    return (doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())


def check(df, reference, rows):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted((expected(reference, *r[:2]) for r in rows), key=repr)


def test_whole_table(documents, reference):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(bpe.round_trip(documents), reference, rows)


def awkward_texts():
    rnd = random.Random(7)
    bits = ["'re", "'", "'ll", " ", "  ", "\n", "\n\n ", "\t", "a", "Zq", "é", "ß", "9", "12 ", "!?", "漢", "🙂",
            " ", " ", "\u0085", "\x1c", "\x1f", "​", "﻿", "　", "<|endoftext|>"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 400))) for _ in range(60)]


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (40, 20), (64, 9)])
def test_stitching_over_awkward_cuts(make_docs, reference, chunk, overlap):
    rows = [(i, t) for i, t in enumerate(awkward_texts())]
    check(bpe.round_trip(make_docs(rows), chunk_chars=chunk, overlap_chars=overlap), reference, rows)


def test_unbroken_runs_and_repeated_rows(make_docs, reference):
    rows = [(1, "x" * 500), (2, " " * 500 + "end"), (3, "don't " * 60), (3, "don't " * 60), (None, "don't " * 60),
            (3, "won't " * 60), (None, None), (None, None), (4, None), (4, ""), (2**53 + 1, "a"), (2**53 + 1, "b " * 99)]
    check(bpe.round_trip(make_docs(rows), chunk_chars=32, overlap_chars=12), reference, rows)


def test_parts_concatenate_to_the_ids(make_docs, reference):
    rows = [(1, "one two, three 4444 " * 20), (2, "short")]
    parts = bpe.encode(make_docs(rows), chunk_chars=48, overlap_chars=16).orderBy("chunk").collect()
    for doc_id, text in rows:
        ids = b"".join(bytes(p.ids) for p in parts if p.row.id == doc_id)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert bpe.decode_ids(ids) == text.encode()


def test_empty_table_extra_columns_and_bad_arguments(make_docs, spark, reference):
    assert bpe.round_trip(make_docs([])).collect() == []
    clash = make_docs([(1, "a b", "en", "s", 3, "x", 9)], ", ids string, row long")
    check(bpe.round_trip(clash), reference, [(1, "a b")])
    with pytest.raises(ValueError):
        bpe.encode(clash, chunk_chars=8, overlap_chars=8)
