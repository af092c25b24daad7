"""Quality classifier: held-out accuracy on the labelled rows, features, and awkward rows."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from muster.llm import quality, queries

MID = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_clean_documents_stay(spark):
    got = {r.doc_id: r for r in queries.op1_quality_subword(spark, MID).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{MID}/documents.parquet").count()
    for doc_id, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    unseen = [(got[d].predicted, q) for d, q in labels.items() if got[d].held_out]
    assert len(unseen) > 50
    good = [p for p, q in unseen if q == 1]
    bad = [p for p, q in unseen if q == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.15 * len(bad)


def test_features_do_not_depend_on_piece_borders(monkeypatch):
    text = "alpha beta  gamma\nδelta ünder " * 40

    def count():
        return np.bincount(np.concatenate(list(quality.feature_buckets(text))), minlength=quality.BUCKETS)

    whole = count()
    monkeypatch.setattr(quality, "PIECE_CHARS", 50)
    assert (count() == whole).all()


def plain_features(text):
    """The features of a text written without numpy: words, pairs of neighbouring words, n-grams of bytes in words."""
    m = 2**32

    def mix(h):
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) % m
        return h ^ (h >> 13)

    power, powers = 1, []
    for _ in range(64):
        power = power * 0x9E3779B1 % m
        powers.append(power)
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    hashes = [mix(sum(mix(b + 1) * powers[i % 64] for i, b in enumerate(w)) % m) for w in words]
    found = [h % quality.BUCKETS for h in hashes]
    found += [mix((a * 31 + b) % m) % quality.BUCKETS for a, b in zip(hashes, hashes[1:], strict=False)]
    for n in quality.NGRAMS:
        for w in words:
            ends = b" " + w + b" "
            for i in range(len(ends) - n + 1):
                h = n
                for b in ends[i:i + n]:
                    h = (h * 0x01000193 + b) % m
                found.append(mix(h) % quality.BUCKETS)
    return found


@pytest.mark.parametrize("text", ["", None, "a", "ab cd", "  Lead é\tçut\x0b\n tail  ", "word " * 30 + "x" * 200, "日本 語"])
def test_features_and_scores_equal_a_plain_rewrite(text):
    got = sorted(int(b) for part in quality.feature_buckets(text) for b in part)
    want = sorted(plain_features(text))
    assert got == want
    model = quality.QualityModel(np.random.default_rng(2).normal(size=quality.BUCKETS).astype(np.float32), -0.3)
    mean = sum(float(model.weights[b]) for b in want) / len(want) if want else 0.0
    assert model.score(text) == pytest.approx(1 / (1 + math.exp(-(model.bias + mean))), abs=1e-9)


def test_training_steps_equal_plain_gradient_descent():
    """Two documents, one pass: vectors and softmax against the formulas."""
    weights = quality.Weights.start(3)
    v, out, bias = weights.vectors.astype(float), weights.out.astype(float) + 0.1, weights.bias.astype(float)
    weights.out[:] = 0.1
    rows = [(np.array([1, 5]), np.array([3, 1]), 1), (np.array([5, 9]), np.array([1, 1]), 0)]
    weights.learn(iter(rows), 4, 0.5)
    for step, (buckets, counts, label) in enumerate(rows):
        rate, share = 0.5 * (1 - step / 4), counts / counts.sum()
        doc = sum(s * v[b] for s, b in zip(share, buckets, strict=True))
        chance = np.exp(out @ doc + bias) / np.exp(out @ doc + bias).sum()
        error = chance - np.eye(2)[label]
        back = error @ out
        out = out - rate * np.outer(error, doc)
        bias = bias - rate * error
        for s, b in zip(share, buckets, strict=True):
            v[b] -= rate * min(s * len(buckets), 4) * back
    assert np.allclose(weights.vectors[[1, 5, 9]], v[[1, 5, 9]], atol=1e-5) and np.allclose(weights.out, out, atol=1e-5)
    assert np.flatnonzero(weights.seen).tolist() == [1, 5, 9] and weights.steps == 2


def test_weights_survive_their_table():
    weights = quality.Weights.start(4)
    weights.learn([(np.array([1, 5]), np.array([3, 1]), 1)], 4)
    back = quality.Weights.unpacked(*weights.packed())
    assert back.steps == 1 and (back.seen == weights.seen).all() and np.array_equal(back.bias, weights.bias)
    assert np.array_equal(back.vectors, weights.vectors) and np.array_equal(back.out, weights.out)


def test_an_epoch_streams_its_rows():
    """A row is learned from before the next one is asked for; the weights come first."""
    def batch(label, buckets, counts, order=1):
        return pa.RecordBatch.from_pylist([{"order": order, "label": label, "buckets": buckets, "counts": counts}])

    def batches(asked):
        vectors, rest = quality.Weights.start(4).packed()
        yield batch(None, vectors[1000:], b"", 1)
        yield batch(None, vectors[:1000], rest, 0)
        for i in range(5):
            asked.append(i)
            yield batch(i % 2, np.array([i], "<i4").tobytes(), np.array([2], "<i4").tobytes())

    asked = []
    out = [r for b in quality._epoch(batches(asked), 10, False) for r in b.to_pylist()]
    assert len(out) == quality.PARTS
    got, want = quality.Weights.unpacked(*(b"".join(r[c] for r in out) for c in ("buckets", "counts"))), quality.Weights.start(4)
    want.learn([(np.array([i]), np.array([2]), i % 2) for i in range(5)], 10)
    assert asked == list(range(5)) and np.array_equal(got.vectors, want.vectors) and got.steps == 5


def test_long_labelled_texts(spark, make_docs):
    """60 labelled texts of half a megabyte: all features are learned from, rows are streamed."""
    rnd = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'g' if i % 2 else 'b'}{x}" for x in rnd.integers(0, 60_000, 80_000))) for i in range(60)]
    model = quality.train(make_docs(rows), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    assert (model.weights != 0).mean() > 0.9
    assert model.score(rows[1][1]) > 0.5 > model.score(rows[0][1])


def test_long_texts_and_words_are_scored_whole(monkeypatch):
    model = quality.QualityModel(np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.1)
    long = "word " * 5000 + "x" * 5000
    one = model.score(long)
    monkeypatch.setattr(quality, "PIECE_CHARS", 1000)
    assert 0 < model.score(long) < 1 and abs(model.score(long + " tail" * 3000) - one) > 1e-6


def test_feature_limit_covers_the_whole_text():
    text = " ".join(f"w{i}" for i in range(2000))
    found, counts = quality.train_features(text, 100)
    assert len(found) == 100 == len(counts) and (np.diff(found) > 0).all()
    late = set(quality.train_features(" ".join(f"w{i}" for i in range(1000, 2000)), 10**6)[0])
    assert len(late & set(found)) > 20


def test_training_sees_all_features_and_the_rest_weighs_nothing(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(3000))
    docs = make_docs([(i, f"{long} {'good' if i % 2 else 'bad'}") for i in range(8)])
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    seen = np.union1d(*[quality.train_features(f"{long} {w}")[0] for w in ("good", "bad")])
    assert len(seen) > 5000 and (model.weights[seen] != 0).mean() > 0.99
    assert not np.delete(model.weights, seen).any()


@pytest.mark.parametrize("labels,expected", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)])
def test_without_both_labels_the_score_is_their_share(spark, make_docs, labels, expected):
    docs = make_docs([(1, "good text"), (2, "more"), (3, None), (None, "")])
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, table)
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert len(scores) == 4 and all(abs(s - expected) < 1e-5 for s in scores)


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, make_docs):
    rows = [(i, "plain words here" if i % 2 else "$$$ %%% ###", None, None, None, 9) for i in range(40)]
    docs = make_docs([*rows, rows[1], (None, None, None, None, None, 1)], ", score long")
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(40)], (1, 1), (2, None), (None, 1)],
                                   "doc_id long, quality int")
    model = quality.train(docs, labels, train_rows=30)
    got = quality.score(docs.drop("score"), model).collect()
    assert len(got) == 42
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None)
    assert quality.score(make_docs([]), model).collect() == []
    fold = docs.select("doc_id", quality.held_out(docs.doc_id).alias("h")).where("doc_id is null").first()
    assert fold.h is False
