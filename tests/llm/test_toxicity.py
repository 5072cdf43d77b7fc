"""The noisy-or model against plain Python, its gradient against differences, and held-out documents."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyphon.llm import toxicity
from polyphon.llm.wordhash import span_hashes

SF = "/root/testdata/sf0.1"


def key(word):
    raw = word.encode()
    return int(span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])


def naive(text, model):
    """Score and offending sentences of one text."""
    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
    clean, bad = 1 - 1 / (1 + math.exp(-model.leak)), []
    for m in re.finditer(r"[^\n\r!.?]+", text or ""):
        held = set()
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", m[0].encode()):
            w = w.lower()  # bytes: A-Z only
            for n in (3, 4, 5, 6, len(w)):
                if len(w) > n or n == len(w):
                    raw = np.frombuffer(w[:n], np.uint8)
                    held.add(int(span_hashes(raw, np.array([0]), np.array([n]))[0]))
        held &= weights.keys()
        if held:
            p = 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(weights[k] for k in held)))))
            clean *= 1 - p
            if p >= 0.5:
                bad.append((m.start(), m.end(), round(p, 9)))
    return 1 - clean, bad


@pytest.fixture(scope="module")
def model():
    words = ["idiot", "lowe", "the", "ö", "fox", "pas"]
    keys = np.array([key(w) for w in words], np.uint64)
    order = np.argsort(keys)
    return toxicity.NoisyOr(-4.0, -3.0, keys[order], np.array([5.0, 4.0, -1.0, 0.5, 2.0, 3.5])[order])


def check(docs, model):
    rows = toxicity.score(docs, model).collect()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=str)
    got = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.score))
    want = sorted(((known, i, *naive(t, model)) for known, i, t in texts), key=lambda x: x[:3])
    assert len(got) == len(want)
    for r, (known, i, s, bad) in zip(got, want):
        assert (r.doc_id is not None, r.doc_id or 0) == (known, i) and r.score == pytest.approx(s, abs=1e-9) and r.predicted == (s >= 0.5)
        assert [(x.start, x.end, round(x.score, 9)) for x in r.sentences] == bad


def test_scores_and_places(documents, doubtful, empty, model):
    texts = ["You idiot! The fox? Ö\nlowei x.", "IDIOT", "é é. idiots loweia idio fox fox fox.", ".!?", "the the the the", "lowe" * 5000 + ". ok"]
    check(documents(list(enumerate(texts))), model)
    check(doubtful, model)
    assert toxicity.score(empty, model).count() == 0


def test_gradient_is_that_of_the_likelihood():
    """Documents with one toxic word each: the fit finds its weight, and no step away raises the likelihood."""
    rng = np.random.default_rng(3)
    n, sentences = 300, 4
    owner = np.repeat(np.arange(n), sentences)
    feature = rng.integers(1, 5, n * sentences)
    toxic = (rng.random(n) < 0.4).astype(np.int64)
    feature[np.flatnonzero(toxic) * sentences + rng.integers(0, sentences, toxic.sum())] = 0
    keys = np.arange(5, dtype=np.uint64)
    m = toxicity.fit(n, toxic, owner, np.arange(n * sentences), feature, keys)

    def loss(leak, bias, weights):
        p = 1 / (1 + np.exp(-(bias + weights[feature])))
        clean = (1 - 1 / (1 + np.exp(-leak))) * np.exp(np.bincount(owner, np.log1p(-p), n))
        return -np.mean(np.where(toxic == 1, np.log1p(-np.minimum(clean, 1 - 1e-12)), np.log(clean))) + toxicity.PRIOR / n * (weights**2).sum() / 2

    best = loss(m.leak, m.bias, m.weights)
    assert best < 0.05 and m.bias + m.weights[0] > 2 and (m.bias + m.weights[1:] < -2).all()
    for i in range(5):
        step = np.eye(5)[i] * 0.5
        assert loss(m.leak, m.bias, m.weights + step) > best - 2e-3 and loss(m.leak, m.bias, m.weights - step) > best - 2e-3


def test_held_out_documents_and_offending_sentences(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    caught = [r for r in found if r.toxic == 1]
    assert sum(r.predicted for r in caught) >= 0.8 * len(caught)
    assert sum(r.predicted for r in found if r.toxic == 0) <= 0.01 * len(found)
    # English toxic words of the test tables. Document labels leave words that never stand alone with little weight: measured 0.78.
    word = re.compile(r"\b(idiot|moron|scum|stupid|pathetic|loser)\b", re.I)
    met = located = 0
    for r in caught:
        for m in word.finditer(r.text):
            met += 1
            located += any(s.start <= m.start() and m.end() <= s.end for s in r.sentences)
    assert met > 100 and located >= 0.75 * met


def test_training_edges(spark, doubtful, empty):
    schema = "doc_id long, toxic int"
    none = spark.createDataFrame([], schema)
    assert toxicity.train(doubtful, none).leak == 0 and toxicity.train(empty, none).leak == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (6, 7), (777, 1), (9, 1)], schema)
    one = toxicity.train(doubtful, odd)
    assert np.isfinite(one.leak) and len(one.keys) == 0
    check(doubtful, one)


def test_features_are_told_apart_by_class(spark):
    """The kept features are those of a count in plain Python."""
    rng = np.random.default_rng(5)
    texts = [(i, int(i % 4 == 0), " ".join(rng.choice(["alpha", "beta", "gamma"], 6)) + (" zotton" if i % 4 == 0 and i % 8 else "")) for i in range(200)]
    rows = spark.createDataFrame(texts, "doc_id long, y int, text string")
    got = toxicity._telling_features(rows, 5.0, 10)
    assert set(got.tolist()) == {key(w) for w in ("zot", "zott", "zotto", "zotton")}
