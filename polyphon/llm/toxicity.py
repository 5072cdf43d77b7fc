"""Toxic documents and their sentences by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability of being
offensive, a logistic function of the features it holds; a document is toxic if
at least one sentence is, so its probability is the noisy-or
``1 - (1 - leak) * product(1 - p)``. Labels exist for documents only: the gradient
of the noisy-or shares each document's error among its sentences, so the model
learns which sentences offend, and tells where they stand.

Features are whole words (letters A-Z folded) and their beginnings of 3 to 6
bytes, so inflected forms of one stem share some. Only features whose share among
toxic training documents differs by at least ``LEAST_Z`` standard errors from that
among the others are kept, at most ``FEATURES``; a sentence without any offends
with probability 0. The leak stands for toxic documents without evidence.

Training reads labelled rows outside the held-out fold, at most ``TRAIN_ROWS`` in
hash order (a documented bound; scoring covers all rows and whole texts). Feature
statistics are one aggregation in Spark; what the driver gets is the kept
features and, per training document, the few sentences that hold some.

Edge cases: null and empty texts have no sentences and score the leak; a null
label, or one without document, is not used; a document with several labels
takes the smallest, one with several texts the smallest text; without labels of
both classes the score is the share of toxic labels (0.5 without any); null or
repeated doc_ids keep their rows; a sentence may be as long as its text; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyphon.llm.base import give_back_memory, text_slices
from polyphon.llm.quality import held_out
from polyphon.llm.wordhash import byte_set, column_bytes, span_hashes, word_spans
from polyphon.sources.workspace import materialize

TRAIN_ROWS = 20_000
FEATURES = 4096
LEAST_Z = 5.0
LEAST_DOCS = 5
BEGINNINGS = (3, 4, 5, 6)
ROUNDS = 600
RATE = 0.1
#: Strength of the pull of all weights to 0, as against one document; chosen by log loss on one fold of the training rows.
PRIOR = 0.1

_WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_SENTENCE = ~byte_set((0x0A, 0x0A), (0x0D, 0x0D), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
_HEADS = byte_set((0x00, 0x7F), (0xC0, 0xFF))

SENTENCES = "array<struct<start:long,end:long,score:double>>"


@dataclass
class Slice:
    """Sentences and features of some texts."""

    texts: int
    starts: np.ndarray  # of sentences, in bytes of the joined texts
    ends: np.ndarray
    before: np.ndarray  # sentences before each text
    keys: np.ndarray  # feature hashes, sorted by nothing in particular
    sentence: np.ndarray  # of each feature
    heads: np.ndarray | None = None  # characters before each byte
    offsets: np.ndarray | None = None


def _slice(texts: pa.Array, places: bool = False) -> Slice:
    data, offsets = column_bytes(texts)
    starts, ends, before = word_spans(data, offsets, _SENTENCE)
    words, word_ends, _ = word_spans(data, offsets, _WORD)
    sentence = np.searchsorted(starts, words, side="right") - 1
    keys, owners = [span_hashes(data, words, word_ends)], [sentence]
    for n in BEGINNINGS:
        longer = np.flatnonzero(word_ends - words > n)
        keys.append(span_hashes(data, words[longer], words[longer] + n))
        owners.append(sentence[longer])
    heads = np.concatenate([[0], np.cumsum(_HEADS[data])]) if places else None
    return Slice(len(offsets) - 1, starts, ends, before, np.concatenate(keys), np.concatenate(owners), heads, offsets)


@dataclass
class NoisyOr:
    """Weights of feature hashes (ascending), the sentence bias, and the leak's log-odds."""

    leak: float
    bias: float = 0.0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def sentence_scores(self, some: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Sentences that hold a feature, and their probabilities."""
        sentence, feature = present(some, self.keys)
        held, at = np.unique(sentence, return_inverse=True)
        return held, _sigmoid(self.bias + np.bincount(at, self.weights[feature], len(held)))

    def scores(self, some: Slice, held: np.ndarray, p: np.ndarray) -> np.ndarray:
        text = np.searchsorted(some.before, held, side="right") - 1
        clean = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), some.texts)
        return 1 - (1 - _sigmoid(np.array(self.leak))) * np.exp(clean)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def present(some: Slice, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (sentence, feature) once, for the features in ``keys``, by their places there."""
    if not len(keys) or not len(some.keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A table over the highest bits sorts out nearly all others before the search.
    likely = np.zeros(1 << 16, bool)
    likely[keys >> np.uint64(48)] = True
    maybe = np.flatnonzero(likely[some.keys >> np.uint64(48)])
    at = np.minimum(np.searchsorted(keys, some.keys[maybe]), len(keys) - 1)
    hit = keys[at] == some.keys[maybe]
    both = np.unique(some.sentence[maybe[hit]] * len(keys) + at[hit])
    return both // len(keys), both % len(keys)


def fit(documents: int, toxic: np.ndarray, owner: np.ndarray, sentence: np.ndarray, feature: np.ndarray, keys: np.ndarray) -> NoisyOr:
    """Fit by gradient steps (Adam) on the log-likelihood of the documents' labels.

    ``owner`` is the document of each sentence with features; ``sentence`` and
    ``feature`` list which holds which.
    """
    rate = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3)) if documents else 0.5
    leak = float(np.log(rate / (1 - rate)))
    if not len(owner) or toxic.min() == toxic.max():
        return NoisyOr(leak)
    m = len(owner)
    x = np.zeros(len(keys) + 2)
    x[-2], x[-1] = -2.0, leak - 2.0  # the sentences' bias and the leak
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, ROUNDS + 1):
        p = _sigmoid(x[-2] + np.bincount(sentence, x[feature], m))
        own_leak = _sigmoid(x[-1])
        clean = (1 - own_leak) * np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), documents))
        # d log L / d log-odds of an instance: p * clean / (1 - clean) in a toxic document, -p in another.
        share = np.where(toxic == 1, clean / np.maximum(1 - clean, 1e-12), -1.0)
        pull = share[owner] * p
        g = np.concatenate([np.bincount(feature, pull[sentence], len(keys)), [pull.sum(), (share * own_leak).sum()]]) / documents
        g[:-2] -= PRIOR * x[:-2] / documents
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return NoisyOr(float(x[-1]), float(x[-2]), keys, x[:-2])


def _training_rows(docs: DataFrame, labels: DataFrame, label: str, train_rows: int) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return materialize(rows, "toxic_training")


def _telling_features(rows: DataFrame, least_z: float, most: int) -> np.ndarray:
    """Features that differ between the classes, by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            some = _slice(batch.column("text"))
            text = np.searchsorted(some.before, some.sentence, side="right") - 1
            y = batch.column("y").to_numpy()
            order = np.lexsort((text, some.keys))
            keys, owner = some.keys[order], text[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, own = keys[new], y[owner[new]]
            found, at = np.unique(keys, return_inverse=True)
            n, toxic = np.bincount(at, minlength=len(found)), np.bincount(at, own, len(found))
            yield pa.record_batch(
                [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(toxic.astype(np.int64))], names=["feature", "n", "toxic"]
            )
        give_back_memory()

    sizes = rows.agg(F.count("*"), F.sum("y")).first()
    all_n, all_toxic = sizes[0], sizes[1] or 0
    if not 0 < all_toxic < all_n:
        return np.zeros(0, np.uint64)
    counted = rows.select("text", "y").mapInArrow(count, "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    share = F.col("n") / F.lit(all_n)
    spread = F.sqrt(share * (1 - share) * F.lit(1 / all_toxic + 1 / (all_n - all_toxic)))
    z = F.abs(F.col("toxic") / F.lit(all_toxic) - (F.col("n") - F.col("toxic")) / F.lit(all_n - all_toxic)) / spread
    kept = counted.where((F.col("n") >= LEAST_DOCS) & (F.col("n") < all_n)).select("feature", z.alias("z")).where(F.col("z") >= least_z)
    found = kept.orderBy(F.desc("z"), "feature").limit(most).collect()
    return np.sort(np.array([r.feature for r in found], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> NoisyOr:
    """Fit on at most ``train_rows`` labelled documents outside the held-out fold."""
    rows = _training_rows(docs, labels, label, train_rows)
    keys = _telling_features(rows, LEAST_Z, features)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            some = _slice(batch.column("text"))
            sentence, feature = present(some, keys)
            text = np.searchsorted(some.before, sentence, side="right") - 1
            cut = np.searchsorted(text, np.arange(some.texts + 1)).tolist()
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("y"),
                    pa.array([sentence[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array([feature[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                ],
                names=["doc_id", "y", "sentences", "features"],
            )
        give_back_memory()

    found = rows.select("doc_id", "y", "text").mapInArrow(held, "doc_id long, y int, sentences binary, features binary")
    found = found.orderBy("doc_id").toPandas()
    toxic = found["y"].to_numpy(np.int64)
    sentences = [np.frombuffer(x, "<u4") for x in found["sentences"]]
    doc = np.repeat(np.arange(len(found)), [len(x) for x in sentences])
    sentence = np.concatenate(sentences).astype(np.int64) if sentences else np.zeros(0, np.int64)
    feature = np.frombuffer(b"".join(found["features"]), "<u4").astype(np.int64)
    pairs, at = np.unique(doc * (1 << 32) + sentence, return_inverse=True)
    return fit(len(found), toxic, pairs >> 32, at, feature, keys)


def score(docs: DataFrame, model: NoisyOr, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``score``, ``predicted`` and ``sentences``: those that offend, in code points."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            some = _slice(batch.column("text"), places=True)
            held, p = model.sentence_scores(some)
            scores = model.scores(some, held, p)
            bad = p >= limit
            held, p = held[bad], p[bad]
            text = np.searchsorted(some.before, held, side="right") - 1
            first = some.heads[some.offsets[text]]
            spans = pa.StructArray.from_arrays(
                [pa.array(some.heads[some.starts[held]] - first), pa.array(some.heads[some.ends[held]] - first), pa.array(p)], names=["start", "end", "score"]
            )
            cuts = pa.array(np.searchsorted(text, np.arange(some.texts + 1)).astype(np.int32))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(cuts, spans)], names=["doc_id", "score", "sentences"]
            )
        give_back_memory()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(compute, f"doc_id long, score double, sentences {SENTENCES}")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"), "sentences")
