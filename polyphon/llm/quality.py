"""Text quality with a generalised additive model and pairwise interactions.

Each feature is cut into bins and has a lookup table of log-odds; some pairs of
features have a table over both. Tables are learned by cyclic boosting: feature
by feature, a tree of at most four leaves over the bins is fitted to the
gradient and a small share of it is added. Pairs are then ranked by how much a
four-quadrant cut over both explains of what is left, and the best are boosted
the same way. A score is one table look-up per feature and pair, added up.

Training reads labelled rows only, at most ``TRAIN_ROWS`` of them in hash order
(a documented bound; everything else covers all rows). The labels are matched
to documents by id; no id, language or source is a feature. Features are array
operations over the bytes and words of whole texts.

Edge cases: null and empty texts have all-zero features and get a score like any
other; a null label, or a label without document, is not used; a document with
several labels takes the smallest, one with several texts the smallest text;
without labels of both classes the model is
a constant; null or repeated doc_ids keep their rows; an empty table gives no
rows; extra columns are ignored by ``score`` and kept by ``with_score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from polyphon.llm.base import give_back_memory, text_slices
from polyphon.llm.wordhash import SPACE, byte_set, column_bytes, mix64, span_hashes, word_spans

TRAIN_ROWS = 20_000
FOLDS = 5
BINS = 48
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
RIDGE = 1.0
LEAST_LEAF = 20
#: Bytes of text whose features are computed at once; bounds a worker's memory.
SLICE = 1 << 18

_UPPER, _LOWER = byte_set((0x41, 0x5A)), byte_set((0x61, 0x7A))
_DIGIT = byte_set((0x30, 0x39))
_NEWLINE = byte_set((0x0A, 0x0A))
_ODD = byte_set((0x23, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E))
_WIDE = byte_set((0xC0, 0xFF))

NAMES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digit", "wide", "odd", "exclamation", "bar", "comma", "stop",
    "same_as_last", "longest_repeat", "distinct_words", "distinct_triples", "capital_words", "bare_words", "lines", "repeated_lines",
    "line_words", "worst_line_odd", "commonest_word",
)


def _per_text(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[before[1:]] - total[before[:-1]]


def _largest(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(before) - 1), np.flatnonzero(before[1:] > before[:-1])
    if len(some):
        out[some] = np.maximum.reduceat(values, before[:-1][some])
    return out


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per text, and how often its commonest one occurs."""
    with np.errstate(over="ignore"):
        _, first, counts = np.unique(hashes + mix64(owner.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, owner[first], counts)
    return np.bincount(owner[first], minlength=n).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    data, offsets = column_bytes(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    per_byte = np.maximum(size, 1)
    share = lambda table: _per_text(table[data], offsets) / per_byte

    starts, ends, before = word_spans(data, offsets, ~SPACE)
    words = np.diff(before).astype(float)
    per_word = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(before))
    hashes = span_hashes(data, starts, ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    place = np.arange(len(hashes))
    run = place - np.maximum.accumulate(np.where(same, 0, place)) if len(hashes) else np.zeros(0)
    distinct, most = _distinct(hashes, owner, n)
    with np.errstate(over="ignore"):
        triple = mix64(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7))
    whole = owner[:-2] == owner[2:]
    triples, _ = _distinct(triple[whole], owner[:-2][whole], n)

    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    small = np.concatenate([[0], np.cumsum(_LOWER[data] | _WIDE[data])])
    ups, lows = upper[ends] - upper[starts], small[ends] - small[starts]

    line_starts, line_ends, lines_before = word_spans(data, offsets, ~_NEWLINE)
    lines = np.diff(lines_before).astype(float)
    line_owner = np.repeat(np.arange(n), np.diff(lines_before))
    different, _ = _distinct(span_hashes(data, line_starts, line_ends), line_owner, n)
    odd = np.concatenate([[0], np.cumsum((_ODD | byte_set((0x21, 0x21), (0x7C, 0x7C)))[data])])
    line_odd = (odd[line_ends] - odd[line_starts]) / np.maximum(line_ends - line_starts, 20)

    columns = [
        np.log1p(size), np.log1p(words), _per_text(ends - starts, before) / per_word, _largest(ends - starts, before),
        share(_UPPER), share(_DIGIT), share(_WIDE), share(_ODD), share(byte_set((0x21, 0x21))), share(byte_set((0x7C, 0x7C))),
        share(byte_set((0x2C, 0x2C))), share(byte_set((0x2E, 0x2E))),
        _per_text(same, before) / per_word, _largest(run, before), distinct / per_word, triples / np.maximum(words - 2, 1),
        _per_text((ups > 1) & (lows == 0), before) / per_word, _per_text((ups == 0) & (lows == 0), before) / per_word,
        lines, 1 - different / np.maximum(lines, 1), words / np.maximum(lines, 1), _largest(line_odd, lines_before), most / per_word,
    ]
    return np.column_stack(columns) if n else np.zeros((0, len(NAMES)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values per bin of a tree of this depth, fitted to gradient and curvature sums."""
    out = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth and len(g) > 1:
        gs, hs, ns = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        gain = _gain(gs, hs) + _gain(g.sum() - gs, h.sum() - hs)
        gain[(ns < LEAST_LEAF) | (n.sum() - ns < LEAST_LEAF)] = -np.inf
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            out[:at] = _leaves(g[:at], h[:at], n[:at], depth - 1)
            out[at:] = _leaves(g[at:], h[at:], n[at:], depth - 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four quadrants: its gain and the values."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    best, values = -np.inf, np.zeros_like(g)
    k = len(g)
    for i in range(1, k):
        for j in range(1, k):
            parts = []
            for c in (cg, ch):
                a, b, d, t = c[i, j], c[i, k], c[k, j], c[k, k]
                parts.append(np.array([a, b - a, d - a, t - b - d + a]))
            gain = float(_gain(*parts).sum())
            if gain > best:
                q = parts[0] / (parts[1] + RIDGE)
                values = np.empty_like(g)
                values[:i, :j], values[:i, j:], values[i:, :j], values[i:, j:] = q
                best = gain
    return best, values


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            out += values[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, values in self.pairs:
            out += values[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.log_odds(x))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher")) for column in x.T]


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = AdditiveModel(float(np.log(rate / (1 - rate))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges, model.pair_edges = _cuts(x, BINS), _cuts(x, PAIR_BINS)
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    odds = np.full(len(y), model.base)

    def sums(place: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(odds)
        return np.bincount(place, y - p, cells), np.bincount(place, p * (1 - p), cells)

    for _ in range(ROUNDS):
        for j, values in enumerate(model.tables):
            if len(values) > 1:
                step = RATE * _leaves(*sums(bins[j], len(values)), sizes[j])
                values += step
                odds += step[bins[j]]

    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T)]
    k = PAIR_BINS
    grid = lambda a, b: [s.reshape(k, k) for s in sums(coarse[a] * k + coarse[b], k * k)]
    ranked = sorted(((_quadrants(*grid(a, b))[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)[:PAIRS]
    model.pairs = [(a, b, np.zeros((k, k))) for _, a, b in ranked]
    for _ in range(PAIR_ROUNDS):
        for a, b, values in model.pairs:
            step = RATE * _quadrants(*grid(a, b))[1]
            values += step
            odds += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """Rows whose id has a crc32 divisible by ``folds``; they are never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


_ARRAY = "array<double>"


def _featured(rows: DataFrame, kept: list[str]) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            x = features(batch.column("text"))
            arrays = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES), pa.array(x.ravel()))
            yield pa.record_batch([*(batch.column(k) for k in kept), arrays], names=[*kept, "features"])

    fields = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in kept)
    return rows.select(*kept, "text").mapInArrow(compute, f"{fields}, features {_ARRAY}")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most ``train_rows`` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Hash order is the same for every layout of the table; only labels of documents at hand count.
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = _featured(rows, ["doc_id", "y"]).orderBy("doc_id").toPandas()
    x = np.stack(rows["features"].to_list()) if len(rows) else np.zeros((0, len(NAMES)))
    return fit(x, rows["y"].to_numpy(float))


def with_score(docs: DataFrame, model: AdditiveModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its ``text``."""
    fields = [f for f in docs.schema.fields if f.name != name]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            scores = model.scores(features(batch.column("text").cast(pa.string())))
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])
        give_back_memory()

    schema = docs.select(*(f"`{f.name}`" for f in fields)).schema.add(name, "double")
    return docs.select(*(f"`{f.name}`" for f in fields)).mapInArrow(compute, schema)


def score(docs: DataFrame, model: AdditiveModel, limit: float = 0.3) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    rows = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
