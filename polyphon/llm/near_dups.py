"""Near-duplicate classes with HyperMinHash sketches.

A document's set holds its distinct five-word shingles (64-bit hashes). For each
of ``BANDS * ROWS`` registers a hash function of its own maps the set, and the
register keeps the smallest value in 16 bits: the count of leading zeros (6) and
the ten bits behind the leading one. (Every register has its own function, not
its own slice of one function, since most sets are smaller than the sketch and
would leave registers empty.)

Candidates share a band of ``ROWS`` registers. At the limit of 0.75 a pair is
missed with probability (1 - 0.75^5)^40, about 2 in 100,000, and at 0.8 with 1
in 10 million. Registers can also agree by chance; the estimate of similarity
takes that off, by the two set sizes: matches / k = J + (1 - J) c(n, m). Pairs
with an estimate of at least 0.6 (almost five standard deviations below 0.75)
are confirmed on their full sets, taken anew from the texts.

Copies with equal sets are put together first, so a group of copies is one row.
No bucket is expanded into pairs:

1. In each band bucket every member is paired with the smallest one only, and
   each document keeps the one head it shares most buckets with. Pairs with a
   sufficient estimate are confirmed; links give first components.
2. Buckets that still hold several components are compared in blocks of about
   ``BLOCK`` rows against each other inside tasks: pairs of different components
   with a sufficient estimate are confirmed there on full sets, and a link joins
   its components at once. So every pair that shares a bucket is confirmed, or
   known to be connected, or has too low an estimate.

Edge cases: null and empty texts, and texts without words, have an empty set
(``n_shingles`` 0) and link with nothing; texts of one to four words are one
shingle; rows with a repeated doc_id are one document if their sets are equal
and share a component through their id otherwise; rows with a null doc_id are
left out, as they cannot be named; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyphon.llm.base import give_back_memory, text_slices
from polyphon.llm.components import components
from polyphon.llm.wordhash import SPACE, column_bytes, mix64, span_hashes, stream64, word_spans
from polyphon.sources.workspace import materialize

WORDS = 5
BANDS, ROWS = 40, 5
MANTISSA = 10
LEAST_ESTIMATE = 0.6
LIMIT = (3, 4)  # similarity of at least 3/4
BLOCK = 512
# Bytes of text whose shingle sets a worker holds at a time.
SLICE = 1 << 18

SKETCHES = "doc_id long, n_shingles long, digest binary, registers binary"

_REGISTERS = BANDS * ROWS
_FACTORS = stream64(_REGISTERS, 11) | np.uint64(1)
_OFFSETS = stream64(_REGISTERS, 12)
_BAND_FACTORS = (stream64(ROWS, 13) | np.uint64(1))[None, :]
_SHINGLE = stream64(WORDS, 14) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text."""
    data, offsets = column_bytes(texts)
    starts, ends, before = word_spans(data, offsets, ~SPACE)
    words = span_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for j, f in enumerate(_SHINGLE):
            rolled += words[j : j + n] * f
        rolled = mix64(rolled)
        out = []
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= WORDS:
                out.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix64((words[a:b] * _SHINGLE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set: leading zeros and mantissa of the smallest value per function."""
    least = np.full(_REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        room = np.empty((min(len(shingles), 512), _REGISTERS), np.uint64)
        for first in range(0, len(shingles), 512):
            some = shingles[first : first + 512, None]
            values = np.bitwise_xor(some, _OFFSETS, out=room[: len(some)])
            np.multiply(values, _FACTORS, out=values)
            np.minimum(least, values.min(axis=0), out=least)
    fraction, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    mantissa = np.minimum(((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) + mantissa).astype("<u2")


def octaves(size: np.ndarray) -> np.ndarray:
    """Per set size, the probability of each count of leading zeros of the smallest value."""
    edges = 2.0 ** -np.arange(0, 65)
    above = np.exp(np.log1p(-np.minimum(edges, 1 - 1e-16))[None, :] * size[:, None].astype(np.float64))
    return above[:, 1:] - above[:, :-1]


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of these sizes agree.

    Both smallest values must fall into one octave (as many leading zeros) and,
    within it, into one of 2^10 cells.
    """
    return (octaves(n) * octaves(m)).sum(axis=1) / (1 << MANTISSA)


def estimates(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of sketches, row by row."""
    c = chance(n, m)
    return ((a == b).mean(axis=1) - c) / (1 - c)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, _REGISTERS)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column("text"))
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "registers"],
            )
        give_back_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(sketch, SKETCHES)


def _band_keys(regs: np.ndarray) -> np.ndarray:
    """A hash of each band's number and registers, one row per sketch."""
    bands = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(mix64((bands + np.uint64(1)) * _BAND_FACTORS[None]).sum(axis=2, dtype=np.uint64) + stream64(BANDS, 15)).view(np.int64)


def _band_rows(reps: DataFrame) -> DataFrame:
    """(band, rep) for every rep and band."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                some = batch.slice(first, 2000)
                keys = _band_keys(_matrix(some.column("registers")))
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(some.column("rep").to_numpy(), BANDS))], names=["band", "rep"])

    return reps.select("rep", "registers").mapInArrow(explode, "band long, rep long")


def _with_estimates(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) with an estimate that is high enough."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = estimates(
                _matrix(batch.column("ra")), batch.column("na").to_numpy(), _matrix(batch.column("rb")), batch.column("nb").to_numpy()
            )
            out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(e)], names=["a", "b", "estimate"])
            yield out.filter(pa.array(e >= LEAST_ESTIMATE))

    left = reps.select(F.col("rep").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    right = reps.select(F.col("rep").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "na", "rb", "nb")
    return both.mapInArrow(estimate, "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                some = batch.slice(first, 200)
                keep = []
                for x, y in zip(shingle_sets(some.column("ta")), shingle_sets(some.column("tb"))):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(common) and LIMIT[1] * common >= LIMIT[0] * (len(x) + len(y) - common))
                yield pa.record_batch([some.column("a"), some.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(confirm, "a long, b long")


def _block_links(bands: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between different components from buckets that hold several, compared block by block.

    A bucket is dealt into blocks of about ``BLOCK`` rows by hash and every two
    blocks meet in one group, which holds sketches and full sets of its rows.
    Within a group a link joins components, so at most one link per component
    leaves it however many of its pairs are similar.
    """
    own = labels.select(F.col("node").alias("rep"), "component")
    rows = materialize(bands.join(own, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled_bands")
    mixed = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = materialize(mixed.where("lo <> hi").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed_bands")
    rows = materialize(rows.join(mixed, "band"), "mixed_rows")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column("text"))
            yield pa.record_batch(
                [batch.column("rep"), pa.array([registers(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["rep", "registers", "shingles"],
            )
        give_back_memory()

    wanted = texts.join(rows.select("rep").distinct(), "rep", "left_semi")
    sets = materialize(wanted.mapInArrow(prepare, "rep long, registers binary, shingles binary"), "mixed_sets")
    # A row goes to the pairs of blocks (x, y), x <= y, that hold its own block.
    rows = rows.join(sets, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})

    def compare(group: pa.Table) -> pa.Table:
        rep, packed = group["rep"].to_numpy(), group["shingles"].to_pylist()
        order = sorted(range(len(rep)), key=lambda k: (rep[k], packed[k]))
        rep, block = rep[order], group["block"].to_numpy()[order]
        regs, sets = _matrix(group["registers"])[order], [np.frombuffer(packed[k], "<u8") for k in order]
        _, label = np.unique(group["component"].to_numpy()[order], return_inverse=True)
        one_block = group["x"][0] == group["y"][0]
        n = np.array([len(x) for x in sets])
        ends = np.cumsum(n)
        spread = octaves(n)
        number = int(np.argmax(_band_keys(regs[:1])[0] == group["band"][0].as_py()))
        places = None
        out = []
        for i in range(len(rep) - 1):
            j = np.arange(i + 1, len(rep))
            low, high = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
            j = j[(label[j] != label[i]) & ((block[j] != block[i]) | one_block) & (LIMIT[1] * low >= LIMIT[0] * high)]
            if len(j):
                same = regs[j] == regs[i]
                by_chance = spread[j] @ spread[i] / (1 << MANTISSA)
                likely = (same.mean(axis=1) - by_chance) / (1 - by_chance) >= LEAST_ESTIMATE
                # A pair that shares several buckets is looked at in the first one.
                first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                j = j[likely & (first == number)]
            if not len(j):
                continue
            if places is None:
                names, places = np.unique(np.concatenate(sets), return_inverse=True)
                mine = np.zeros(len(names), bool)
            mine[places[ends[i] - n[i] : ends[i]]] = True
            common = np.array([np.count_nonzero(mine[places[ends[k] - n[k] : ends[k]]]) for k in j])
            mine[places[ends[i] - n[i] : ends[i]]] = False
            for k in j[LIMIT[1] * common >= LIMIT[0] * (n[i] + n[j] - common)]:
                if label[k] != label[i]:
                    out.append((rep[i], rep[k]))
                    label[label == label[k]] = label[i]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("band", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest reachable doc_id), ``kept``."""
    sketched = materialize(sketches(docs, id_col, text_col), "sketches")
    filled = sketched.where("n_shingles > 0")
    # One row per distinct set: the smallest id that has it.
    firsts = materialize(filled.groupBy("digest").agg(F.min("doc_id").alias("rep")), "set_firsts")
    members = materialize(filled.select("doc_id", "digest").join(firsts, "digest").select("doc_id", "rep", "digest"), "members")
    reps = materialize(
        filled.join(members.where("doc_id = rep").select("doc_id", "digest").distinct(), ["doc_id", "digest"])
        .dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("rep"), "n_shingles", "registers"),
        "reps",
    )
    bands = materialize(_band_rows(reps), "bands")
    heads = bands.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    bands = materialize(bands.join(heads, "band"), "shared_bands")
    some = bands.select("rep").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    texts = materialize(texts.join(some.hint("shuffle_hash"), "rep", "left_semi"), "shared_texts")

    # One head per document, the one it shares most buckets with; all others are left to the blocks.
    pairs = bands.where("a < rep").groupBy("a", F.col("rep").alias("b")).agg(F.count("*").alias("shared"))
    pairs = pairs.groupBy("b").agg(F.min_by("a", F.struct(-F.col("shared"), F.col("a"))).alias("a"))
    links = materialize(_confirmed(_with_estimates(pairs, reps), texts), "links")
    # A doc_id that is repeated with several sets connects their first documents.
    least = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top").select("doc_id", "b")
    repeated = members.join(least, "doc_id").where("b < rep").select(F.col("rep").alias("a"), "b")
    links = materialize(links.union(repeated), "links")
    labels = materialize(components(links), "components")

    more = materialize(_block_links(bands.select("band", "rep"), texts, labels), "links")
    if not more.isEmpty():
        labels = materialize(components(links.union(more)), "components")

    named = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sketched.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id")
    )
