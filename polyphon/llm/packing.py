"""Packing of documents into sequences along a space-filling curve.

Each document gets a hashed bag-of-tokens vector, which a fixed random matrix
projects to four dimensions; the place of that point on a Hilbert curve is the
document's key. Documents are range-sorted by key, so neighbours on the curve
have similar tokens, and are laid end to end into sequences of ``size`` ids.

A range partition fills its sequences by itself. Its last, partial sequence is
cut into sequences whose lengths are powers of two, which need no padding. So no
padding is left, no total over all documents is needed before cutting, and ids
move in one shuffle. Ties on the curve are dealt by the hash of the document, so
any number of copies spreads over several partitions.

Edge cases: a null text is empty and has only its end id; null or repeated
doc_ids keep their rows; a text of any length is cut over as many sequences as
it needs; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from polyphon.llm.tokens import END_ID, text_ids
from polyphon.llm.wordhash import mix64, stream64
from polyphon.sources.workspace import materialize

SIZE = 4096
BUCKETS = 256
DIMENSIONS = 4
BITS = 12
RANGE_IDS = 8_000_000

ENCODED = "doc_id long, curve long, tie long, n_ids long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_sequence long, offset long, sequence_length long"
IDS = ", ids binary"


def projection() -> np.ndarray:
    """Fixed pseudo-random normal weights, one row per hash bucket."""
    u = (stream64(2 * BUCKETS * DIMENSIONS, 3) >> np.uint64(11)).astype(np.float64) / 2.0**53
    a, b = np.maximum(u[: len(u) // 2], 1e-12), u[len(u) // 2 :]
    return (np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)).reshape(BUCKETS, DIMENSIONS)


def hashed_vectors(ids: list[np.ndarray]) -> np.ndarray:
    """Signed counts of hashed ids, of length one."""
    out = np.zeros((len(ids), BUCKETS))
    for row, one in zip(out, ids):
        h = mix64(one.astype(np.uint64))
        sign = np.where(h >> np.uint64(63), -1.0, 1.0)
        row += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), sign, BUCKETS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points with ``bits`` bits per dimension.

    Skilling's transform (2004), over all points at once: undo the rotations
    from the highest bit down, Gray-code, then interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    # Coordinates of a projected unit vector are close to standard normal.
    cells = np.floor((hashed_vectors(ids) @ projection() + 4) / 8 * 2**BITS)
    return hilbert_keys(np.clip(cells, 0, 2**BITS - 1).astype(np.int64), BITS)


def sequence_cuts(total: int, size: int = SIZE) -> list[int]:
    """Lengths of the sequences for ``total`` ids: whole ones, then falling powers of two."""
    whole, rest = divmod(total, size)
    return [size] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``sequence_length``, and the piece's ids (unsigned 32-bit) on request.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in text_ids(batches, tokenizer, end_id):
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array(curve_keys(ids), pa.int64()), batch.column("tie"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([(x.astype("<u2") if x.max() < 65536 else x).tobytes() for x in ids], pa.binary()),
                ],
                names=["doc_id", "curve", "tie", "n_ids", "ids"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        pending: list[tuple] = []  # pieces of the sequence that is being filled
        sequence = filled = 0

        def close(lengths: list[int]) -> None:
            """Cut the pending pieces into sequences of these lengths."""
            nonlocal sequence, filled, pending
            queue = pending[::-1]
            for length in lengths:
                at = 0
                while at < length:
                    doc, start, raw, tokens = queue.pop()
                    n = min(len(raw) // 4, length - at)
                    if n < len(raw) // 4:
                        queue.append((doc, start + n, raw[4 * n :], tokens))
                    rows.append((doc, start, n, zlib.crc32(raw[: 4 * n]), tokens, part, sequence, at, length, bytes(raw[: 4 * n])))
                    at += n
                sequence += 1
            pending, filled = [], 0

        def out() -> pa.RecordBatch:
            nonlocal rows
            columns, names = list(zip(*rows)), [f.split()[0] for f in (PIECES + IDS).split(", ")]
            kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            rows = []
            return pa.record_batch(arrays if with_ids else arrays[:-1], names=names if with_ids else names[:-1])

        for batch in batches:
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "ids"))):
                if len(raw) == 2 * n:
                    raw = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                raw, start = memoryview(raw), 0
                while start < n:
                    take = min(n - start, size - filled)
                    pending.append((doc, start, raw[4 * start : 4 * (start + take)], n))
                    start, filled = start + take, filled + take
                    if filled == size:
                        close([size])
                if len(rows) >= 2000:
                    yield out()
        if filled:
            close(sequence_cuts(filled, size))
        if rows:
            yield out()

    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("tie"), F.col(text_col).cast("string").alias("text")
    )
    encoded = materialize(rows.mapInArrow(encode, ENCODED), "packed_ids")
    # Ranges of a bounded size, however large the input is.
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (encoded.agg(F.sum("n_ids")).first()[0] or 0) // RANGE_IDS)
    ordered = encoded.repartitionByRange(ranges, "curve", "tie").sortWithinPartitions("curve", "tie", "doc_id").select("doc_id", "n_ids", "ids")
    pieces = materialize(ordered.mapInArrow(cut, PIECES + IDS * with_ids), "pieces")

    # One row per range partition meets in the window: its number of sequences.
    parts = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("sequences"))
    before = F.sum("sequences").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("first_sequence"))
    return pieces.join(parts, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("local_sequence")).alias("sequence_id"),
        "offset", "sequence_length", *(["ids"] if with_ids else []),
    )
