"""Token files as wavelet matrices: one succinct file per shard.

A shard holds the ids of consecutive documents. Its file has a header, the
document directory, the shard's alphabet (its distinct ids, ascending), and one
bit-plane per bit of an id's place in the alphabet, highest first; each plane is
the stable partition of the one above. A rank directory every 512
bits makes ``access``, ``rank`` (count before a place) and ``select`` (place of
the k-th occurrence) cost one step per plane, straight from the file.

File, little-endian: ``WVMX0001``, then unsigned 64-bit counts of ids, documents,
alphabet and levels; document ids and lengths (64-bit); the alphabet (32-bit);
zeros per level (64-bit); then per level the packed bits (to full 64-byte blocks) and the counts of ones before each block
(32-bit).

Writing: documents are range-partitioned by id, sorted, cut into shards of
about ``shard_tokens`` ids between documents, and each shard is written by its
task under a temporary name and renamed, so a lost task is simply run again.
The manifest written by Spark names the shards of the tasks that counted; files
of abandoned attempts are never read. The folder must be one that
``pyarrow.fs`` can open on every executor.

Edge cases: a null text is empty and has only its end id; a null or repeated
doc_id keeps its row (null first); a text longer than a shard is a shard of its
own; an empty table writes an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from polyphon.llm.tokens import END_ID, text_ids

MAGIC = b"WVMX0001"
BLOCK = 512
SHARD_TOKENS = 2_000_000
NULL_ID = -(2**63)

MANIFEST = "part int, file string, n_tokens long, n_docs long"
READ = "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Access, rank and select over one shard's ids."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, docs, letters, self.levels = struct.unpack_from("<4Q", blob, 8)
        at = 40
        self.doc_ids = np.frombuffer(blob, "<i8", docs, at)
        self.lengths = np.frombuffer(blob, "<i8", docs, at + 8 * docs)
        at += 16 * docs
        self.alphabet = np.frombuffer(blob, "<u4", letters, at)
        at += 4 * letters
        self.zeros = np.frombuffer(blob, "<u8", self.levels, at).astype(np.int64)
        at += 8 * self.levels
        blocks = -(-self.n // BLOCK)
        self.planes, self.ranks = [], []
        for _ in range(self.levels):
            self.planes.append(np.frombuffer(blob, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8
            self.ranks.append(np.frombuffer(blob, "<u4", blocks, at))
            at += 4 * blocks

    @staticmethod
    def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
        alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
        levels = max(1, (len(alphabet) - 1).bit_length())
        places = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint16 if levels <= 16 else np.uint32)
        places[alphabet] = np.arange(len(alphabet))
        cur = places[ids]
        n, zeros, body, blocks = len(cur), [], [], -(-len(ids) // BLOCK)
        for b in range(levels - 1, -1, -1):
            packed = np.packbits((cur & cur.dtype.type(1 << b)) != 0, bitorder="little")
            plane = np.zeros(blocks * BLOCK // 8, np.uint8)
            plane[: len(packed)] = packed
            per_block = np.bitwise_count(plane.view("<u8")).reshape(blocks, -1).sum(axis=1, dtype=np.int64)
            body += [plane.tobytes(), (np.cumsum(per_block) - per_block).astype("<u4").tobytes()]
            values = pa.array(cur)
            low, high = (
                values.filter(pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(bits)])).to_numpy() for bits in (~packed, packed)
            )
            zeros.append(len(low))
            cur = np.concatenate([low, high])
        head = MAGIC + struct.pack("<4Q", len(ids), len(doc_ids), len(alphabet), levels)
        directory = [doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), alphabet.astype("<u4").tobytes()]
        return b"".join([head, *directory, np.array(zeros, "<u8").tobytes(), *body])

    def _ones_before(self, level: int, i: int) -> int:
        block = i // BLOCK
        if block == len(self.ranks[level]):
            return self.n - int(self.zeros[level])
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : -(-i // 8)], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[: i - block * BLOCK].sum())

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (i & 7)) & 1

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones_before(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` among the first ``i`` ids."""
        place = self._letter(value)
        if place is None:
            return 0
        lo, hi = self._range(place, i)
        return hi - lo

    def _letter(self, value: int) -> int | None:
        """The place of an id in the alphabet."""
        place = int(np.searchsorted(self.alphabet, value))
        return place if place < len(self.alphabet) and self.alphabet[place] == value else None

    def _range(self, value: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.levels):
            a, b = self._ones_before(level, lo), self._ones_before(level, hi)
            if value >> (self.levels - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def select(self, value: int, k: int) -> int:
        """Place of the ``k``-th occurrence (from 0) of ``value``, or -1."""
        value = self._letter(value)
        if value is None:
            return -1
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            return -1
        place = lo + k
        for level in range(self.levels - 1, -1, -1):
            zeros = int(self.zeros[level])
            if value >> (self.levels - 1 - level) & 1:
                place = self._place(level, place - zeros, True)
            else:
                place = self._place(level, place, False)
        return place

    def _place(self, level: int, k: int, ones: bool) -> int:
        """Where the ``k``-th one or zero of a plane stands: a search over the directory, then one block."""
        before = self.ranks[level].astype(np.int64)
        if not ones:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == ones)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids; every plane is undone once, from the lowest."""
        cur = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = int(self.zeros[level])
            up = np.empty_like(cur)
            up[~ones] = cur[:zeros]
            up[ones] = cur[zeros:] | cur.dtype.type(1 << (self.levels - 1 - level))
            cur = up
        return self.alphabet[cur] if self.n else np.zeros(0, "<u4")


def _write_file(folder: str, name: str, blob: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(blob)
    store.move(part, f"{path}/{name}")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the shards below ``folder`` and return the manifest that Spark has stored beside them."""
    spark = docs.sparkSession
    files = f"{folder}/files"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        ids: list[np.ndarray] = []
        keys: list[int] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, keys, held, number
            lengths = np.array([len(x) for x in ids], np.int64)
            name = f"shard-{part:06d}-{number:06d}-{attempt}.wvm"
            _write_file(files, name, WaveletMatrix.build(np.concatenate(ids), np.array(keys, np.int64), lengths))
            row = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([held], pa.int64()), pa.array([len(keys)], pa.int64())],
                names=["part", "file", "n_tokens", "n_docs"],
            )
            ids, keys, held, number = [], [], 0, number + 1
            return row

        for batch, encoded in text_ids(batches, tokenizer, end_id):
            for key, one in zip(batch.column("doc_id").to_pylist(), encoded):
                if held and held + len(one) > shard_tokens:
                    yield flush()
                ids.append(one.astype(np.uint16) if len(one) and one.max() < 65536 else one)
                keys.append(NULL_ID if key is None else key)
                held += len(one)
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, all from the files.

    ``start`` needs the totals of the parts before: one row per writing task, the
    only rows that meet in one place; places inside a part come from its shards.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.select(
        "part", F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start")
    )
    shards = manifest.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards = shards.join(parts, "part").select("file", (F.col("part_start") + F.col("in_part")).alias("shard_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column("content")[row].as_py())
                name = os.path.basename(batch.column("path")[row].as_py())
                ids, lengths = matrix.decode(), matrix.lengths
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                keys = pa.array(matrix.doc_ids, pa.int64(), mask=matrix.doc_ids == NULL_ID)
                yield pa.record_batch(
                    [pa.array([name] * len(ends)), keys, pa.array(ends - lengths), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["file", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wvm").load(f"{folder}/files").select("path", "content")
    docs = blobs.mapInArrow(read, READ)
    return docs.join(shards, "file").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
