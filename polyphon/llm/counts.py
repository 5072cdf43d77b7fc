"""Token counts behind a digest cache.

A text's content digest is the SHA-256 of its UTF-8 bytes after the one
normalisation that can never change a count: null becomes empty. (The piece
vocabulary counts every space and letter case, so nothing else may be folded.)
The tokenizer's version digest covers the vocabulary file and the library. Both
digests are joined to the stored counts; only contents without one are encoded,
each once however many copies it has, and their counts are appended to the
cache by one Spark write, which counts wholly or not at all.

Texts move in one shuffle, joined by hash to the one row that stands for their
content; all other shuffles carry digests. A content with very many copies is
counted by partial aggregates, and its rows are joined to a stored table, which
adaptive execution splits.

Edge cases: null texts are empty (0 tokens); rows with a null or repeated doc_id
all stay; an empty table gives no rows and appends nothing; a cache written by
two runs at once may hold a digest twice and is read as if once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from importlib.metadata import version as library_version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from polyphon.llm.base import text_slices
from polyphon.sources.workspace import materialize

CACHE = "content string, version string, n_tokens long"


@functools.lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def _json_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_version(path: str) -> str:
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library} {library_version(library)}".encode()).hexdigest()


def _lengths(texts: list[str], path: str) -> list[int]:
    if path.endswith(".json"):
        tokenizer = _json_tokenizer(path)
        return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    pieces = _pieces(path)
    return [len(pieces.encode(t)) for t in texts]


def read_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per content; empty before the first write."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, cache_dir: str, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"content": F.sha2("text", 256), "pick": F.xxhash64("doc_id")})
    keys = materialize(rows.select("doc_id", "pick", "content", F.octet_length("text").cast("long").alias("n_bytes")), "content_keys")

    wanted = keys.groupBy("content").agg(F.min("pick").alias("pick"))
    missing = wanted.join(read_cache(spark, cache_dir, version), "content", "left_anti")
    texts = rows.join(missing.hint("shuffle_hash"), ["content", "pick"], "left_semi").select("content", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            # Rows that repeat one id and text come to one task.
            distinct = dict(zip(batch.column("content").to_pylist(), batch.column("text").to_pylist()))
            n = _lengths(list(distinct.values()), tokenizer)
            yield pa.record_batch(
                [pa.array(list(distinct), pa.string()), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                names=["content", "version", "n_tokens"],
            )

    texts.mapInArrow(encode, CACHE).distinct().write.mode("append").parquet(cache_dir)

    counts = materialize(read_cache(spark, cache_dir, version), "content_counts")
    return keys.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
