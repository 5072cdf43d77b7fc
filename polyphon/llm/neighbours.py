"""Nearest neighbours with a hash-prefix forest.

Each of ``TREES`` trees gives every vector a long hash string: the signs of
``DEPTH`` random projections against thresholds (medians over a bounded sample),
packed into one integer. A tree is the sorted array of these strings, so the
vectors that share a prefix with a query are one range of it, found by two
binary searches. A query descends to its longest matching prefix in every tree;
then all trees ascend together, one level at a time, until the ranges hold
enough different candidates. All of the level's candidates are scored exactly;
none is cut off.

The index is laid out in shards of about ``SHARD_ROWS`` distinct vectors, each
with its own forest; every vector is in one shard. Queries go to all shards in
blocks, each (shard, block) is one task group of bounded size, and only the
nearest of each shard leave it. Equal vectors are one entry with a member list;
as a query needs ``k`` others at most, its smallest k + 1 ids are enough.

Near-isotropic vectors, such as the test tables', have no prefix structure to
exploit: a given recall there needs a given share of the rows, hence ``share``.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither as query nor as candidate; vectors of another
length than most of the sample take no part; ties go to the smaller id; a
repeated id is one entry per distinct vector; fewer than k candidates are all
returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from polyphon.sources.workspace import materialize

TREES = 32
DEPTH = 32
SHARD_ROWS = 8192
QUERY_BLOCK = 256
SAMPLE_ROWS = 10_000
SHARE = 0.45
LEAST_CANDIDATES = 1024
SEED = 5

FOUND = "query long, entry long, score double"


class Forest:
    """Sorted hash strings per tree over one shard."""

    def __init__(self, vectors: np.ndarray, planes: np.ndarray, thresholds: np.ndarray):
        codes = hash_strings(vectors, planes, thresholds)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=0)
        self.size = len(vectors)

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query, tree and prefix length (0 to DEPTH) the range of entries that share the prefix."""
        lengths = np.arange(DEPTH + 1, dtype=np.uint64)
        masks = ((np.uint64(1) << np.uint64(DEPTH)) - np.uint64(1)) ^ ((np.uint64(1) << (np.uint64(DEPTH) - lengths)) - np.uint64(1))
        lo = np.empty((*queries.shape, DEPTH + 1), np.int64)
        hi = np.empty_like(lo)
        for t in range(queries.shape[1]):
            first = queries[:, t, None] & masks
            last = first | (~masks & ((np.uint64(1) << np.uint64(DEPTH)) - np.uint64(1)))
            lo[:, t] = np.searchsorted(self.codes[:, t], first, side="left")
            hi[:, t] = np.searchsorted(self.codes[:, t], last, side="right")
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray, wanted: int) -> np.ndarray:
        """Entries of one query: descend to the longest match, ascend all trees until enough are met."""
        totals = (hi - lo).sum(axis=0)
        level = DEPTH
        while level and totals[level] < wanted:
            level -= 1
        met = np.zeros(self.size, bool)
        while True:
            for t in range(lo.shape[0]):
                met[self.order[lo[t, level] : hi[t, level], t]] = True
            if level == 0 or np.count_nonzero(met) >= wanted:
                return np.flatnonzero(met)
            level -= 1


def hash_strings(vectors: np.ndarray, planes: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """One integer of DEPTH bits per vector and tree, first bit highest."""
    weights = np.uint64(1) << np.arange(DEPTH - 1, -1, -1, dtype=np.uint64)
    out = np.empty((len(vectors), len(planes)), np.uint64)
    for t, (plane, limit) in enumerate(zip(planes, thresholds)):
        out[:, t] = ((vectors @ plane > limit) * weights).sum(axis=1, dtype=np.uint64)
    return out


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value.
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, share: float = SHARE, least: int = LEAST_CANDIDATES, shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Per query (ids divisible by ``every``) its ``k`` nearest: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    rows = materialize(_usable(vectors, id_col, vector_col).withColumn("key", F.xxhash64("v")), "vectors")
    sample = rows.orderBy("key", "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()
    if sample.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = int(sample["v"].map(len).mode().min())
    x = np.stack([v for v in sample["v"] if len(v) == width]).astype(np.float64)
    planes = np.random.default_rng(SEED).standard_normal((TREES, width, DEPTH))
    thresholds = np.stack([np.median(x @ p, axis=0) for p in planes])
    rows = rows.where(F.size("v") == width)

    # One entry per distinct vector, named by its smallest id, with its k + 1 smallest ids.
    ranked = rows.select("v", "key", "vec_id").distinct()
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("key", "v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    entries = ranked.groupBy("key", "v").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    entries = materialize(entries.withColumn("entry", F.xxhash64("first", "key")), "entries")
    shards = max(1, -(-entries.count() // shard_rows))
    index = entries.select(F.pmod("key", F.lit(shards)).alias("shard"), "entry", "v")

    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # A query is named by a number of its own, as an id may be repeated with other vectors.
    queries = materialize(queries.withColumn("query", F.xxhash64("vec_id", "v")).withColumn("block", F.pmod("query", F.lit(blocks))), "queries")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        own, asked = group[group["is_entry"]].sort_values("id"), group[~group["is_entry"]].sort_values("id")
        if own.empty or asked.empty:
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "entry": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        mine, ids = _matrix(own["v"]), own["id"].to_numpy()
        forest = Forest(mine, planes, thresholds)
        points = _matrix(asked["v"])
        wanted = max(least, int(np.ceil(share * len(own))))
        out = []
        for first in range(0, len(points), 64):
            some = points[first : first + 64]
            lo, hi = forest.ranges(hash_strings(some, planes, thresholds))
            for i, (name, p) in enumerate(zip(asked["id"].iloc[first : first + 64], some)):
                near = forest.candidates(lo[i], hi[i], wanted)
                # Added up in order of the components, as a plain sum would.
                d = np.sqrt(np.cumsum(np.square(mine[near] - p), axis=1)[:, -1])
                if len(d) > k + 1:
                    # Everything as near as the (k+1)-th stays, so that ties are settled over all shards.
                    limit = np.partition(d, k)[k]
                    near, d = near[d <= limit], d[d <= limit]
                out.append(pd.DataFrame({"query": name, "entry": ids[near], "score": d}))
        return pd.concat(out)

    # The stated query set against all rows, in blocks: entries go to all blocks, queries to all shards.
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    both = index.select("shard", each(blocks).alias("block"), F.lit(True).alias("is_entry"), F.col("entry").alias("id"), "v").unionByName(
        queries.select(each(shards).alias("shard"), "block", F.lit(False).alias("is_entry"), F.col("query").alias("id"), "v")
    )
    found = both.groupBy("shard", "block").applyInPandas(search, FOUND)

    named = found.join(queries.select("query", F.col("vec_id").alias("query_id")), "query").join(entries.select("entry", "members"), "entry")
    pairs = named.select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    # An id with several vectors counts once, by its nearest one.
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
