"""Rows met by following "next" pointers from the first row of each key.

Several controls re-arm: a window opens at the first event after the last one
closed, a snapshot may be requested once the last one is published. Which rows
open a window depends on all earlier ones, but each row knows where the chain
would go *if* it were on it. Pointer doubling then finds the chain in
log2(length) joins, instead of one task walking it.

``block_orbit`` does it with a fixed number of passes where positions are unique:
blocks of consecutive rows find where each row leaves them, the few rows at which
blocks are entered make up a shorter chain, and blocks are walked from there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from polyphon.sources.workspace import materialize


def orbit(nodes: DataFrame, keys: list[str], pos: str, nxt: str) -> DataFrame:
    """Rows ``(keys, pos)`` on the chain that starts at each key's smallest ``pos``.

    ``nxt`` is the position a chain moves to from this row, further on in the
    same key, or null at the end. A position that has no row ends the chain too.
    Positions are unique per key.
    """
    jumps = nodes.select(*keys, F.col(pos).alias("_p"), F.col(nxt).alias("_n"))
    there = nodes.select(*keys, F.col(pos).alias("_n"), F.lit(True).alias("_there"))
    jumps = jumps.join(there, [*keys, "_n"], "left")
    jumps = materialize(jumps.select(*keys, "_p", F.when(F.col("_there"), F.col("_n")).alias("_n")), "orbit-jumps")
    reached = materialize(jumps.groupBy(*keys).agg(F.min("_p").alias("_p")), "orbit-reached")
    while True:
        # Chain members found so far are the first 2^i steps; jumps go 2^i far.
        # Each round adds one written table, so the union stays short.
        step = (
            reached.join(jumps, [*keys, "_p"])
            .where(F.col("_n").isNotNull())
            .select(*keys, F.col("_n").alias("_p"))
        )
        step = materialize(step, "orbit-step")
        if step.isEmpty():
            break
        reached = reached.unionByName(step)
        far = jumps.select(*keys, F.col("_p").alias("_n"), F.col("_n").alias("_far"))
        jumps = materialize(
            jumps.where(F.col("_n").isNotNull()).join(far, [*keys, "_n"]).where(F.col("_far").isNotNull())
            .select(*keys, "_p", F.col("_far").alias("_n")),
            "orbit-jumps",
        )
    return reached.withColumnRenamed("_p", pos)


# Rows of one block; a block is worked on in one task's memory, some 10 MB.
BLOCK_ROWS = 1 << 18


def block_orbit(nodes: DataFrame, key: str, pos: str, nxt: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``orbit`` for one key column and whole-number positions, each once per key; rows without a key are left out.

    ``nodes`` is read several times, so it should be written out. Where the blocks' exits
    are not far fewer than the rows, chains are short, and pointer doubling finds them.
    """
    # A row at the end points to itself: nulls would turn the column into doubles, which hold 53 bits.
    rows = nodes.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_k"), F.col(pos).cast("long").alias("_p"), F.coalesce(F.col(nxt), F.col(pos)).cast("long").alias("_n")
    )
    kind = rows.schema["_k"].dataType.simpleString()
    n = rows.count()
    starts = rows.groupBy("_k").agg(F.min("_p").alias("_p"))
    if n <= block_rows:
        blocks, entered = rows.withColumn("_b", F.lit(0)), starts.withColumn("_b", F.lit(0))
    else:
        placed = rows.repartitionByRange(math.ceil(n / block_rows), "_k", "_p").sortWithinPartitions("_k", "_p").withColumn("_b", F.spark_partition_id())
        blocks = materialize(placed.mapInPandas(_exits, f"_k {kind}, _p long, _n long, _b int, _e long"), "orbit-blocks")
        entries = starts.unionByName(blocks.where("_e > _p").select("_k", F.col("_e").alias("_p"))).distinct()
        entries = materialize(entries.join(blocks.select("_k", "_p", "_e", "_b"), ["_k", "_p"]), "orbit-entries")
        if entries.count() > n // 2:
            return orbit(nodes.where(F.col(key).isNotNull()).select(key, pos, nxt), [key], pos, nxt)
        entered = block_orbit(entries, "_k", "_p", "_e", block_rows).join(entries.select("_k", "_p", "_b"), ["_k", "_p"])
    # Both sides may come from the same rows: columns of their own keep them apart.
    entered = entered.select(F.col("_k").alias("_ek"), F.col("_p").alias("_ep"), F.col("_b").alias("_eb"))
    walked = blocks.select("_k", "_p", "_n", "_b").groupBy("_b").cogroup(entered.groupBy("_eb")).applyInPandas(_walk, f"_k {kind}, _p long")
    return walked.select(F.col("_k").alias(key), F.col("_p").cast(nodes.schema[pos].dataType).alias(pos))


def _pointers(rows: pd.DataFrame) -> Iterator[tuple[object, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Per key of sorted rows: its place, positions, the index that each row points to (-1: none here), and whether that is further on."""
    codes, names = pd.factorize(rows["_k"])
    edges = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
    p, n = rows["_p"].to_numpy("int64"), rows["_n"].to_numpy("int64")
    for a, b in zip(edges, edges[1:]):
        own, to = p[a:b], n[a:b]
        at = np.minimum(np.searchsorted(own, to), b - a - 1)
        yield names[codes[a]], slice(a, b), own, np.where((own[at] == to) & (to > own), at, -1), to > own[-1]


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds ``_e``: the position beyond the block that a chain on this row moves to, or the row's own."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    out, n = np.zeros(len(rows), dtype="int64"), rows["_n"].to_numpy("int64")
    for _, place, own, at, beyond in _pointers(rows):
        last = np.where(at >= 0, at, np.arange(len(own)))
        while not np.array_equal(further := last[last], last):
            last = further
        out[place] = np.where(beyond[last], n[place][last], own)
    yield rows.assign(_e=out)


def _walk(rows: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
    """Rows of a block on the chains that enter it."""
    found = []
    if len(rows) and len(entered):
        begin = {k: g.to_numpy("int64") for k, g in entered.groupby("_ek")["_ep"]}
        for k, _, own, at, _ in _pointers(rows.sort_values(["_k", "_p"], ignore_index=True)):
            on, to = set(), at.tolist()
            for i in np.searchsorted(own, begin.get(k, np.empty(0, dtype="int64"))).tolist():
                while i >= 0 and i not in on:
                    on.add(i)
                    i = to[i]
            if on:
                found.append(pd.DataFrame({"_k": k, "_p": own[sorted(on)]}))
    return pd.concat(found) if found else pd.DataFrame({"_k": pd.Series(dtype=rows["_k"].dtype), "_p": pd.Series(dtype="int64")})
