"""Replayable random weights as plain column arithmetic.

The weight of an (instance, member) pair is drawn from a hash of its ids and a
seed, so a retried task, a replayed batch and a second engine all draw the same
number. The hash is 32-bit multiply-and-shift mixing in 64-bit arithmetic: it
stays inside generated code and costs a few nanoseconds a row, where a digest
with string slicing costs about a microsecond.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from polyphon.functions.sqlexpr import add

MASK = 0xFFFFFFFF
# Odd multipliers below 2^31, so that a 32-bit value times one of
# them never overflows a signed 64-bit product.
MEMBER_STEP = 0x2545F491
HIGH_STEP = 0x1B873593
SEED_STEP = 0x165667B1
MIX_A = 0x7FEB352D
MIX_B = 0x5BD1E995

SCALE = 1 << 32


def hash32_text(instance_id: str, member: str, seed: int = 1) -> str:
    """SQL text of a 32-bit hash (as long) of instance id, member and seed.

    The member and the seed choose the odd multiplier of the first mixing step,
    so members are not shifted copies of each other along the ids. The id's low
    word goes through that step, and its high word joins behind it: which ids
    meet in one hash is then another matter in each member and seed, so no two
    ids have equal draws throughout.
    """
    start = (seed * SEED_STEP) & MASK
    key = f"(((cast({member} AS BIGINT) + 1L) * {MEMBER_STEP}L + {start}L) & 2147483647L)"
    h = f"({instance_id} & {MASK}L)"
    h = f"((({h} ^ shiftright({h}, 16)) * ({key} | 1L) + (({key} * {HIGH_STEP}L) & {MASK}L)) & {MASK}L)"
    h = f"({h} ^ (shiftright({instance_id}, 32) & {MASK}L))"
    h = f"((({h} ^ shiftright({h}, 16)) * {MIX_A}L) & {MASK}L)"
    h = f"((({h} ^ shiftright({h}, 15)) * {MIX_B}L) & {MASK}L)"
    return f"({h} ^ shiftright({h}, 16))"


def hash32(instance_id: str, member: str, seed: int = 1) -> Column:
    """The hash as a column; ``instance_id`` (long) and ``member`` are SQL text."""
    return F.expr(hash32_text(instance_id, member, seed))


def poisson_thresholds(lam: float = 1.0) -> list[int]:
    """Integer steps t_0 < t_1 < … of the Poisson distribution function.

    k is the number of steps at or below the hash. The list ends where the
    distribution function reaches 1 to the hash's own 32-bit resolution, so no
    count is cut off that the hash could tell apart.
    """
    steps, term, total, j = [], math.exp(-lam), 0.0, 0
    while True:
        total += term
        step = math.ceil(total * SCALE)
        if step >= SCALE:
            return steps
        steps.append(step)
        j += 1
        term *= lam / j


def poisson_count_text(h: str, lam: float = 1.0) -> str:
    """Inverse-distribution draw of a Poisson(``lam``) count from a 32-bit hash."""
    steps = poisson_thresholds(lam)
    arms = " ".join(f"WHEN {h} < {step}L THEN {j}" for j, step in enumerate(steps))
    return f"CASE {arms} ELSE {len(steps)} END"


# A rate is split into pieces of at most this size before drawing. exp(-rate)
# stays far from underflow and no rate has to be cut down.
RATE_PIECE = 16.0
# From this rate on the count is drawn from a normal variable.
LARGE_RATE = 4096.0


def with_poisson_rate(df: DataFrame, rate: str, member: str, out: str, id_col: str = "instance_id", seed: int = 1) -> DataFrame:
    """Add ``out`` (long): a Poisson count for a rate that differs by row and has no upper bound.

    Poisson(a + b) is the sum of independent Poisson(a) and Poisson(b) draws.
    The rate is therefore cut into pieces of at most ``RATE_PIECE``, and piece p
    draws from its own hash (the piece is added to the member word). Within a
    piece the count is the number of distribution steps at or below the hash;
    the steps end where the tail is below the hash's resolution. The steps of all
    rows of an Arrow batch are counted together.

    A rate of ``LARGE_RATE`` or more takes one normal variable z from two hashes
    and gives round(rate + sqrt(rate) z + (z² - 1) / 6): the first two terms of
    the expansion of the Poisson quantile. What is left out is below 1 / sqrt(rate),
    so the count is off by one in at most a few percent of the draws.
    """
    sized = add(df, {"_large": f"coalesce({rate} >= {LARGE_RATE}D, false)"})
    sized = add(sized, {"_pieces": f"if(_large, 1L, greatest(ceil({rate} / {RATE_PIECE}D), 1L))"})
    sized = add(sized, {"_share": f"if(_large, 0D, {rate} / _pieces)"})
    u = "({} + 0.5D) / {}D".format
    ready = add(
        sized,
        {
            "_zero": "exp(-_share)",
            "_us": f"transform(sequence(0L, _pieces - 1L), p -> {hash32_text(id_col, f'({member} + p * 65536L)', seed)} / {float(SCALE)}D)",
            "_z": f"if(_large, sqrt(-2D * ln({u(hash32_text(id_col, member, seed), float(SCALE))}))"
            f" * cos(2D * pi() * {u(hash32_text(id_col, f'({member} + 65536L)', seed), float(SCALE))}), 0D)",
        },
    )
    large = f"cast(rint({rate} + sqrt({rate}) * _z + (_z * _z - 1D) / 6D) AS BIGINT)"
    counted = ready.withColumn("_drawn", _poisson_steps("_share", "_zero", "_us"))
    return add(counted, {out: f"if(_large, {large}, _drawn)"}).drop("_large", "_pieces", "_share", "_zero", "_us", "_z", "_drawn")


@F.pandas_udf(LongType())
def _poisson_steps(share: pd.Series, zero: pd.Series, us: pd.Series) -> pd.Series:
    """Number of distribution steps of Poisson(share) at or below each of a row's draws, added up; ``zero`` is exp(-share)."""
    known = (share.notna() & us.notna()).to_numpy()
    out = pd.Series(np.zeros(len(share), dtype="int64"), index=share.index).astype("Int64")
    out[~known] = None
    if not known.any():
        return out
    lists = us[known].tolist()
    sizes = np.fromiter((len(x) for x in lists), dtype="int64", count=len(lists))
    u = np.concatenate(lists).astype("float64")
    of = np.repeat(np.arange(len(lists)), sizes)
    rate, cdf = share[known].to_numpy("float64")[of], zero[known].to_numpy("float64")[of]
    term, last, k = cdf.copy(), np.ceil(rate + np.sqrt(rate) * 8 + 12), np.zeros(len(u), dtype="int64")
    left = np.arange(len(u))
    j = 1
    # A draw is done at the first step above it: the steps only rise.
    while len(left := left[(u[left] >= cdf[left]) & (j <= last[left])]):
        k[left] += 1
        term[left] = term[left] * rate[left] / j
        cdf[left] += term[left]
        j += 1
    out[known] = np.bincount(of, weights=k, minlength=len(lists)).astype("int64")
    return out


def with_poisson_weight(
    df: DataFrame, id_col: str = "instance_id", member_col: str = "member", weight_col: str = "weight", seed: int = 1
) -> DataFrame:
    """Bagging weight of each (instance, member) row; rows that draw 0 are dropped.

    Adds ``k`` and ``w = weight * k``. The drop is a comparison on the hash
    alone, so it runs before the count is built, in the same generated loop.
    """
    first = poisson_thresholds(1.0)[0]
    hashed = add(df, {"_h": hash32_text(id_col, member_col, seed)}).where(f"_h >= {first}L")
    counted = add(hashed, {"k": poisson_count_text("_h")}).drop("_h")
    return add(counted, {"w": f"{weight_col} * k"})
