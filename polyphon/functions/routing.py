"""Routing keys: which part, bucket or member set a row belongs to."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def member_partition(member: Column, ensemble: int, parts: int) -> Column:
    """Part that owns a member: equal slices, the last part takes the rest.

    With more parts than members every slice is empty but the last one.
    """
    size = ensemble // parts
    if size == 0:
        return F.lit(parts - 1)
    return F.least(F.floor(member / F.lit(size)), F.lit(parts - 1)).cast("int")


def partition_sizes(ensemble: int, parts: int) -> list[int]:
    """Number of members in each part, under the same rule."""
    size = ensemble // parts
    return [size] * (parts - 1) + [ensemble - size * (parts - 1)]


def id_bucket(seq: Column, n: int) -> Column:
    return F.pmod(seq, F.lit(n)).cast("int")


def replica_set_members(seq: Column, ensemble: int, n: int) -> Column:
    """Members of the set that handles a message: every n-th, from ``seq mod n``."""
    first = F.pmod(seq, F.lit(n)).cast("int")
    # Sets past the ensemble size are empty.
    return F.when(first < F.lit(ensemble), F.sequence(first, F.lit(ensemble - 1), F.lit(n))).otherwise(
        F.array().cast("array<int>")
    )


def sub_ensemble_members(seq: Column, ensemble: int, size: int) -> Column:
    """Members of the consecutive sub-ensemble picked by the message id.

    A tail shorter than ``size`` belongs to no sub-ensemble.
    """
    sets = ensemble // size
    if sets == 0:
        raise ValueError("ensemble is smaller than one sub-ensemble")
    chosen = F.pmod(seq, F.lit(sets)).cast("int")
    return F.sequence(chosen * size, chosen * size + size - 1)
