"""Vote vectors: normalise, weight, add up, combine, choose.

A vote vector is one double column per class, ``v_0 … v_{n-1}`` in class order.
One grouped sum per column adds whole vectors, and a shuffle carries one row per
instance and part, not one per class. Members of an instance come from the same
input row, so the partial sums meet before the shuffle.

Intermediate values are columns of their own steps (``add``). Catalyst
keeps a step whose columns are used several times, so a vote is worked out once
per row; filters on votes stand behind an aggregation, where they cannot be
pushed down to work everything out a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from polyphon.functions.sqlexpr import add, replace, text
from polyphon.operators.lookup import model_join


def vote_cols(n_classes: int) -> list[str]:
    return [f"v_{i}" for i in range(n_classes)]


def vector_sum(n_classes: int) -> str:
    return " + ".join(vote_cols(n_classes))


def vote_normalize(df: DataFrame, n_classes: int) -> DataFrame:
    """Divide by the sum when it is positive, else leave the vector as it is."""
    summed = add(df, {"_sum": vector_sum(n_classes)})
    divided = add(summed, {"_total": "if(_sum > 0, _sum, 1D)"}).drop("_sum")
    return replace(divided, {v: f"{v} / _total" for v in vote_cols(n_classes)}).drop("_total")


def add_vectors(n_classes: int) -> list[Column]:
    """Aggregates: element-wise sum of vote vectors."""
    return [F.sum(v).alias(v) for v in vote_cols(n_classes)]


def count_votes() -> Column:
    return F.count(F.lit(1)).cast("int").alias("n_votes")


def bag_partial_votes(votes: DataFrame, n_classes: int) -> DataFrame:
    """Per instance and part: sum of normalised votes and number of members."""
    return vote_normalize(votes, n_classes).groupBy("instance_id", "part").agg(*add_vectors(n_classes), count_votes())


def boost_member_weight(scms: Column, swms: Column) -> Column:
    """Voting weight from a member's correct and wrong weight sums.

    0 when the error is 0 or above one half. A member that has seen nothing has
    no error; its weight is null, and only weights above 0 vote.
    """
    em = F.try_divide(swms, scms + swms)
    return F.when((em == 0) | (em > 0.5), F.lit(0.0)).otherwise(F.log((1 - em) / em))


def boost_partial_votes(votes: DataFrame, member_weights: DataFrame, n_classes: int, ensemble: int) -> DataFrame:
    """Per instance and part: sum of normalised votes times member weight.

    Members with weight ≤ 0 or a zero vote add nothing, but still count.
    ``member_weights`` has ``member, weight``.
    """
    weights = member_weights.select("member", F.greatest(F.col("weight"), F.lit(0.0)).alias("_mw"))
    v = model_join(votes, weights, ["member"], ensemble * 16, "instance_id", how="left")
    v = vote_normalize(v, n_classes).withColumn("_mw", F.coalesce(F.col("_mw"), F.lit(0.0)))
    v = replace(v, {c: f"{c} * _mw" for c in vote_cols(n_classes)})
    return v.groupBy("instance_id", "part").agg(*add_vectors(n_classes), count_votes())


def combine_votes(partials: DataFrame, n_classes: int, mode: str = "flat", ensemble: int | None = None) -> DataFrame:
    """Combine partial votes of an instance into one normalised vector.

    ``hierarchical`` re-normalises every incoming vector, so each part has equal
    say whatever its number of members. ``flat`` adds the parts as they are.
    With ``ensemble`` only instances that got every vote are emitted.
    """
    if mode not in ("flat", "hierarchical"):
        raise ValueError(f"unknown mode {mode!r}")
    p = vote_normalize(partials, n_classes) if mode == "hierarchical" else partials
    out = p.groupBy("instance_id").agg(*add_vectors(n_classes), F.sum("n_votes").cast("int").alias("n_votes"))
    if ensemble is not None:
        out = out.where(F.col("n_votes") == ensemble)
    return vote_normalize(out, n_classes)


def combine_two_stage(partials: DataFrame, n_classes: int, worker: Column, ensemble: int | None = None) -> DataFrame:
    """Parts → workers → one vector, each stage re-normalising what comes in.

    ``worker`` says which worker hosts a part. The partials are spread by
    instance once; both stages group by it and need no further shuffle.
    """
    first = vote_normalize(partials.withColumn("worker", worker), n_classes)
    first = first.repartition("instance_id").groupBy("instance_id", "worker").agg(
        *add_vectors(n_classes), F.sum("n_votes").cast("int").alias("n_votes")
    )
    return combine_votes(first, n_classes, mode="hierarchical", ensemble=ensemble)


def flat_combine(votes: DataFrame, n_classes: int, keys: tuple[str, ...] = ("instance_id",), keep_zero: bool = False) -> DataFrame:
    """One-stage combine of member votes.

    Zero-sum votes add nothing, and an instance with only such votes emits
    nothing; ``keep_zero`` (the commutative combiner) emits it, and gives the
    plain sum.
    """
    out = vote_normalize(votes, n_classes).groupBy(*keys).agg(*add_vectors(n_classes))
    if keep_zero:
        return out
    return vote_normalize(out.where(f"{vector_sum(n_classes)} > 0"), n_classes)


def complete_only(partials: DataFrame, n_classes: int, ensemble: int) -> DataFrame:
    return combine_votes(partials, n_classes, mode="flat", ensemble=ensemble)


def with_argmax(df: DataFrame, n_classes: int, out: str = "pred_index") -> DataFrame:
    """Add the index of the largest vote, the first one on ties.

    Votes are compared in steps of 1e-12 of the largest one, so that the order in
    which Spark added them cannot decide between equal votes, however small.
    """
    steps = [f"_r_{i}" for i in range(n_classes)]
    votes = vote_cols(n_classes)
    staged = add(df, {"_v_top": f"greatest({', '.join(votes)})" if n_classes > 1 else votes[0]})
    staged = add(staged, {r: f"coalesce(rint({v} / nullif(_v_top, 0D) * 1e12D), 0D)" for r, v in zip(steps, votes)})
    staged = add(staged, {"_r_top": f"greatest({', '.join(steps)})" if n_classes > 1 else steps[0]})
    arms = " ".join(f"WHEN {r} = _r_top THEN {i}" for i, r in enumerate(steps))
    return add(staged, {out: f"CASE {arms} END"}).drop(*steps, "_r_top", "_v_top")


def positional_votes(batches: DataFrame, n_classes: int) -> DataFrame:
    """Match the vote vectors of whole batches by their place in the list.

    ``batches`` has ``batch_id, member, vote_list`` (one vector per instance).
    Emits ``batch_id, pos, n_votes`` and the summed vector.
    """
    rows = batches.select("batch_id", "member", F.posexplode("vote_list").alias("pos", "_vec"))
    rows = add(rows, {v: f"_vec[{i}]" for i, v in enumerate(vote_cols(n_classes))}).drop("_vec")
    return vote_normalize(rows, n_classes).groupBy("batch_id", "pos").agg(*add_vectors(n_classes), count_votes())


def long_votes(df: DataFrame, keys: list[str], classes: tuple[str, ...], digits: int = 6) -> DataFrame:
    """One row per class, for reports: ``label, vote`` rounded."""
    pairs = ", ".join(f"named_struct('label', {text(c)}, 'vote', {v})" for c, v in zip(classes, vote_cols(len(classes))))
    rows = df.selectExpr(*keys, f"inline(array({pairs}))")
    return rows.withColumn("vote", F.round("vote", digits))
