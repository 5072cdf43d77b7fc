"""Boosting: the chained instance weight, member statistics and training.

The instance weight λ starts at 1 and passes through the members in order. A
member adds λ to the sum of correctly or wrongly classified weight, and scales
λ by (weight seen) / (2 · that sum). Seen from one member, its λ inputs are
known for all instances before its sums start, so a member is one pass of
running sums over the stream order, and the chain is one pass per member.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from polyphon.functions.sqlexpr import add, name
from polyphon.functions.weights import with_poisson_rate
from polyphon.operators import naive_bayes as nb
from polyphon.operators import scoring as sc
from polyphon.operators.evaluation import prequential
from polyphon.operators.lookup import BROADCAST_BYTES, model_join
from polyphon.operators.prefix import BUCKET_ROWS, Running, running
from polyphon.operators.votes import vote_cols, with_argmax
from polyphon.sources.instances import FeatureSpec
from polyphon.sources.workspace import materialize


def chain_step(lam: Column, correct: Column, tw: Column, scms: Column, swms: Column) -> Column:
    """λ after a member whose sums already include this instance."""
    return lam * tw / (2 * F.when(correct, scms).otherwise(swms))


def boost_chain(flags: DataFrame, ensemble: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """λ before each member, for every instance.

    ``flags`` has ``seq, weight`` and one boolean ``correct_m`` per member m.
    Returns ``seq, weight``, ``correct_m``, ``lam_m`` (λ as it reaches member m)
    and ``lam_out``. Each member's result is written out: the next member reads
    it twice, and lineage stays one member long.
    """
    state = flags.withColumn("lam_0", F.lit(1.0))
    for m in range(ensemble):
        ok = F.col(f"correct_{m}")
        lam = F.col(f"lam_{m}")
        out = f"lam_{m + 1}" if m + 1 < ensemble else "lam_out"
        aggs = [
            Running("_scms", f"if(correct_{m}, lam_{m}, 0D)"),
            Running("_swms", f"if(correct_{m}, 0D, lam_{m})"),
        ]
        # The weight seen is the same for every member; it is summed once.
        if m == 0:
            aggs.append(Running("_tw", "weight"))
        state = running(state, "seq", aggs, bucket_rows=bucket_rows)
        state = state.withColumn(out, chain_step(lam, ok, F.col("_tw"), F.col("_scms"), F.col("_swms"))).drop("_scms", "_swms")
        if m + 1 < ensemble:
            state = materialize(state, f"chain-{m}")
    return state.drop("_tw")


def chain_long(chain: DataFrame, ensemble: int) -> DataFrame:
    """One row per instance and member: ``member, correct, lam_in, lam_out``."""
    cells = []
    for m in range(ensemble):
        nxt = f"lam_{m + 1}" if m + 1 < ensemble else "lam_out"
        cells.append(
            F.struct(
                F.lit(m).alias("member"), F.col(f"correct_{m}").alias("correct"),
                F.col(f"lam_{m}").alias("lam_in"), F.col(nxt).alias("lam_out"),
            )
        )
    return chain.select("seq", "weight", F.explode(F.array(*cells)).alias("c")).select("seq", "weight", "c.*")


def boost_member_stats(chain: DataFrame, ensemble: int) -> DataFrame:
    """Final ``scms, swms, tw`` of each member: plain sums of what passed through."""
    return member_sums(chain_long(chain, ensemble))


def member_sums(rows: DataFrame) -> DataFrame:
    """The same from ``member, correct, lam_in, weight`` rows."""
    return rows.groupBy("member").agg(
        F.sum(F.when(F.col("correct"), F.col("lam_in")).otherwise(0.0)).alias("scms"),
        F.sum(F.when(F.col("correct"), F.lit(0.0)).otherwise(F.col("lam_in"))).alias("swms"),
        F.sum("weight").alias("tw"),
    )


def correct_flags(instances: DataFrame, model: DataFrame, spec: FeatureSpec, ensemble: int) -> DataFrame:
    """``correct_m`` per instance from frozen members, in wide form.

    The models of all members are put side by side on each row, so the flags
    need neither a fan-out nor a regrouping of the stream.
    """
    n = len(spec.classes)
    if ensemble * n <= sc.COLUMN_VOTES and ensemble * spec.model_cells * 24 <= BROADCAST_BYTES:
        return _flag_columns(instances, model, spec, ensemble)
    out = instances
    for m in range(ensemble):
        one = model.where(F.col("member") == m)
        cols = [c for c in one.columns if c != "member"]
        scored = model_join(out.withColumn("member", F.lit(m)), one, ["member"], spec.model_cells * 24, "instance_id", how="left")
        scored = with_argmax(nb.votes_from_logs(scored, nb.log_votes(spec)), n, "_best")
        out = scored.withColumn(
            f"correct_{m}", F.coalesce(F.col("_best") == spec.class_index(F.col(spec.label)), F.lit(False))
        ).drop("_best", "member", *vote_cols(n), *cols)
    return out


def _flag_columns(instances: DataFrame, model: DataFrame, spec: FeatureSpec, ensemble: int) -> DataFrame:
    """The same with the models as one value: no join copies them to each row."""
    n = len(spec.classes)
    held = instances.withColumn("_models", sc.packed_models(model, spec).scalar())
    members = {f"_m_{m}": f"get(filter(_models, z -> z.member = {m}), 0)" for m in range(ensemble)}
    logged = sc.log_columns(add(held, members), spec, {str(m): f"_m_{m}" for m in range(ensemble)}, "_n", "size(_models)")
    every = [(m, i) for m in range(ensemble) for i in range(n)]
    voted = sc.apart(logged, {f"_v_{m}_{i}": f"coalesce(exp(_l_{m}_{i} - _t_{m}), 0D)" for m, i in every}, "_n")
    # As in ``votes.with_argmax``; a member without a model votes zero, and so for the first class.
    top = {m: sc.largest([f"_v_{m}_{i}" for i in range(n)]) for m in range(ensemble)}
    steps = sc.apart(voted, {f"_r_{m}_{i}": f"coalesce(rint(_v_{m}_{i} / nullif({top[m]}, 0D) * 1e12D), 0D)" for m, i in every}, "_n")
    flagged = sc.apart(steps.withColumn("_own", spec.class_index(F.col(spec.label))), {f"_top_{m}": sc.largest([f"_r_{m}_{i}" for i in range(n)]) for m in range(ensemble)}, "_n")
    arms = [" ".join(f"WHEN _r_{m}_{i} = _top_{m} THEN {i}" for i in range(n)) for m in range(ensemble)]
    flags = [f"coalesce(CASE {a} END = _own, false) AND _n >= 0 AS correct_{m}" for m, a in enumerate(arms)]
    return flagged.selectExpr(*[name(c) for c in instances.columns], *flags)


@dataclass
class BoostRun:
    """Result of training: every member's chain rows, and the members' statistics."""

    chain: DataFrame
    stats: DataFrame


def boost_train(
    instances: DataFrame, spec: FeatureSpec, ensemble: int, pure: bool = False, seed: int = 1, bucket_rows: int = BUCKET_ROWS
) -> BoostRun:
    """Online boosting of naive Bayes in the original order, instance by instance.

    A member draws k ~ Poisson(λ) (or takes k = λ when ``pure``), trains on the
    instance, tests itself on it, adds λ to its sums and passes λ on. All λ that
    reach a member are known before it starts, so the model it has at each
    instance is a set of inclusive running sums: two passes per member. A member's
    rows are written once and hold the instance, not the earlier members' columns.

    ``chain`` has ``seq, weight, member, correct, lam_in, lam_out``; ``stats`` are
    naive Bayes statistics as ``nb_train`` gives them.
    """
    kept = instances.columns
    n = len(spec.classes)
    rows = instances.withColumn("_lam", F.lit(1.0))
    chains, stats = [], []
    for m in range(ensemble):
        drawn = rows.withColumn("member", F.lit(m))
        drawn = drawn.withColumn("_k", F.col("_lam")) if pure else with_poisson_rate(drawn, "_lam", "member", "_k", seed=seed)
        drawn = drawn.withColumn("_w", F.col(spec.weight) * F.col("_k")).drop("_k")
        # Written: running sums read their source twice, and training reads it again.
        drawn = materialize(drawn, f"boost-drawn-{m}")
        stats.append(nb.nb_train(drawn, spec, weight="_w"))
        scored = with_argmax(prequential(drawn, replace(spec, weight="_w"), bucket_rows, inclusive=True), n, "_best")
        hit = F.col("_best") == spec.class_index(F.col(spec.label))
        tested = scored.withColumn("_ok", F.coalesce(hit, F.lit(False))).select(*kept, "_lam", "_ok")
        sums = [
            Running("_scms", "if(_ok, _lam, 0D)"),
            Running("_swms", "if(_ok, 0D, _lam)"),
            Running("_tw", spec.weight),
        ]
        moved = running(materialize(tested, f"boost-tested-{m}"), "seq", sums, bucket_rows=bucket_rows)
        moved = moved.withColumn("_next", chain_step(F.col("_lam"), F.col("_ok"), F.col("_tw"), F.col("_scms"), F.col("_swms")))
        done = materialize(moved.select(*kept, "_lam", "_ok", "_next"), f"boost-chain-{m}")
        chains.append(
            done.select(
                "seq", F.col(spec.weight).alias("weight"), F.lit(m).alias("member"), F.col("_ok").alias("correct"),
                F.col("_lam").alias("lam_in"), F.col("_next").alias("lam_out"),
            )
        )
        rows = done.select(*kept, F.col("_next").alias("_lam"))
    return BoostRun(chain=reduce(DataFrame.unionByName, chains), stats=reduce(DataFrame.unionByName, stats))
