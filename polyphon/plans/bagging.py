"""Bagging from instances to an evaluated ensemble, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from polyphon.functions.weights import with_poisson_weight
from polyphon.operators import evaluation as ev
from polyphon.operators import naive_bayes as nb
from polyphon.operators import scoring as sc
from polyphon.operators import votes as vt
from polyphon.operators.lookup import version_asof
from polyphon.operators.streams import ensemble_fanout
from polyphon.sources.instances import FeatureSpec


def share_of_stream(instances: DataFrame, share: float) -> Column:
    """Stream number that cuts off the first ``share`` of the rows, as a scalar subquery.

    Stream numbers are gapless, so a row count is enough; it is read from file
    footers, and the comparison reaches the scan as a pushed filter.
    """
    n = instances.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("n"))
    return n.scalar()


def bag_train(instances: DataFrame, spec: FeatureSpec, ensemble: int, seed: int) -> DataFrame:
    """Fan out, weight, and gather every member's statistics."""
    fanned = ensemble_fanout(instances, ensemble)
    return nb.nb_train(with_poisson_weight(fanned, weight_col=spec.weight, seed=seed), spec)


def bag_predict(instances: DataFrame, stats: DataFrame, spec: FeatureSpec, ensemble: int) -> DataFrame:
    """``instance_id, truth, weight, pred`` and the combined vote vector.

    All members vote on the instance's own row, so nothing is shuffled.
    """
    rows = instances.select(
        "instance_id", F.col(spec.label).alias("truth"), F.col(spec.weight).alias("weight"), *spec.numeric, *spec.nominal, *spec.open
    )
    return labelled(sc.row_votes(rows, stats, spec, ensemble), spec)


def labelled(voted: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The members' votes on each row combined, with the label that wins."""
    combined = sc.flat_rows(voted, len(spec.classes), ["instance_id", "truth", "weight"])
    best = vt.with_argmax(combined, len(spec.classes), "_best")
    return best.withColumn("pred", spec.class_at(F.col("_best"))).drop("_best")


def score_asof(
    messages: DataFrame, published: DataFrame, stats: DataFrame, spec: FeatureSpec, ensemble: int, versions: int, pending: int = 100
) -> DataFrame:
    """Votes of each member in the version in force when the message came.

    ``published`` has ``version, published_seq`` and ``stats`` the statistics per
    ``version, member``, of at most ``versions`` versions. A message before the
    first adoption gets no votes; nor does it from a member that its version lacks.
    """
    adopted = ensemble_fanout(version_asof(messages, published, pending), ensemble)
    keys = ("version", "member")
    return nb.member_votes(adopted, nb.nb_model(stats, spec, keys), spec, ensemble * versions, keys)


def bag_holdout(instances: DataFrame, spec: FeatureSpec, ensemble: int, seed: int, share: float = 0.8) -> DataFrame:
    """Train on the first ``share`` of the stream, evaluate on the rest; one row."""
    cut = share_of_stream(instances, share)
    stats = bag_train(instances.where(F.col("seq") < cut), spec, ensemble, seed)
    scored = bag_predict(instances.where(F.col("seq") >= cut), stats, spec, ensemble)
    return ev.basic_evaluator(scored)
