"""Ensemble training on streams: each batch gives one new model version."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from polyphon.functions.weights import with_poisson_weight
from polyphon.operators import naive_bayes as nb
from polyphon.operators import votes as vt
from polyphon.operators.streams import ensemble_fanout
from polyphon.sources.channels import write_predictions
from polyphon.sources.instances import FeatureSpec
from polyphon.sources.model_store import ModelStore
from polyphon.sources.schema import flat_schema


STAT_SCHEMA = flat_schema("member int, label string, attr string, value string, w double, wx double, wxx double")


def bag_delta(batch: DataFrame, spec: FeatureSpec, ensemble: int, seed: int) -> DataFrame:
    """What one batch adds to the ensemble's statistics."""
    return nb.nb_train(with_poisson_weight(ensemble_fanout(batch, ensemble), weight_col=spec.weight, seed=seed), spec)


def apply_batch(store: ModelStore, delta: DataFrame, batch_id: int) -> bool:
    """Add a batch's delta to the newest version and publish the result.

    A batch that is already in the published state is skipped. A crash between
    write and publish is repaired by the replay, which overwrites the same
    version. Returns whether the batch was applied.
    """
    last = store.current_version()
    if batch_id <= last:
        return False
    merged = nb.merge_stats(store.members(last).select(nb.STAT_COLUMNS), delta.select(nb.STAT_COLUMNS)) if last >= 0 else delta
    store.put(merged, version=batch_id)
    store.publish(batch_id)
    return True


def bag_train_stream(instances: DataFrame, store: ModelStore, spec: FeatureSpec, ensemble: int, checkpoint: str, seed: int = 1):
    """Bagged naive Bayes over a stream, with a persisted version per batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, bag_delta(batch, spec, ensemble, seed), batch_id)

    return instances.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_bag(batch: DataFrame, stats: DataFrame, spec: FeatureSpec, ensemble: int) -> DataFrame:
    """Combined vote of the ensemble for each instance."""
    model = nb.nb_model(stats, spec)
    votes = nb.member_votes(ensemble_fanout(batch, ensemble), model, spec, ensemble)
    return vt.flat_combine(votes, len(spec.classes))


def score_then_train_stream(
    instances: DataFrame, store: ModelStore, spec: FeatureSpec, ensemble: int, predictions: str, checkpoint: str, seed: int = 1
):
    """Each batch is scored by the ensemble so far, then trains it.

    The first batch finds no model and gets no predictions.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        last = store.current_version()
        # A replayed batch is scored by the model it was scored by before.
        before = min(last, batch_id - 1)
        if before >= 0:
            scored = score_bag(batch, store.members(before).select(nb.STAT_COLUMNS), spec, ensemble)
            write_predictions(scored, batch_id, predictions)
        apply_batch(store, bag_delta(batch, spec, ensemble, seed), batch_id)

    return instances.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_reduce(stream: DataFrame, keys: list[str], aggs: list, folder: str, checkpoint: str) -> DataFrame:
    """Running aggregates of a stream, kept by Spark's state store.

    Each batch writes the whole result (complete mode) as its own partition; the
    newest partition is the current state.
    """
    reduced = stream.groupBy(*keys).agg(*aggs)
    q = (
        reduced.writeStream.outputMode("complete").foreachBatch(lambda b, i: write_predictions(b, i, folder))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    out = stream.sparkSession.read.parquet(folder)
    newest = out.agg(F.max("batch_id"))
    return out.where(F.col("batch_id") == newest.scalar()).select(*reduced.columns)
