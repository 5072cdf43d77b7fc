"""A stream that brings new models and evaluators between its instances.

A row's ``kind`` says what it is. An ``instance`` trains the model. A ``model``
row carries a model as a payload: the learner goes on from its statistics, and
its counter starts at zero. An ``evaluator`` row carries an evaluator, which goes
on from the cells it has gathered and leaves the model alone. Other kinds are no
part of the stream (``rejected``), or stop the job (``versions.known_kinds``).

Every replacement starts an epoch. Statistics and cells add up, so an epoch's
state is what its payload holds plus the sums of its own rows: one aggregation
by epoch, combined map-side, in place of a fold over the stream. Payloads are
as large as a header allows, however long the stream is.

Edge cases: epoch 0 starts from nothing; a payload without cells starts its epoch
from nothing; a broken or missing payload stops the job; of an epoch without
instances the payload's state is left; an instance before the first model, or
under an empty one, gets no prediction and is not judged; an empty stream has no
epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from polyphon.functions.payload import decode_text, encode_payload
from polyphon.operators import naive_bayes as nb
from polyphon.operators import votes as vt
from polyphon.operators.prefix import Running, running
from polyphon.sources.instances import FeatureSpec
from polyphon.sources.schema import flat_schema

KINDS = ("instance", "model", "evaluator")
MODEL_CELL = ("label", "attr", "value", "w", "wx", "wxx")
JUDGE_CELL = ("truth", "pred", "w")
MODEL = StructType([StructField("cells", ArrayType(flat_schema("label string, attr string, value string, w double, wx double, wxx double")))])
EVALUATOR = StructType([StructField("cells", ArrayType(flat_schema("truth string, pred string, w double")))])


def payloads(cells: DataFrame, keys: list[str], fields: tuple[str, ...]) -> DataFrame:
    """One ``payload`` per key from the cells of a model (``MODEL_CELL``) or an evaluator (``JUDGE_CELL``)."""
    return cells.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("cells")).select(*keys, encode_payload("cells").alias("payload"))


def rejected(stream: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows of no known kind; a missing kind is none."""
    return stream.where(~F.coalesce(F.col(kind).isin(list(KINDS)), F.lit(False)))


def with_epochs(stream: DataFrame, kind: str = "kind", order: str = "seq") -> DataFrame:
    """Rows of known kinds with ``model_epoch`` and ``judge_epoch``: the replacements up to each row."""
    started = [Running(f"{n}_epoch", f"if({kind} = '{k}', 1L, 0L)") for n, k in (("model", "model"), ("judge", "evaluator"))]
    return running(stream.where(F.col(kind).isin(list(KINDS))), order, started)


def _decoded(payload: Column, schema: StructType) -> Column:
    body = decode_text(payload, schema)
    return F.when(body.isNotNull(), body).otherwise(F.raise_error(F.lit("a replacement's payload cannot be read")).cast(schema))


def brought_models(epoched: DataFrame) -> DataFrame:
    """Statistics that each model epoch began with, in long form."""
    rows = epoched.where("kind = 'model'").select("model_epoch", _decoded(F.col("payload"), MODEL).alias("_m"))
    return rows.selectExpr("model_epoch", "inline(_m.cells)")


def epoch_models(epoched: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Statistics at the end of each model epoch: what was brought, and what the epoch's instances taught."""
    own = nb.nb_train(epoched.where("kind = 'instance'"), spec, weight=spec.weight, keys=("model_epoch",))
    return nb.merge_stats(brought_models(epoched).select(*own.columns), own, keys=("model_epoch",))


def epoch_counters(epoched: DataFrame) -> DataFrame:
    """Instances trained since the replacement, per model epoch; 0 where none followed."""
    return epoched.groupBy("model_epoch").agg(F.count_if(F.col("kind") == "instance").alias("trained_n"))


def predictions(epoched: DataFrame, spec: FeatureSpec, epochs: int) -> DataFrame:
    """``judge_epoch, truth, weight, pred`` of each instance by the model its epoch began with.

    ``epochs`` bounds the number of models, which decides how they are joined.
    """
    rows = epoched.where("kind = 'instance'").select(
        "instance_id", "model_epoch", "judge_epoch", F.col(spec.label).alias("truth"), F.col(spec.weight).alias("weight"), *spec.numeric, *spec.nominal
    )
    keys = ("model_epoch",)
    voted = nb.member_votes(rows, nb.nb_model(brought_models(epoched), spec, keys), spec, epochs, keys)
    best = vt.with_argmax(voted, len(spec.classes), "_best")
    return best.select("judge_epoch", "truth", "weight", spec.class_at(F.col("_best")).alias("pred"))


def epoch_evaluators(epoched: DataFrame, scored: DataFrame) -> DataFrame:
    """Cells ``truth, pred, w`` at the end of each evaluator epoch: what was brought, and what was judged since."""
    rows = epoched.where("kind = 'evaluator'").select("judge_epoch", _decoded(F.col("payload"), EVALUATOR).alias("_e"))
    brought = rows.selectExpr("judge_epoch", "inline(_e.cells)")
    judged = scored.select("judge_epoch", "truth", "pred", F.col("weight").alias("w"))
    return brought.unionByName(judged).groupBy("judge_epoch", "truth", "pred").agg(F.sum("w").alias("w"))
