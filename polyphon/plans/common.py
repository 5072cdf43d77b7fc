"""Shared inputs of the catalogue's queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polyphon.functions.timeutil import epoch_ms
from polyphon.operators import naive_bayes as nb
from polyphon.operators import scoring as sc
from polyphon.operators.streams import ensemble_fanout, member_partition
from polyphon.plans.bagging import bag_train, share_of_stream
from polyphon.sources.instances import (
    EVENTS_SPEC, LINEITEM_SPEC, FeatureSpec, complete_header, events_instances, lineitem_instances, read_table,
)

ENSEMBLE = 5
PARTS = 2
SEED = 7
BOOST = 3
TRAIN_SHARE = 0.8


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_instances(read_table(spark, sf_dir, "events"))


@lru_cache(maxsize=64)
def _header(spark: SparkSession, sf_dir: str, table: str) -> FeatureSpec:
    if table == "events":
        return complete_header(events(spark, sf_dir), EVENTS_SPEC)
    return complete_header(lineitem_instances(read_table(spark, sf_dir, "lineitem")), LINEITEM_SPEC)


def events_spec(spark: SparkSession, sf_dir: str) -> FeatureSpec:
    """Header of the events stream: classes and nominal values, read once per session."""
    return _header(spark, sf_dir, "events")


def lineitem_spec(spark: SparkSession, sf_dir: str) -> FeatureSpec:
    return _header(spark, sf_dir, "lineitem")


def stream_cut(spark: SparkSession, sf_dir: str, share: float = TRAIN_SHARE) -> Column:
    """End of the first ``share`` of the events; counted on the stored table."""
    return share_of_stream(read_table(spark, sf_dir, "events"), share)


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("seq") < stream_cut(spark, sf_dir))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("seq") >= stream_cut(spark, sf_dir))


def trained(spark: SparkSession, sf_dir: str, ensemble: int = ENSEMBLE) -> DataFrame:
    """Statistics of the bagged ensemble on the first part of the stream; the rest is held out."""
    return bag_train(train_rows(spark, sf_dir), events_spec(spark, sf_dir), ensemble, SEED)


def all_votes(spark: SparkSession, sf_dir: str, ensemble: int = ENSEMBLE) -> DataFrame:
    """Votes of an ensemble trained on the whole stream on every event, with part and label."""
    spec = events_spec(spark, sf_dir)
    rows = events(spark, sf_dir).select("instance_id", "seq", "weight", *spec.numeric, *spec.nominal, F.col("label").alias("truth"))
    fanned = member_partition(ensemble_fanout(rows, ensemble), ensemble, PARTS)
    return nb.member_votes(fanned, nb.nb_model(bag_train(events(spark, sf_dir), spec, ensemble, SEED), spec), spec, ensemble)


def row_votes(spark: SparkSession, sf_dir: str, ensemble: int = ENSEMBLE, stats: DataFrame | None = None) -> DataFrame:
    """The same votes, all members' on the event's row; ``stats`` has the members when they are trained already."""
    spec = events_spec(spark, sf_dir)
    rows = events(spark, sf_dir).select("instance_id", "seq", "weight", *spec.numeric, *spec.nominal, F.col("label").alias("truth"))
    if stats is None:
        stats = bag_train(events(spark, sf_dir), spec, ensemble, SEED)
    return sc.row_votes(rows, stats, spec, ensemble)


# A set of an order's votes is forgotten this long after its first vote.
SET_MS = 365 * 86_400_000


def order_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as votes on their order: each arrives when it ships, at the combiner of its supplier.

    Orders have different numbers of lines over years, so complete, late and
    incomplete sets occur by themselves.
    """
    lines = read_table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("instance_id"), epoch_ms(lines, "l_shipdate").alias("ts_ms"), F.lit(1).cast("long").alias("n_votes"),
        F.col("l_suppkey").alias("combiner"), F.col("l_returnflag").alias("label"),
    )


def delayed_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``delay_ms``: from the order's date, when the vote was asked for, to its arrival."""
    orders = read_table(spark, sf_dir, "orders")
    asked = orders.select(F.col("o_orderkey").alias("instance_id"), epoch_ms(orders, "o_orderdate").alias("asked_ms"))
    votes = order_votes(spark, sf_dir).join(asked, "instance_id")
    return votes.withColumn("delay_ms", F.col("ts_ms") - F.col("asked_ms")).drop("asked_ms")
