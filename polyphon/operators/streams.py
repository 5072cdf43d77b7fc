"""Batching, fan-out, routing and merging of instance streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from polyphon.functions import routing
from polyphon.operators.prefix import BUCKET_ROWS, Running, running

BATCH_SIZE = 100


def instance_batches(instances: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Number the batches of the stream and the place of each row in its batch."""
    return instances.withColumn("batch_no", F.floor(F.col("seq") / batch_size).cast("long")).withColumn(
        "pos", F.pmod(F.col("seq"), F.lit(batch_size)).cast("int")
    )


def bounded_passes(instances: DataFrame, max_instances: int | Column, passes: int) -> DataFrame:
    """The first ``max_instances`` of the stream, ``passes`` times over.

    A negative bound means the whole stream. Stream numbers start at 0.
    """
    if isinstance(max_instances, Column):
        kept = instances.where(F.col("seq") < max_instances)
    elif max_instances < 0:
        kept = instances
    else:
        kept = instances.where(F.col("seq") < max_instances)
    return kept.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))


def message_id(messages: DataFrame, source: str, order: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Stamp ``msg_seq`` = 1, 2, … on the messages of each source in arrival order.

    A source with a third of all messages is still cut into bounded ranges.
    """
    return running(messages, order, [Running("msg_seq", "1L")], keys=[source], bucket_rows=bucket_rows)


def ensemble_fanout(instances: DataFrame, ensemble: int) -> DataFrame:
    """One copy of each instance per member; a narrow step, nothing is shuffled."""
    return instances.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(ensemble - 1))))


def stream_merge(*streams: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), streams)


def keep_filter(stream: DataFrame, keep: Column) -> DataFrame:
    return stream.where(keep)


def member_partition(fanned: DataFrame, ensemble: int, parts: int) -> DataFrame:
    return fanned.withColumn("part", routing.member_partition(F.col("member"), ensemble, parts))


def id_bucket(messages: DataFrame, n: int) -> DataFrame:
    """Route by ``seq mod n``; rows of one bucket land in one shuffle partition."""
    return messages.withColumn("bucket", routing.id_bucket(F.col("seq"), n)).repartition(n, "bucket")


def replica_set(messages: DataFrame, ensemble: int, n: int) -> DataFrame:
    """Send each message to the members of replica set ``seq mod n``.

    The members are an expression of the message, so no member table is joined.
    """
    return messages.withColumn("member", F.explode(routing.replica_set_members(F.col("seq"), ensemble, n)))


def sub_ensemble_sample(messages: DataFrame, ensemble: int, size: int) -> DataFrame:
    """Send each message to one consecutive sub-ensemble of ``size`` members."""
    sets = ensemble // size
    return messages.withColumn("set_no", F.pmod(F.col("seq"), F.lit(sets)).cast("int")).withColumn(
        "member", F.explode(routing.sub_ensemble_members(F.col("seq"), ensemble, size))
    )
