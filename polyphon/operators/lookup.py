"""State look-ups: a model or a value fetched by key for each message."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from polyphon.operators.prefix import BUCKET_ROWS, Running, running

# A side is broadcast only when a bound known before the job starts is below this.
BROADCAST_BYTES = 64 << 20
# Copies of an unbroadcast model, so that one member's rows spread over many tasks.
SALTS = 64


def model_join(rows: DataFrame, model: DataFrame, keys: list[str], max_bytes: int, spread_by: str, how: str = "inner") -> DataFrame:
    """Join rows with a model table of few keys and a known largest size.

    A small model is broadcast. A larger one is copied ``SALTS`` times under a
    salt and joined by shuffle: a plain shuffle join would put all rows of a
    member, that is 1/E of everything, into one task.
    """
    if max_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(model), keys, how)
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = model.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted_rows.join(copies, [*keys, "_salt"], how).drop("_salt")


def state_query_join(messages: DataFrame, model: DataFrame, max_bytes: int) -> DataFrame:
    """Fetch each member's model; a member without one emits nothing."""
    return model_join(messages, model, ["member"], max_bytes, "instance_id")


def static_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a key-value table; the value is null when the key is absent.

    The table's statistics decide between broadcast and shuffle, and adaptive
    execution splits hot keys of a shuffle.
    """
    return rows.join(table, key, "left")


def version_asof(messages: DataFrame, versions: DataFrame, pending: int = 100, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Version in force for each message.

    Every ``pending`` messages the largest version published so far is polled and
    adopted, as ``version_pointer`` names it; a message before the first adoption
    is dropped. ``versions`` has ``version, published_seq``.

    A version takes effect at the first poll at or after its publication, so it
    is placed in the stream just before that poll's first message, and carried
    forward from there.
    """
    cols = messages.columns
    effective = (
        versions.withColumn("seq", F.expr(f"(published_seq + {pending - 1}) div {pending}L * {pending}L"))
        .groupBy("seq")
        .agg(F.max("version").alias("_adopted_here"))
        .withColumn("_kind", F.lit(0))
    )
    tagged = messages.withColumn("_kind", F.lit(1))
    both = tagged.unionByName(effective, allowMissingColumns=True)
    carried = running(
        both, "seq", [Running("version", "_adopted_here", how="max")], bucket_rows=bucket_rows, tie=["_kind"]
    )
    return (
        carried.where((F.col("_kind") == 1) & F.col("version").isNotNull())
        .select(*cols, "version")
    )
