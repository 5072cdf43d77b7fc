"""Throughput of a stream that comes out of order, with the rows that come too late.

Spark's own windowed count forgets a period once the watermark has passed its end,
and rows for it vanish. Here every batch writes what it counted and what was too
late side by side, so counted and late rows together are all rows. Nothing is kept
in memory between batches: a batch's watermark is the largest time of the batches
before it, less the delay, and comes from one small row that each of them wrote.

A replayed batch replaces its own partitions and has the same watermark again, so it
counts once. Edge cases: the first batch has no late rows; rows without a time fall
into no period and are late; an empty batch leaves the watermark as it is.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from polyphon.sources.channels import write_predictions
from polyphon.sources.schema import flat_schema

COUNTS = "window_start_ms long, n_events long, n_late long, batch_id long"
SEEN = flat_schema("top_ms long, batch_id long")


def count_with_late(stream: DataFrame, counter: str, period_ms: int, folder: str, checkpoint: str, delay_ms: int = 600_000) -> DataFrame:
    """Per ``counter`` and period: ``window_start_ms``, ``n_events`` in time and ``n_late``.

    ``stream`` has ``ts_ms``. A row is late when its period had ended by the watermark
    at the start of its batch. Each batch adds one row per counter and period it met.
    """
    schema = flat_schema(f"{counter} string, {COUNTS}")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        start = F.expr(f"ts_ms - pmod(ts_ms, {period_ms}L)")
        before = _seen(spark, folder).where(F.col("batch_id") < batch_id).agg((F.max("top_ms") - F.lit(delay_ms)).alias("w"))
        late = F.coalesce(F.col("window_start_ms") + F.lit(period_ms) <= before.scalar(), F.col("window_start_ms").isNull())
        rows = batch.select(counter, start.alias("window_start_ms")).withColumn("_late", late)
        counts = rows.groupBy(counter, "window_start_ms").agg(
            F.count_if(~F.col("_late")).alias("n_events"), F.count_if(F.col("_late")).alias("n_late")
        )
        write_predictions(counts, batch_id, f"{folder}/counts")
        write_predictions(batch.agg(F.max("ts_ms").alias("top_ms")), batch_id, f"{folder}/seen")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    written = stream.sparkSession.read.schema(schema).parquet(f"{folder}/counts")
    return written.groupBy(counter, "window_start_ms").agg(F.sum("n_events").alias("n_events"), F.sum("n_late").alias("n_late"))


def _seen(spark: SparkSession, folder: str) -> DataFrame:
    """The largest time of each batch so far; the first batch finds none."""
    try:
        return spark.read.schema(SEEN).parquet(f"{folder}/seen")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SEEN)
