"""Throughput of a running stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from polyphon.sources.channels import write_predictions


def tumbling_counts(stream: DataFrame, counter: str, period: str, folder: str, checkpoint: str, delay: str = "10 minutes") -> DataFrame:
    """Events per counter and period, as ``counter, window_start, n_events``.

    The watermark lets Spark forget old periods. Each batch writes the counts it
    changed; the latest count of a period is its largest, since counts only grow.
    """
    counts = (
        stream.withWatermark("ts", delay)
        .groupBy(counter, F.window("ts", period).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(counter, F.col("w.start").alias("window_start"), "n_events")
    )
    q = (
        counts.writeStream.outputMode("update").foreachBatch(lambda b, i: write_predictions(b, i, folder))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    written = stream.sparkSession.read.parquet(folder)
    return written.groupBy(counter, "window_start").agg(F.max("n_events").alias("n_events"))
