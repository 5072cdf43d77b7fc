"""Instance channels and prediction sinks over files.

A channel is a folder that one job appends instances to and streams read from.
In production a message queue can stand in for it; the streams take any source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def publish_instances(instances: DataFrame, folder: str, files: int | None = None, order: str = "seq") -> None:
    """Append instances to a channel.

    With ``files`` the batch is cut into that many files of consecutive stream
    numbers. A reader takes files in the order they were finished, so only
    separate calls fix an order.
    """
    out = instances.repartitionByRange(files, order).sortWithinPartitions(order) if files else instances
    out.write.mode("append").parquet(folder)


def publish_stream(instances: DataFrame, folder: str, checkpoint: str):
    """Streaming form: each input row goes to the channel once."""
    return (
        instances.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_channel(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def write_predictions(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Write one batch of predictions; a replayed batch replaces itself."""
    batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(folder)


def prediction_sink(predictions: DataFrame, folder: str, checkpoint: str):
    """Stream of predictions into a table partitioned by batch."""
    return (
        predictions.writeStream.foreachBatch(lambda b, i: write_predictions(b, i, folder))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def prediction_file(scored: DataFrame, pred: Column, truth: Column, folder: str) -> None:
    """Append ``predicted,true`` lines."""
    scored.select(F.concat_ws(",", pred.cast("string"), truth.cast("string")).alias("value")).write.mode("append").text(folder)
