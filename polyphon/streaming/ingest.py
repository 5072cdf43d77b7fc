"""The learning and the prediction stream of one ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from polyphon.sources.channels import read_channel


def two_stream_ingest(spark: SparkSession, learn: str, predict: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Both channels as one stream, with the column ``role``."""
    a = read_channel(spark, learn, schema, files_per_trigger).withColumn("role", F.lit("learn"))
    b = read_channel(spark, predict, schema, files_per_trigger).withColumn("role", F.lit("predict"))
    return a.unionByName(b)


def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and read back what it wrote."""
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", folder)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
