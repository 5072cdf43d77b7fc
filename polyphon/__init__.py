"""Online-ensemble analytics written as Spark DataFrame and streaming jobs."""
