"""Folders and written tables in the cluster's shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The JVM never compiles a method above this size: steps of hundreds of columns run faster
# as several smaller methods than as one generated loop that stays interpreted.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = "8000"

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a session with a local master may run without the setting; it gets one
    temporary folder for the lifetime of the application. On a cluster such a
    folder would be lost with its machine, so there the missing setting is an
    error. The setting itself belongs to the application and is never changed.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _LOCAL_ROOTS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="polyphon-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/polyphon/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    This cuts the lineage and keeps columnar scans with pruning. The files live
    in shared storage, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, COMPILED_BYTES)
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(METHOD_LIMIT, before)
    return spark.read.schema(df.schema).parquet(path)
