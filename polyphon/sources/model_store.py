"""Versioned model state as Parquet tables.

``members`` holds model rows, in one folder per block of ``BLOCK`` versions and
write; the number of files follows the rows, not the versions. Of the rows of a
version and part, those of the newest write that has any count, so a retried
write is harmless. ``published`` holds one row per published version. ``dropped``
holds deletions, which readers apply by an anti join: nothing is rewritten to
forget a model.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.errors import AnalysisException

from polyphon.operators.versions import NO_VERSION

PUBLISHED = StructType([StructField("version", LongType()), StructField("published_seq", LongType())])
DROPPED = StructType([StructField("member", LongType()), StructField("version", LongType()), StructField("up_to_write", LongType())])
BLOCK = 1024


class ModelStore:
    """State under one folder. Model rows carry ``member`` and any other columns."""

    def __init__(self, spark: SparkSession, path: str, model_schema: StructType):
        self.spark = spark
        self.path = path
        # Rows are replaced by version and part, write_no orders them and deletions.
        names = [f for f in model_schema.fields if f.name not in ("version", "part", "write_no")]
        self.schema = StructType(
            [*names, StructField("write_no", LongType()), StructField("version", LongType()), StructField("part", LongType())]
        )
        self._stored = StructType([*self.schema.fields, StructField("block", LongType()), StructField("put", StringType())])

    def _read(self, table: str, schema: StructType, folder: str = "") -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            # Nothing has been written yet.
            return self.spark.createDataFrame([], schema)

    def put(self, models: DataFrame, version: int, part: int = 0, write_no: int | None = None) -> None:
        """Write the members of one part under a version."""
        self._write(models.withColumn("version", F.lit(version)).withColumn("part", F.lit(part)), write_no, f"/block={version // BLOCK}")

    def put_table(self, models: DataFrame, write_no: int | None = None) -> None:
        """Write rows that carry their own ``version`` and ``part``."""
        self._write(models, write_no, "")

    def _write(self, models: DataFrame, write_no: int | None, folder: str) -> None:
        rows = models.withColumn("write_no", F.lit(write_no if write_no is not None else self._next_write()).cast("long"))
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        rows = rows.withColumns({"block": F.expr(f"cast(floor(version / {BLOCK}) AS BIGINT)"), "put": F.lit(self._next_put(folder))})
        rows.write.mode("append").partitionBy("block", "put").parquet(f"{self.path}/members")

    def _next_put(self, folder: str) -> str:
        """Name of the next write, behind all others of the folder in the order of text."""
        files = self._read("members", self._stored, folder).inputFiles()
        last = max((int(found[1]) for f in files if (found := re.search(r"/put=(\d+)-", f))), default=-1)
        return f"{last + 1:012d}-{uuid.uuid4().hex}"

    def _next_write(self) -> int:
        """Number of the next write: one past the newest deletion's reach."""
        row = self._read("dropped", DROPPED).agg(F.max("up_to_write").alias("m")).first()
        return 0 if row.m is None else row.m + 1

    def members(self, version: int | None = None) -> DataFrame:
        """All stored model rows, or those of one version (one block is read)."""
        if version is None:
            rows = self._read("members", self._stored)
        else:
            rows = self._read("members", self._stored, f"/block={version // BLOCK}").where(F.col("version") == version)
        newest = rows.groupBy(F.col("version").alias("_nv"), F.col("part").alias("_np")).agg(F.max("put").alias("_put"))
        same = F.col("version").eqNullSafe(F.col("_nv")) & F.col("part").eqNullSafe(F.col("_np")) & (F.col("put") == F.col("_put"))
        rows = rows.join(newest, same, "left_semi").drop("block", "put")
        dropped = self._read("dropped", DROPPED).select(
            F.col("member").alias("_m"), F.col("version").alias("_v"), F.col("up_to_write").alias("_u")
        )
        hit = (
            (F.col("member") == F.col("_m"))
            & ((F.col("_v") == NO_VERSION) | (F.col("_v") == F.col("version")))
            & (F.col("write_no") <= F.col("_u"))
        )
        return rows.join(dropped, hit, "left_anti").drop("write_no")

    def get(self, keys: DataFrame, version: int) -> DataFrame:
        """Model rows for the wanted members; nulls where a member is missing."""
        return keys.join(self.members(version), "member", "left")

    def delete(self, member: int, version: int | None = None) -> None:
        """Forget a member: all its versions, or one."""
        v = NO_VERSION if version is None else version
        one = self.spark.range(1).select(
            F.lit(member).cast("long").alias("member"), F.lit(v).cast("long").alias("version"),
            F.lit(self._next_write()).cast("long").alias("up_to_write"),
        )
        one.write.mode("append").parquet(f"{self.path}/dropped")

    def publish(self, version: int, published_seq: int | None = None) -> None:
        """Make a version current. Publishing it again changes nothing."""
        one = self.spark.range(1).select(
            F.lit(published_seq if published_seq is not None else version).cast("long").alias("published_seq"),
            F.lit(version).cast("long").alias("version"),
        )
        one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{self.path}/published")

    def published(self) -> DataFrame:
        return self._read("published", PUBLISHED)

    def current_version(self) -> int:
        """Newest published version, -1 when there is none."""
        return self.published().agg(F.coalesce(F.max("version"), F.lit(NO_VERSION))).first()[0]
