"""Files of the model store, and which write counts."""

import glob

from pyspark.sql import functions as F

from polyphon.sources.model_store import ModelStore
from polyphon.sources.schema import flat_schema
from polyphon.sources.workspace import new_folder

COUNTERS = flat_schema("member int, trained_n long")


def snapshots(spark, n, trained):
    return spark.range(n).select(
        (F.col("id") % 2).cast("int").alias("member"), F.lit(trained).cast("long").alias("trained_n"),
        F.expr("id div 2").alias("version"), (F.col("id") % 2).alias("part"),
    )


def test_files_follow_rows_not_versions(spark):
    store = ModelStore(spark, new_folder(spark, "many"), COUNTERS)
    store.put_table(snapshots(spark, 4_000, 1).coalesce(1))
    # 2,000 versions of two parts in two blocks, by one task.
    assert len(glob.glob(f"{store.path}/members/**/*.parquet", recursive=True)) == 2
    assert store.members().count() == 4_000
    assert [r.trained_n for r in store.members(1_500).collect()] == [1, 1]


def test_newest_write_of_a_version_and_part_counts(spark):
    store = ModelStore(spark, new_folder(spark, "again"), COUNTERS)
    store.put_table(snapshots(spark, 8, 1).unionByName(snapshots(spark, 1, 5).withColumn("version", F.lit(None).cast("long"))))
    store.put_table(snapshots(spark, 4, 2))
    store.put(snapshots(spark, 1, 3).select("member", "trained_n"), version=3, part=1)
    store.put_table(snapshots(spark, 1, 6).withColumn("version", F.lit(None).cast("long")))
    got = sorted((r.version if r.version is not None else -1, r.part, r.member, r.trained_n) for r in store.members().collect())
    assert got == [(-1, 0, 0, 6), (0, 0, 0, 2), (0, 1, 1, 2), (1, 0, 0, 2), (1, 1, 1, 2), (2, 0, 0, 1), (2, 1, 1, 1), (3, 0, 0, 1), (3, 1, 0, 3)]
    store.delete(0)
    assert sorted(r.version for r in store.members().collect()) == [0, 1, 2]
