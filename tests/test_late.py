"""Counts of an out-of-order stream: what was lost is exactly what is reported."""

from pyspark.sql import functions as F

from polyphon.sources import channels
from polyphon.sources.schema import flat_schema
from polyphon.sources.workspace import new_folder
from polyphon.streaming.late import count_with_late

HOUR, DELAY = 3_600_000, 600_000
SCHEMA = flat_schema("counter string, ts_ms long, arrival int")


def test_late_rows_are_counted_as_late(spark):
    minute = 60_000
    arrivals = [
        [("a", 5 * minute), ("b", 50 * minute), ("a", 61 * minute)],
        # 61 - 10 minutes: the first hour is still open.
        [("a", 6 * minute), ("a", 70 * minute), ("b", None)],
        # 70 - 10 minutes: it has just ended.
        [("a", 7 * minute), ("b", 8 * minute), ("b", 65 * minute)],
    ]
    folder = new_folder(spark, "late-channel")
    for n, rows in enumerate(arrivals):
        channels.publish_instances(spark.createDataFrame([(c, t, n) for c, t in rows], SCHEMA).coalesce(1), folder)
    stream = channels.read_channel(spark, folder, SCHEMA, files_per_trigger=1)
    out, checkpoint = new_folder(spark, "late"), new_folder(spark, "late-ckpt")
    got = count_with_late(stream, "counter", HOUR, out, checkpoint, DELAY)
    want = {("a", 0): (2, 1), ("b", 0): (1, 1), ("a", HOUR): (2, 0), ("b", HOUR): (1, 0), ("b", None): (0, 1)}
    assert {(r.counter, r.window_start_ms): (r.n_events, r.n_late) for r in got.collect()} == want
    # A restart with nothing new, and a later arrival, go on from what is written.
    channels.publish_instances(spark.createDataFrame([("a", 9 * minute, 3)], SCHEMA).coalesce(1), folder)
    again = count_with_late(stream, "counter", HOUR, out, checkpoint, DELAY)
    want[("a", 0)] = (2, 2)
    assert {(r.counter, r.window_start_ms): (r.n_events, r.n_late) for r in again.collect()} == want
    assert again.agg(F.sum(F.col("n_events") + F.col("n_late"))).first()[0] == 10
