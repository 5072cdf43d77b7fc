"""Vote sets of a stream whose instances share buckets of state."""

from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from polyphon.sources import channels
from polyphon.sources.workspace import new_folder
from polyphon.streaming.timeouts import vote_sets, vote_timeout, vote_timeout_stream

VOTE = "instance_id long, ts_ms long, n_votes long"


class Held(SimpleNamespace):
    """A bucket's state as Spark gives it to the step."""

    exists, hasTimedOut, get, timer, watermark = False, False, None, None, 0

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutTimestamp(self, at):
        self.timer = at

    def getCurrentWatermarkMs(self):
        return self.watermark


def test_one_call_takes_a_whole_bucket():
    step, state = vote_sets(3, 30_000), Held()
    first = pd.DataFrame({"no_id": [False, True, False], "id": [2**60 + 1, 0, 5], "ts_ms": [10, 20, 30], "n_votes": [1, 1, 3]})
    out = pd.concat(step((0,), iter([first]), state))
    assert out.values.tolist() == [[5, 30, 3, True]]
    assert state.get == ([2**60 + 1, None], [10, 20], [1, 1]) and state.timer == 30_010
    # The time of one of its sets is up: the other stays, and the bucket's timer moves on.
    state.hasTimedOut, state.watermark = True, 30_015
    assert pd.concat(step((0,), iter([]), state)).values.tolist() == [[2**60 + 1, 10, 1, False]]
    assert state.get == ([None], [20], [1]) and state.timer == 30_020


def test_buckets_of_state_match_batch(spark):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = []
    for i in range(30):
        own = None if i == 7 else i + 2**60
        base = (i + 1) * 60_000
        rows += [(own, base, 1), (own, base + 12_000 + i, 1), (own, base + (25_000 if i % 2 else 40_000), 1)]
    rows += [(999, 10_000_000, 1), (998, 90_000_000, 1)]
    votes = spark.createDataFrame(rows, VOTE).withColumn("ts", F.timestamp_millis("ts_ms"))
    folder, out = new_folder(spark, "votes"), new_folder(spark, "sets")
    for part in (F.col("ts_ms") < 845_000, F.col("ts_ms") >= 845_000):
        channels.publish_instances(votes.where(part), folder, files=1, order="ts_ms")
    stream = channels.read_channel(spark, folder, votes.schema, files_per_trigger=1).drop("ts_ms")
    sets = vote_timeout_stream(stream, ensemble=3, buckets=2)
    sets.writeStream.foreachBatch(lambda b, i: channels.write_predictions(b, i, out)).option(
        "checkpointLocation", new_folder(spark, "sets-ckpt")
    ).trigger(availableNow=True).start().awaitTermination()

    def found(df):
        few = F.col("instance_id").isNull() | ~F.col("instance_id").isin(998, 999)
        return sorted(str((r.instance_id, r.first_ms, r.n_votes, r.complete)) for r in df.where(few).collect())

    assert found(spark.read.parquet(out)) == found(vote_timeout(votes.select("instance_id", "ts_ms", "n_votes"), 3))
