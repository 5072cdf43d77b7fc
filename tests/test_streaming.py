"""Streams: vote sets with a timer, replayed batches, equality with the batch form."""

from pyspark.sql import functions as F

from polyphon.sources import channels
from polyphon.sources.instances import FeatureSpec
from polyphon.sources.model_store import ModelStore
from polyphon.operators import naive_bayes as nb
from polyphon.plans.bagging import score_asof
from polyphon.sources.schema import flat_schema
from polyphon.sources.workspace import new_folder
from polyphon.streaming import training as tr
from polyphon.streaming.timeouts import vote_timeout, vote_timeout_stream

ROWS = "instance_id long, seq long, weight double, x double, n string, label string"
SPEC = FeatureSpec(numeric=("x",), nominal={"n": ("p", "q")}, classes=("a", "b"))


def instances(spark, n=120):
    return spark.range(n).selectExpr(
        "id AS instance_id", "id AS seq", "1D AS weight", "double(id * 7 % 13) AS x",
        "if(id % 3 = 0, 'p', 'q') AS n", "if(id % 2 = 0, 'a', 'b') AS label",
    )


def stat_set(df):
    return sorted((r.member, r.label, r.attr, str(r.value), r.w, r.wx, r.wxx) for r in df.collect())


def test_vote_sets_of_one_instance(spark):
    votes = spark.createDataFrame([(1, 0, 1), (1, 10_000, 1), (1, 29_000, 1), (1, 31_000, 1)], "instance_id long, ts_ms long, n_votes long")
    got = sorted((r.first_ms, r.n_votes, r.complete) for r in vote_timeout(votes, ensemble=4).collect())
    # The time runs from the set's first vote, not from its last one.
    assert got == [(0, 3, False), (31_000, 1, False)]


def test_timeout_is_exclusive(spark):
    votes = spark.createDataFrame([(1, 0, 1), (1, 30_000, 1), (2, 0, 1), (2, 29_999, 1)], "instance_id long, ts_ms long, n_votes long")
    got = sorted((r.instance_id, r.first_ms, r.n_votes) for r in vote_timeout(votes, ensemble=2).collect())
    assert got == [(1, 0, 1), (1, 30_000, 1), (2, 0, 2)]


def test_a_complete_set_closes_at_once(spark):
    votes = spark.createDataFrame([(1, 0, 1), (1, 5_000, 1), (1, 9_000, 1)], "instance_id long, ts_ms long, n_votes long")
    got = sorted((r.first_ms, r.n_votes, r.complete) for r in vote_timeout(votes, ensemble=2).collect())
    assert got == [(0, 2, True), (9_000, 1, False)]


def test_vote_timeout_stream_matches_batch(spark):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = []
    for i in range(40):
        base = (i + 1) * 60_000
        rows += [(i, base, 1), (i, base + 12_000 + i, 1)]
        rows.append((i, base + (25_000 if i % 2 else 40_000), 1))
    # A far later vote moves the watermark past every set.
    rows.append((999, 10_000_000, 1))
    rows.append((998, 90_000_000, 1))
    votes = spark.createDataFrame(rows, "instance_id long, ts_ms long, n_votes long").withColumn("ts", F.timestamp_millis("ts_ms"))
    folder = new_folder(spark, "votes")
    # Three arrivals in time order; some sets span two of them.
    cut1, cut2 = 14 * 60_000 + 5_000, 31 * 60_000 + 20_000
    for part in (F.col("ts_ms") < cut1, (F.col("ts_ms") >= cut1) & (F.col("ts_ms") < cut2), F.col("ts_ms") >= cut2):
        channels.publish_instances(votes.where(part).select("instance_id", "ts", "n_votes", "ts_ms"), folder, files=1, order="ts_ms")
    stream = channels.read_channel(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1).drop("ts_ms")
    out, ckpt = new_folder(spark, "sets"), new_folder(spark, "sets-ckpt")
    q = (
        vote_timeout_stream(stream, ensemble=3).writeStream.foreachBatch(lambda b, i: channels.write_predictions(b, i, out))
        .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    key = lambda r: (r.instance_id, r.first_ms, r.n_votes, r.complete)
    got = {key(r) for r in spark.read.parquet(out).collect() if r.instance_id < 900}
    want = {key(r) for r in vote_timeout(votes.select("instance_id", "ts_ms", "n_votes"), 3).collect() if r.instance_id < 900}
    assert got == want


def test_replayed_batch_counts_once(spark):
    store = ModelStore(spark, new_folder(spark, "store"), tr.STAT_SCHEMA)
    delta = tr.bag_delta(instances(spark), SPEC, 3, seed=5)
    assert store.current_version() == -1
    assert tr.apply_batch(store, delta, 0)
    once = stat_set(store.members(0))
    assert not tr.apply_batch(store, delta, 0)
    assert stat_set(store.members(store.current_version())) == once


def test_crash_between_write_and_publish(spark):
    store = ModelStore(spark, new_folder(spark, "store"), tr.STAT_SCHEMA)
    delta = tr.bag_delta(instances(spark), SPEC, 3, seed=5)
    tr.apply_batch(store, delta, 0)
    # The first try of batch 1 wrote its version and died before publishing it.
    store.put(delta, version=1)
    assert store.current_version() == 0
    assert tr.apply_batch(store, delta, 1)
    doubled = sorted((m, l, a, v, 2 * w) for m, l, a, v, w, _, _ in stat_set(delta))
    assert sorted(t[:5] for t in stat_set(store.members(1))) == doubled


def test_stream_equals_batch(spark):
    inst = instances(spark)
    folder = new_folder(spark, "channel")
    channels.publish_instances(inst, folder, files=4)
    store = ModelStore(spark, new_folder(spark, "store"), tr.STAT_SCHEMA)
    stream = channels.read_channel(spark, folder, flat_schema(ROWS), files_per_trigger=1)
    tr.bag_train_stream(stream, store, SPEC, 3, new_folder(spark, "ckpt"), seed=5).awaitTermination()
    assert store.current_version() >= 3
    assert stat_set(store.members(store.current_version())) == stat_set(tr.bag_delta(inst, SPEC, 3, seed=5))


def test_store_get_delete_and_put_again(spark):
    store = ModelStore(spark, new_folder(spark, "store"), flat_schema("member int, trained_n long"))
    rows = spark.createDataFrame([(0, 5), (1, 6)], "member int, trained_n long")
    store.put(rows, version=1)
    store.put(rows, version=2)
    keys = spark.createDataFrame([(0,), (1,), (2,)], "member int")
    assert {(r.member, r.trained_n) for r in store.get(keys, 2).collect()} == {(0, 5), (1, 6), (2, None)}
    store.delete(1, version=2)
    assert {(r.member, r.version) for r in store.members().collect()} == {(0, 1), (1, 1), (0, 2)}
    store.delete(0)
    assert {(r.member, r.version) for r in store.members().collect()} == {(1, 1)}
    store.put(rows, version=2)
    assert {(r.member, r.version) for r in store.members(2).collect()} == {(0, 2), (1, 2)}


def test_scoring_takes_the_version_in_force(spark):
    rows = instances(spark, 60)
    # Version 0 has members 0 and 1, version 1 only member 0.
    trained = rows.selectExpr("*", "explode(array(named_struct('version', 0L, 'member', 0), named_struct('version', 0L, 'member', 1), named_struct('version', 1L, 'member', 0))) AS m").select("*", "m.*")
    stats = nb.nb_train(trained, SPEC, weight="weight", keys=("version", "member"))
    published = spark.createDataFrame([(0, 11), (1, 40)], "version long, published_seq long")
    got = score_asof(rows.select("instance_id", "seq", "x", "n"), published, stats, SPEC, ensemble=2, versions=2, pending=10)
    found = sorted((r.instance_id, r.version, r.member) for r in got.collect())
    # Published at 11, adopted at the poll of 20; at 40 it is adopted at once, and member 1 falls silent.
    assert found == [(i, 0, m) for i in range(20, 40) for m in (0, 1)] + [(i, 1, 0) for i in range(40, 60)]
    one = nb.member_votes(rows.withColumn("member", F.lit(0)), nb.nb_model(nb.single_train(rows, SPEC), SPEC), SPEC, 1)
    want = {r.instance_id: (round(r.v_0, 9), round(r.v_1, 9)) for r in one.collect()}
    assert all((round(r.v_0, 9), round(r.v_1, 9)) == want[r.instance_id] for r in got.collect())
