"""Queries of sources, sinks, fan-out and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from polyphon.functions import payload as pl
from polyphon.operators import lookup, naive_bayes as nb, streams as st
from polyphon.functions.weights import with_poisson_weight
from polyphon.plans import sqltext as q
from polyphon.plans.bagging import bag_predict
from polyphon.plans.common import (
    ENSEMBLE, SEED, events, events_spec, stream_cut, test_rows, train_rows, trained,
)
from polyphon.plans.registry import query
from polyphon.sources import channels
from polyphon.sources.instances import orders_instances, read_table
from polyphon.sources.schema import flat_schema
from polyphon.sources.workspace import materialize, new_folder
from polyphon.streaming.ingest import run_to_table, two_stream_ingest

COLS = ["instance_id", "seq", "weight", "x_cents", "x_k", "n_user", "label"]
CHANNEL = flat_schema("instance_id long, seq long, weight double, x_cents double, x_k double, n_user string, label string")
STREAM_FILES = 4


def _channel(spark: SparkSession, rows: DataFrame, name: str) -> str:
    folder = new_folder(spark, name)
    channels.publish_instances(rows.select(*COLS), folder, files=STREAM_FILES)
    return folder


@query(
    "instance_batches",
    q.with_(q.INST) + "SELECT seq, seq // 100 AS batch_no, CAST(seq % 100 AS INTEGER) AS pos, label FROM inst",
)
def instance_batches(spark, sf_dir):
    return st.instance_batches(events(spark, sf_dir)).select("seq", "batch_no", "pos", "label")


@query(
    "bounded_passes",
    q.with_(q.INST) + f"""SELECT CAST(p.pass AS INTEGER) AS pass, i.seq, i.label, i.x_cents
    FROM inst i, (SELECT unnest(range(0, 2)) AS pass) p WHERE i.seq < {q.cut(0.5)}""",
)
def bounded_passes(spark, sf_dir):
    # The bound is half of the stream, so it grows with the table.
    inst = events(spark, sf_dir)
    return st.bounded_passes(inst, stream_cut(spark, sf_dir, 0.5), passes=2).select("pass", "seq", "label", "x_cents")


@query(
    "two_stream_ingest",
    q.with_(q.INST) + f"SELECT CASE WHEN seq < {q.cut()} THEN 'learn' ELSE 'predict' END AS role, seq, label, x_cents FROM inst",
)
def two_stream(spark, sf_dir):
    inst = events(spark, sf_dir)
    learn = _channel(spark, train_rows(spark, sf_dir), "learn-channel")
    predict = _channel(spark, test_rows(spark, sf_dir), "predict-channel")
    stream = two_stream_ingest(spark, learn, predict, CHANNEL, files_per_trigger=2)
    out = run_to_table(stream, new_folder(spark, "ingested"), new_folder(spark, "ingest-ckpt"))
    return out.select("role", "seq", "label", "x_cents")


PAYLOAD = flat_schema("instance_id long, weight double, x_cents double, label string")


@query(
    "encode_payload",
    q.with_(q.INST) + """SELECT instance_id, base64(encode('{"instance_id":' || instance_id || ',"weight":' || CAST(weight AS VARCHAR)
      || ',"x_cents":' || CAST(x_cents AS VARCHAR) || ',"label":"' || label || '"}')) AS payload FROM inst""",
)
def encode_payload(spark, sf_dir):
    return events(spark, sf_dir).select("instance_id", pl.encode_payload("instance_id", "weight", "x_cents", "label").alias("payload"))


@query(
    "decode_payload",
    q.with_(q.INST) + """SELECT instance_id AS message, CASE user_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'bytes' ELSE 'instance' END AS kind,
      x_k >= 90 AND user_id % 3 <> 2 AS broken,
      CASE WHEN x_k >= 90 AND user_id % 3 <> 2 THEN NULL ELSE instance_id END AS instance_id,
      CASE WHEN x_k >= 90 AND user_id % 3 <> 2 THEN NULL ELSE x_cents END AS x_cents,
      CASE WHEN x_k >= 90 AND user_id % 3 <> 2 THEN NULL ELSE label END AS label FROM inst""",
)
def decode_payload(spark, sf_dir):
    """Messages of all three kinds; about a tenth of the encoded ones are cut short."""
    inst = events(spark, sf_dir)
    kind = F.element_at(F.array(F.lit("text"), F.lit("bytes"), F.lit("instance")), F.pmod("user_id", F.lit(3)).cast("int") + 1)
    body = F.struct("instance_id", "weight", "x_cents", "label")
    text = pl.encode_payload("instance_id", "weight", "x_cents", "label")
    cut_short = F.col("x_k") >= 90
    messages = inst.select(
        F.col("instance_id").alias("message"),
        kind.alias("kind"),
        cut_short.alias("cut"),
        F.when(cut_short, F.concat(F.lit("!"), text)).otherwise(text).alias("text"),
        F.when(cut_short, F.lit("{").cast("binary")).otherwise(F.to_json(body).cast("binary")).alias("raw"),
        body.alias("instance"),
    )
    out = messages.withColumn(
        "d", pl.decode_payload(F.col("kind"), F.col("text"), F.col("raw"), F.col("instance"), PAYLOAD)
    )
    return out.select("message", "kind", F.col("d").isNull().alias("broken"), "d.instance_id", "d.x_cents", "d.label")


@query("publish_instances", q.with_(q.INST) + "SELECT instance_id, seq, weight, x_cents, x_k, n_user, label FROM inst")
def publish_instances(spark, sf_dir):
    source = new_folder(spark, "publish-source")
    channels.publish_instances(events(spark, sf_dir).select(*COLS), source, files=STREAM_FILES)
    stream = channels.read_channel(spark, source, CHANNEL, files_per_trigger=2)
    target = new_folder(spark, "published")
    channels.publish_stream(stream, target, new_folder(spark, "publish-ckpt")).awaitTermination()
    return spark.read.schema(CHANNEL).parquet(target)


BAG_PRED = (
    q.INST,
    f"tr AS (SELECT * FROM inst WHERE seq < {q.cut()})",
    q.bag("tr", ENSEMBLE, SEED),
    q.nb_stats("bag"),
    f"te AS (SELECT * FROM inst WHERE seq >= {q.cut()})",
    q.nb_votes("te"),
    q.normalize("votes", "nv", "instance_id, member"),
    "flat AS MATERIALIZED (SELECT instance_id, label, sum(vote) / sum(sum(vote)) OVER (PARTITION BY instance_id) AS vote FROM nv GROUP BY instance_id, label)",
    q.argmax("flat", "best"),
    "pr AS MATERIALIZED (SELECT b.instance_id, b.pred, i.label AS truth, i.weight FROM best b JOIN inst i USING (instance_id))",
)


@query("prediction_sink", q.with_(*BAG_PRED) + "SELECT instance_id, pred, truth FROM pr")
def prediction_sink(spark, sf_dir):
    """A stream of instances scored by the static ensemble, into the batch-partitioned table."""
    inst = events(spark, sf_dir)
    spec = events_spec(spark, sf_dir)
    stats = materialize(trained(spark, sf_dir), "sink-model")
    channel = _channel(spark, test_rows(spark, sf_dir), "score-channel")
    stream = channels.read_channel(spark, channel, CHANNEL, files_per_trigger=2)
    folder = new_folder(spark, "predictions")

    def step(batch: DataFrame, batch_id: int) -> None:
        channels.write_predictions(bag_predict(batch, stats, spec, ENSEMBLE), batch_id, folder)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", new_folder(spark, "sink-ckpt")).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(folder).select("instance_id", "pred", "truth")


@query(
    "prediction_file",
    q.with_(*BAG_PRED, "cls AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT DISTINCT label FROM inst))")
    + "SELECT CAST(p.i AS VARCHAR) || ',' || CAST(t.i AS VARCHAR) AS line FROM pr JOIN cls p ON p.label = pr.pred JOIN cls t ON t.label = pr.truth",
)
def prediction_file(spark, sf_dir):
    inst = events(spark, sf_dir)
    spec = events_spec(spark, sf_dir)
    scored = bag_predict(test_rows(spark, sf_dir), trained(spark, sf_dir), spec, ENSEMBLE)
    folder = new_folder(spark, "prediction-lines")
    channels.prediction_file(scored, spec.class_index(F.col("pred")), spec.class_index(F.col("truth")), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query(
    "message_id",
    "SELECT event_type AS source, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS msg_seq FROM events",
)
def message_id(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "event_id")
    return st.message_id(ev, "source", "event_id").select("source", "event_id", "msg_seq")


@query("ensemble_fanout", q.with_(q.INST) + f"SELECT m.member, i.seq, i.x_cents FROM inst i, {q.members(ENSEMBLE)} m")
def ensemble_fanout(spark, sf_dir):
    return st.ensemble_fanout(events(spark, sf_dir), ENSEMBLE).select("member", "seq", "x_cents")


@query(
    "stream_merge",
    """SELECT 'events' AS stream, event_id AS instance_id, event_type AS label, round(value * 100) AS x_cents FROM events
    UNION ALL SELECT 'orders', o_orderkey, o_orderpriority, round(o_totalprice * 100) FROM orders""",
)
def stream_merge(spark, sf_dir):
    a = events(spark, sf_dir).select(F.lit("events").alias("stream"), "instance_id", "label", "x_cents")
    b = orders_instances(read_table(spark, sf_dir, "orders")).select(F.lit("orders").alias("stream"), "instance_id", "label", "x_cents")
    return st.stream_merge(a, b)


PART_SQL = "CAST(CASE WHEN {e} // {t} = 0 THEN {t} - 1 ELSE least(member // ({e} // {t}), {t} - 1) END AS INTEGER)"


@query(
    "member_partition",
    q.with_(q.INST) + f"SELECT i.seq, m.member, {PART_SQL.format(e=7, t=3)} AS part FROM inst i, {q.members(7)} m",
)
def member_partition(spark, sf_dir):
    fanned = st.ensemble_fanout(events(spark, sf_dir).select("seq"), 7)
    return st.member_partition(fanned, 7, 3).select("seq", "member", "part")


@query("id_bucket", "SELECT event_id AS seq, CAST(event_id % 8 AS INTEGER) AS bucket, event_type AS label FROM events")
def id_bucket(spark, sf_dir):
    return st.id_bucket(events(spark, sf_dir).select("seq", "label"), 8).select("seq", "bucket", "label")


@query("replica_set", q.with_(q.INST) + f"SELECT i.seq, m.member FROM inst i, {q.members(7)} m WHERE i.seq % 3 = m.member % 3")
def replica_set(spark, sf_dir):
    return st.replica_set(events(spark, sf_dir).select("seq"), 7, 3).select("seq", "member")


@query(
    "sub_ensemble_sample",
    q.with_(q.INST) + f"SELECT i.seq, CAST(i.seq % 2 AS INTEGER) AS set_no, m.member FROM inst i, {q.members(7)} m WHERE m.member < 6 AND m.member // 3 = i.seq % 2",
)
def sub_ensemble_sample(spark, sf_dir):
    return st.sub_ensemble_sample(events(spark, sf_dir).select("seq"), 7, 3).select("seq", "set_no", "member")


@query("keep_filter", "SELECT event_id, event_type, value FROM events WHERE value > 100 AND event_type <> 'error'")
def keep_filter(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    keep = (F.col("value") > 100) & (F.col("event_type") != "error")
    return st.keep_filter(ev, keep).select("event_id", "event_type", "value")


@query(
    "state_query_join",
    q.with_(q.INST, f"tr AS (SELECT * FROM inst WHERE seq < {q.cut()})", q.bag("tr", ENSEMBLE - 1, SEED))
    + f"""SELECT m.member, i.instance_id, c.trained_n FROM inst i CROSS JOIN {q.members(ENSEMBLE)} m
    JOIN (SELECT member, count(*) AS trained_n FROM bag GROUP BY member) c ON c.member = m.member""",
)
def state_query_join(spark, sf_dir):
    """Every member is asked; the last one has no state and emits nothing."""
    inst = events(spark, sf_dir)
    fanned = st.ensemble_fanout(train_rows(spark, sf_dir).select("instance_id", "weight"), ENSEMBLE - 1)
    state = nb.trained_count(with_poisson_weight(fanned, seed=SEED))
    asked = st.ensemble_fanout(inst.select("instance_id"), ENSEMBLE)
    return lookup.state_query_join(asked, state, max_bytes=ENSEMBLE * 32).select("member", "instance_id", "trained_n")


@query(
    "static_lookup",
    """SELECT c.c_custkey, c.c_nationkey, n.n_name FROM customer c
    LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 0) n ON n.n_nationkey = c.c_nationkey""",
)
def static_lookup(spark, sf_dir):
    """Nations of one region are not in the map: their customers get null."""
    table = read_table(spark, sf_dir, "nation").where(F.col("n_regionkey") != 0).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return lookup.static_lookup(rows, table, "c_nationkey").select("c_custkey", "c_nationkey", "n_name")


@query(
    "version_asof",
    q.with_(
        q.INST,
        "vers AS (SELECT seq AS version, seq + 3 AS published_seq FROM inst WHERE x_k = 7)",
        "polls AS (SELECT p.poll, max(v.version) AS version FROM (SELECT DISTINCT (seq // 100) * 100 AS poll FROM inst) p JOIN vers v ON v.published_seq <= p.poll GROUP BY p.poll)",
    )
    + "SELECT i.seq, p.version FROM inst i JOIN polls p ON p.poll = (i.seq // 100) * 100",
)
def version_asof(spark, sf_dir):
    """Publications follow the data: each row with k = 7 publishes a version 3 rows later."""
    inst = events(spark, sf_dir)
    versions = inst.where(F.col("x_k") == 7).select(F.col("seq").alias("version"), (F.col("seq") + 3).alias("published_seq"))
    return lookup.version_asof(inst.select("seq"), versions, pending=100).select("seq", "version")
