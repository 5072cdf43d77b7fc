"""Queries of versioned model state."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyphon.functions import payload as pl
from polyphon.functions.weights import with_poisson_weight
from polyphon.operators import naive_bayes as nb
from polyphon.operators import versions as vs
from polyphon.operators import votes as vt
from polyphon.operators.prefix import Running, running
from polyphon.operators.streams import ensemble_fanout, member_partition
from polyphon.plans import sqltext as q
from polyphon.plans.bagging import score_asof as score_asof_op
from polyphon.plans.common import ENSEMBLE, PARTS, SEED, events, events_spec, stream_cut
from polyphon.plans.registry import query
from polyphon.plans.stream_queries import CHANNEL, COLS, PART_SQL
from polyphon.plans.training_queries import ALL_BAG, stat_rows
from polyphon.functions.routing import partition_sizes
from polyphon.sources import channels
from polyphon.sources.instances import read_table
from polyphon.sources.model_store import ModelStore
from polyphon.sources.schema import flat_schema
from polyphon.sources.workspace import new_folder
from polyphon.streaming import training as tr

# A snapshot of an ensemble's counters every STEP instances.
STEP = 1000
PART = PART_SQL.format(e=ENSEMBLE, t=PARTS)
COUNTERS = flat_schema("member int, trained_n long")

# Snapshots taken from the stream: the counters of each member over each run of
# STEP instances are version seq // STEP.
SNAP = (
    *ALL_BAG,
    f"snap AS MATERIALIZED (SELECT seq // {STEP} AS version, member, {PART} AS part, count(*) AS trained_n FROM bag GROUP BY ALL)",
)


def _snapshots(spark, sf_dir):
    fanned = ensemble_fanout(events(spark, sf_dir).select("instance_id", "seq", "weight"), ENSEMBLE)
    rows = member_partition(with_poisson_weight(fanned, seed=SEED), ENSEMBLE, PARTS)
    return rows.groupBy(F.expr(f"seq div {STEP}").alias("version"), "member", "part").agg(F.count(F.lit(1)).alias("trained_n"))


def _store(spark, sf_dir, name):
    store = ModelStore(spark, new_folder(spark, name), COUNTERS)
    store.put_table(_snapshots(spark, sf_dir))
    return store


@query("model_put", q.with_(*SNAP) + "SELECT version, CAST(part AS BIGINT) AS part, member, trained_n FROM snap")
def model_put(spark, sf_dir):
    """Everything written is there, and writing it again changes nothing."""
    store = _store(spark, sf_dir, "put-store")
    store.put_table(_snapshots(spark, sf_dir))
    return store.members().select("version", "part", "member", "trained_n")


@query(
    "model_get",
    q.with_(*SNAP) + f"""SELECT m.member, s.trained_n FROM {q.members(ENSEMBLE + 1)} m
    LEFT JOIN snap s ON s.member = m.member AND s.version = (SELECT max(version) FROM snap)""",
)
def model_get(spark, sf_dir):
    """The newest version of six members, one of which has never been stored."""
    store = _store(spark, sf_dir, "get-store")
    newest = store.members().agg(F.max("version")).first()[0]
    keys = spark.range(ENSEMBLE + 1).select(F.col("id").cast("int").alias("member"))
    return store.get(keys, newest).select("member", "trained_n")


PUBLISHED = (
    *SNAP,
    # A part reports a version unless one of its members trained below the mean.
    "reports AS MATERIALIZED (SELECT version, part, version * 1000 + part * 10 AS seq FROM snap GROUP BY version, part HAVING min(trained_n) >= 600)",
    f"pub AS MATERIALIZED (SELECT version, max(seq) AS published_seq FROM reports GROUP BY version HAVING count(DISTINCT part) = {PARTS})",
)


def _reports(spark, sf_dir):
    per_part = _snapshots(spark, sf_dir).groupBy("version", "part").agg(F.min("trained_n").alias("least"))
    return per_part.where(F.col("least") >= 600).select("version", "part", (F.col("version") * 1000 + F.col("part") * 10).alias("seq"))


@query("publish_barrier", q.with_(*PUBLISHED) + "SELECT version, published_seq FROM pub")
def publish_barrier(spark, sf_dir):
    return vs.publish_barrier(_reports(spark, sf_dir), PARTS)


@query("version_pointer", q.with_(*PUBLISHED) + "SELECT coalesce(max(version), -1) AS version FROM pub")
def version_pointer(spark, sf_dir):
    return vs.version_pointer(vs.publish_barrier(_reports(spark, sf_dir), PARTS))


# Version v is trained on the v-th run of STEP instances and published right after it.
ASOF = (
    *ALL_BAG,
    f"vbag AS MATERIALIZED (SELECT * REPLACE (CAST(seq // {STEP} * 100 + member AS INTEGER) AS member) FROM bag)",
    q.nb_stats("vbag"),
    q.nb_votes("inst"),
    f"""force AS MATERIALIZED (SELECT i.instance_id, max(v.version) AS version
      FROM inst i JOIN (SELECT DISTINCT seq // {STEP} AS version FROM inst) v ON (v.version + 1) * {STEP} <= i.seq // 100 * 100 GROUP BY ALL)""",
)


@query(
    "score_asof",
    q.with_(*ASOF) + """SELECT v.instance_id, f.version, CAST(v.member % 100 AS INTEGER) AS member, v.label, round(v.vote, 6) AS vote
    FROM votes v JOIN force f ON f.instance_id = v.instance_id AND f.version = v.member // 100""",
)
def score_asof(spark, sf_dir):
    """Every event is scored by the members of the version in force at its poll."""
    spec, rows = events_spec(spark, sf_dir), events(spark, sf_dir)
    weighted = with_poisson_weight(ensemble_fanout(rows, ENSEMBLE), seed=SEED).withColumn("version", F.expr(f"seq div {STEP}"))
    stats = nb.nb_train(weighted, spec, keys=("version", "member"))
    published = rows.select(F.expr(f"seq div {STEP}").alias("version")).distinct().withColumn("published_seq", (F.col("version") + 1) * STEP)
    messages = rows.select("instance_id", "seq", *spec.numeric, *spec.nominal)
    versions = read_table(spark, sf_dir, "events").count() // STEP + 1
    votes = score_asof_op(messages, published, stats, spec, ENSEMBLE, versions)
    return vt.long_votes(votes, ["instance_id", "version", "member"], spec.classes)


@query(
    "model_delete",
    q.with_(*SNAP) + "SELECT version, member, trained_n FROM snap WHERE member <> 1 AND NOT (member = 2 AND version = 0)",
)
def model_delete(spark, sf_dir):
    """All versions of member 1, and version 0 of member 2."""
    store = _store(spark, sf_dir, "delete-store")
    store.delete(1)
    store.delete(2, version=0)
    return store.members().select("version", "member", "trained_n")


# A snapshot asked for at version v is published after a delay that depends on
# the instance at v: up to 297 instances.
DELAY = "3"
PLAN = (
    q.INST,
    f"due AS MATERIALIZED (SELECT seq AS version, CAST(seq + x_k * {DELAY} AS BIGINT) AS published_at FROM inst WHERE seq % 100 = 0)",
    "nx AS MATERIALIZED (SELECT version, published_at, CAST(ceil(greatest(version + 1, published_at) / 100.0) * 100 AS BIGINT) AS nxt FROM due)",
    "ch AS (SELECT * FROM nx WHERE version = 0 UNION ALL SELECT n.* FROM ch JOIN nx n ON n.version = ch.nxt)",
)


@query("checkpoint_plan", q.with_(*PLAN) + "SELECT version, published_at FROM ch")
def checkpoint_plan(spark, sf_dir):
    inst = events(spark, sf_dir).select(F.col("seq").alias("version"), (F.col("seq") + F.col("x_k") * 3).cast("long").alias("published_at"))
    return vs.checkpoint_plan(inst, pending=100)


@query(
    "persist_gate",
    q.with_(
        q.INST,
        f"""req AS MATERIALIZED (SELECT CAST(p.part AS INTEGER) AS part, i.seq AS version, CAST(i.seq + i.x_k * (p.part + 1) * 2 AS BIGINT) AS ok_at
      FROM inst i, (SELECT unnest(range(0, {PARTS})) AS part) p WHERE i.seq % 100 = 0)""",
        "nx AS MATERIALIZED (SELECT part, version, CAST(ceil(greatest(version + 1, ok_at) / 100.0) * 100 AS BIGINT) AS nxt FROM req)",
        "ch AS (SELECT * FROM nx WHERE version = 0 UNION ALL SELECT n.* FROM ch JOIN nx n ON n.part = ch.part AND n.version = ch.nxt)",
    )
    + "SELECT part, version FROM ch",
)
def persist_gate(spark, sf_dir):
    """Requests every 100 versions; each part's save takes its own time to be published."""
    inst = events(spark, sf_dir).where(vs.snapshot_due(F.col("seq"), 100))
    req = inst.select(F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.col("seq").alias("version"), "x_k")
    ok_at = F.col("version") + F.col("x_k").cast("long") * (F.col("part") + 1) * 2
    nxt = F.ceil(F.greatest(F.col("version") + 1, ok_at) / 100) * 100
    return vs.persist_gate(req.select("part", "version", nxt.cast("long").alias("next_ok"))).select("part", "version")


@query(
    "can_persist",
    q.with_(
        q.INST,
        "p AS (SELECT user_id, seq, lag(seq) OVER (PARTITION BY user_id ORDER BY seq) AS last_saved, CAST(seq - x_k * 10 AS BIGINT) AS published FROM inst)",
    )
    + "SELECT seq, last_saved IS NULL OR (last_saved < seq AND published >= last_saved) AS may_save FROM p",
)
def can_persist(spark, sf_dir):
    """The save rule on its own: one part per user, each version saved in turn."""
    inst = events(spark, sf_dir).select("user_id", "seq", F.col("x_k").cast("long").alias("x_k"))
    # The user's row before this one, without a window over a whole user.
    prev = running(inst, "seq", [Running("last_saved", "seq", how="max")], keys=["user_id"], exclusive=True)
    rule = vs.can_persist(F.col("seq"), F.coalesce("last_saved", F.lit(-1)), F.col("seq") - F.col("x_k") * 10, F.col("last_saved").isNull())
    return prev.select("seq", rule.alias("may_save"))


@query(
    "retain_two",
    q.with_(*SNAP, "r AS (SELECT *, dense_rank() OVER (PARTITION BY member ORDER BY version DESC) AS rk FROM snap)")
    + "SELECT version, member, trained_n FROM r WHERE rk <= 2",
)
def retain_two(spark, sf_dir):
    return vs.retain_two(_snapshots(spark, sf_dir)).select("version", "member", "trained_n")


SAVED = "saved AS MATERIALIZED (SELECT * FROM snap WHERE trained_n >= 610)"


@query(
    "restore_all_or_nothing",
    q.with_(
        *SNAP, SAVED,
        f"sizes AS (SELECT {PART} AS part, count(*) AS n FROM {q.members(ENSEMBLE)} m GROUP BY ALL)",
        "whole AS (SELECT s.part, s.version FROM saved s GROUP BY s.part, s.version HAVING count(DISTINCT member) = (SELECT n FROM sizes z WHERE z.part = s.part))",
    )
    + "SELECT z.part, coalesce(max(w.version), -1) AS version FROM sizes z LEFT JOIN whole w ON w.part = z.part GROUP BY z.part",
)
def restore_all_or_nothing(spark, sf_dir):
    """Members that trained little were not saved, so some versions are incomplete."""
    saved = _snapshots(spark, sf_dir).where(F.col("trained_n") >= 610)
    sizes = spark.createDataFrame([(p, n) for p, n in enumerate(partition_sizes(ENSEMBLE, PARTS))], "part int, n_members long")
    return vs.restore_all_or_nothing(saved, sizes)


@query("txn_upsert", q.with_(*ALL_BAG, q.nb_stats("bag")) + "SELECT member, label, attr, value, w, round(wx, 6) AS wx, round(wxx, 6) AS wxx FROM stats")
def txn_upsert(spark, sf_dir):
    """Two batches, the first of them delivered twice: it counts once."""
    inst = events(spark, sf_dir).select(*COLS)
    spec = events_spec(spark, sf_dir)
    half = stream_cut(spark, sf_dir, 0.5)
    store = ModelStore(spark, new_folder(spark, "txn-store"), tr.STAT_SCHEMA)
    first = tr.bag_delta(inst.where(F.col("seq") < half), spec, ENSEMBLE, SEED)
    second = tr.bag_delta(inst.where(F.col("seq") >= half), spec, ENSEMBLE, SEED)
    tr.apply_batch(store, first, 0)
    tr.apply_batch(store, first, 0)
    tr.apply_batch(store, second, 1)
    return stat_rows(store.members(store.current_version()), "member")


@query(
    "model_snapshot",
    q.with_(*SNAP) + f"""SELECT m.member, coalesce(base64(encode('{{"member":' || s.member || ',"trained_n":' || s.trained_n || '}}')), '') AS model
    FROM {q.members(ENSEMBLE + 1)} m LEFT JOIN snap s ON s.member = m.member AND s.version = (SELECT max(version) FROM snap)""",
)
def model_snapshot(spark, sf_dir):
    """The current models as payloads; an empty one for a member without a model."""
    store = _store(spark, sf_dir, "snapshot-store")
    newest = store.members().agg(F.max("version")).first()[0]
    store.publish(newest)
    keys = spark.range(ENSEMBLE + 1).select(F.col("id").cast("int").alias("member"))
    got = store.get(keys, store.current_version())
    text = F.when(F.col("trained_n").isNotNull(), pl.encode_payload("member", "trained_n"))
    return got.select("member", F.coalesce(text, F.lit("")).alias("model"))


@query(
    "score_then_train",
    q.with_(
        q.INST,
        f"tr AS (SELECT * FROM inst WHERE seq < {q.cut(0.5)})",
        q.bag("tr", ENSEMBLE, SEED),
        q.nb_stats("bag"),
        f"te AS (SELECT * FROM inst WHERE seq >= {q.cut(0.5)})",
        q.nb_votes("te"),
        q.normalize("votes", "nv", "instance_id, member"),
        "fl AS MATERIALIZED (SELECT instance_id, label, sum(vote) AS vote FROM nv GROUP BY ALL)",
        q.normalize("fl", "fn", "instance_id", cols="instance_id, label"),
    )
    + "SELECT instance_id, CAST(1 AS BIGINT) AS batch, label, round(vote, 6) AS vote FROM fn",
)
def score_then_train(spark, sf_dir):
    """Memory-only bagging: each micro-batch is scored by the state before it.

    Two batches, each half of the stream: the first finds no model, the second
    is scored by what the first has taught.
    """
    inst = events(spark, sf_dir).select(*COLS)
    spec = events_spec(spark, sf_dir)
    half = stream_cut(spark, sf_dir, 0.5)
    folder = new_folder(spark, "stt-channel")
    channels.publish_instances(inst.where(F.col("seq") < half), folder, files=2)
    channels.publish_instances(inst.where(F.col("seq") >= half), folder, files=2)
    stream = channels.read_channel(spark, folder, CHANNEL, files_per_trigger=2)
    store = ModelStore(spark, new_folder(spark, "stt-store"), tr.STAT_SCHEMA)
    out = new_folder(spark, "stt-predictions")
    tr.score_then_train_stream(stream, store, spec, ENSEMBLE, out, new_folder(spark, "stt-ckpt"), SEED).awaitTermination()
    scored = spark.read.parquet(out).withColumn("batch", F.col("batch_id").cast("long"))
    return vt.long_votes(scored, ["instance_id", "batch"], spec.classes)
