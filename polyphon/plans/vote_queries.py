"""Queries of scoring, vote aggregation and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyphon.operators import boosting as bo
from polyphon.operators import evaluation as ev
from polyphon.operators import naive_bayes as nb
from polyphon.operators import scoring as sc
from polyphon.operators import votes as vt
from polyphon.operators.streams import ensemble_fanout, instance_batches
from polyphon.plans import sqltext as q
from polyphon.plans.bagging import bag_holdout, bag_predict, bag_train
from polyphon.plans.common import (
    BOOST, ENSEMBLE, PARTS, SEED, SET_MS, all_votes, events, events_spec, lineitem_spec, order_votes, row_votes, test_rows, train_rows, trained,
)
from polyphon.plans.registry import query
from polyphon.plans.stream_queries import BAG_PRED, PART_SQL
from polyphon.plans.training_queries import MEMBER_SQL, STATS_SQL, boost_ctes, boost_members, event_member_weights
from polyphon.sources import channels
from polyphon.sources.instances import FeatureSpec, complete_header, lineitem_instances, orders_instances, read_table
from polyphon.sources.workspace import materialize, new_folder
from polyphon.streaming.timeouts import vote_timeout as vote_timeout_op, vote_timeout_stream as vote_timeout_stream_op

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
STRETCHES = 3
SHUFFLES = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _votes_sql(ensemble):
    return (
        q.INST,
        q.bag("inst", ensemble, SEED),
        q.nb_stats("bag"),
        q.nb_votes("inst"),
        q.normalize("votes", "nv", "instance_id, member"),
    )


VOTES = _votes_sql(ENSEMBLE)
PART = PART_SQL.format(e=ENSEMBLE, t=PARTS)
PARTIAL = (
    *VOTES,
    f"part AS MATERIALIZED (SELECT instance_id, {PART} AS part, label, sum(vote) AS vote, CAST(count(*) AS INTEGER) AS n_votes FROM nv GROUP BY ALL)",
)


@query("member_votes", q.with_(*VOTES) + "SELECT instance_id, member, label, round(vote, 6) AS vote FROM votes")
def member_votes(spark, sf_dir):
    return vt.long_votes(all_votes(spark, sf_dir), ["instance_id", "member"], events_spec(spark, sf_dir).classes)


@query("vote_normalize", q.with_(*VOTES) + "SELECT instance_id, member, label, round(vote, 6) AS vote FROM nv")
def vote_normalize(spark, sf_dir):
    spec = events_spec(spark, sf_dir)
    v = vt.vote_normalize(all_votes(spark, sf_dir), len(spec.classes))
    return vt.long_votes(v, ["instance_id", "member"], spec.classes)


@query("bag_partial_votes", q.with_(*PARTIAL) + "SELECT instance_id, part, n_votes, label, round(vote, 6) AS vote FROM part")
def bag_partial_votes(spark, sf_dir):
    spec = events_spec(spark, sf_dir)
    n = len(spec.classes)
    p = sc.part_rows(sc.part_vectors(row_votes(spark, sf_dir), n, ENSEMBLE, PARTS), n, ["instance_id"])
    return vt.long_votes(p, ["instance_id", "part", "n_votes"], spec.classes)


@query(
    "boost_partial_votes",
    q.with_(
        *STATS_SQL,
        q.normalize("votes", "nv", "instance_id, member"),
        f"""bp AS (SELECT n.instance_id, n.part, n.label,
          sum(CASE WHEN b.weight > 0 THEN n.vote * b.weight ELSE 0 END) AS vote, CAST(count(*) AS INTEGER) AS n_votes
          FROM (SELECT *, {PART_SQL.format(e=BOOST, t=PARTS)} AS part FROM nv) n LEFT JOIN bweights b ON b.member = n.member GROUP BY ALL)""",
    )
    + "SELECT instance_id, part, n_votes, label, round(vote, 6) AS vote FROM bp",
)
def boost_partial_votes(spark, sf_dir):
    spec = events_spec(spark, sf_dir)
    n = len(spec.classes)
    members = boost_members(spark, sf_dir)
    # One entry per member.
    weights = event_member_weights(spark, sf_dir, members).agg(F.expr("map_from_entries(collect_list(struct(member, weight)))").alias("w"))
    voted = row_votes(spark, sf_dir, BOOST, members).withColumn("_weights", weights.scalar())
    p = sc.part_rows(sc.part_vectors(voted, n, BOOST, PARTS, "_weights"), n, ["instance_id"])
    return vt.long_votes(p, ["instance_id", "part", "n_votes"], spec.classes)


def _combined_sql(renormalize):
    return (
        *PARTIAL,
        q.normalize("part", "pn", "instance_id, part", cols="instance_id, part, label, n_votes") if renormalize else "pn AS (SELECT * FROM part)",
        "sm AS MATERIALIZED (SELECT instance_id, label, sum(vote) AS vote, CAST(sum(n_votes) AS INTEGER) AS n_votes FROM pn GROUP BY ALL)",
        q.normalize("sm", "cv", "instance_id", cols="instance_id, label, n_votes"),
    )


@query("combine_votes", q.with_(*_combined_sql(True)) + "SELECT instance_id, n_votes, label, round(vote, 6) AS vote FROM cv")
def combine_votes(spark, sf_dir):
    """Parts of 2 and 3 members have equal say."""
    spec = events_spec(spark, sf_dir)
    n = len(spec.classes)
    c = sc.combined_rows(sc.part_vectors(row_votes(spark, sf_dir), n, ENSEMBLE, PARTS), n, ["instance_id"], "hierarchical")
    return vt.long_votes(c, ["instance_id", "n_votes"], spec.classes)


@query("combine_votes_flat", q.with_(*_combined_sql(False)) + "SELECT instance_id, n_votes, label, round(vote, 6) AS vote FROM cv")
def combine_votes_flat(spark, sf_dir):
    spec = events_spec(spark, sf_dir)
    n = len(spec.classes)
    c = sc.combined_rows(sc.part_vectors(row_votes(spark, sf_dir), n, ENSEMBLE, PARTS), n, ["instance_id"], "flat")
    return vt.long_votes(c, ["instance_id", "n_votes"], spec.classes)


@query(
    "combine_two_stage",
    q.with_(
        *VOTES,
        f"part AS MATERIALIZED (SELECT instance_id, {PART_SQL.format(e=ENSEMBLE, t=3)} AS part, label, sum(vote) AS vote, count(*) AS n_votes FROM nv GROUP BY ALL)",
        q.normalize("part", "pn", "instance_id, part", cols="instance_id, part, label, n_votes"),
        "wk AS MATERIALIZED (SELECT instance_id, part // 2 AS worker, label, sum(vote) AS vote, sum(n_votes) AS n_votes FROM pn GROUP BY ALL)",
        q.normalize("wk", "wn", "instance_id, worker", cols="instance_id, worker, label, n_votes"),
        "sm AS MATERIALIZED (SELECT instance_id, label, sum(vote) AS vote, CAST(sum(n_votes) AS INTEGER) AS n_votes FROM wn GROUP BY ALL)",
        q.normalize("sm", "cv", "instance_id", cols="instance_id, label, n_votes"),
    )
    + "SELECT instance_id, n_votes, label, round(vote, 6) AS vote FROM cv",
)
def combine_two_stage(spark, sf_dir):
    """Three parts on two workers: each stage re-normalises what it receives."""
    spec = events_spec(spark, sf_dir)
    n = len(spec.classes)
    c = sc.two_stage_rows(sc.part_vectors(row_votes(spark, sf_dir), n, ENSEMBLE, 3), n, ["instance_id"], parts_per_worker=2, complete=ENSEMBLE)
    return vt.long_votes(c, ["instance_id", "n_votes"], spec.classes)


OPEN_EVENTS = FeatureSpec(numeric=("x_cents", "x_k"), open=("o_user",))
OPEN_LINES = FeatureSpec(numeric=("x_quantity", "x_discount", "x_tax"), nominal={"n_status": ()}, open=("o_supplier",))
OPEN_ORDERS = FeatureSpec(numeric=("x_cents",), nominal={"n_status": ()}, open=("o_customer",))


@query(
    "open_member_votes",
    q.with_(
        q.INST,
        q.bag("inst", ENSEMBLE, SEED),
        q.nb_stats("bag", nominal=("o_user",)),
        q.nb_votes("inst", nominal=(), open_=("o_user",)),
        q.normalize("votes", "nv", "instance_id, member"),
        "fl AS MATERIALIZED (SELECT instance_id, label, sum(vote) AS vote FROM nv GROUP BY ALL)",
        q.normalize("fl", "fn", "instance_id", cols="instance_id, label"),
    )
    + "SELECT instance_id, label, round(vote, 6) AS vote FROM fn",
)
def open_member_votes(spark, sf_dir):
    """A bagged ensemble whose nominal attribute is the user, of whom there may be any number."""
    inst = events(spark, sf_dir)
    spec = complete_header(inst, OPEN_EVENTS)
    voted = sc.row_votes(inst.select("instance_id", *spec.numeric, *spec.open), bag_train(inst, spec, ENSEMBLE, SEED), spec, ENSEMBLE)
    return vt.long_votes(sc.flat_rows(voted, len(spec.classes), ["instance_id"], ensemble=ENSEMBLE), ["instance_id"], spec.classes)


@query(
    "open_votes_lineitem",
    q.with_(
        """inst AS MATERIALIZED (SELECT row_number() OVER () AS instance_id, CAST(1.0 AS DOUBLE) AS weight, CAST(0 AS INTEGER) AS member, l_quantity AS x_quantity,
      round(l_discount * 100) AS x_discount, round(l_tax * 100) AS x_tax, l_linestatus AS n_status, CAST(l_suppkey AS VARCHAR) AS o_supplier,
      l_returnflag AS label FROM lineitem)""",
        q.nb_stats("inst", w="weight", numeric=("x_quantity", "x_discount", "x_tax"), nominal=("n_status", "o_supplier")),
        q.nb_votes("inst", numeric=("x_quantity", "x_discount", "x_tax"), nominal=("n_status",), open_=("o_supplier",), carry=", r.label AS truth"),
        q.argmax("votes", "best", by="instance_id", carry=", truth"),
    )
    + "SELECT truth, pred, CAST(count(*) AS DOUBLE) AS w FROM best GROUP BY ALL",
)
def open_votes_lineitem(spark, sf_dir):
    """The largest table, with its suppliers as open values: training and scoring of every row."""
    rows = lineitem_instances(read_table(spark, sf_dir, "lineitem"))
    spec = complete_header(rows, OPEN_LINES)
    # Written: the constants, the values' terms and their number read it.
    stats = materialize(nb.single_train(rows, spec), "line-stats")
    voted = sc.row_votes(rows.withColumnRenamed("label", "truth"), stats, spec, 1)
    best = vt.with_argmax(sc.flat_rows(voted, len(spec.classes), ["truth", "weight"], ensemble=1), len(spec.classes))
    return ev.confusion(sc.with_label(best, spec, "pred_index"))


FLAT = (
    *VOTES,
    "fl AS MATERIALIZED (SELECT instance_id, label, sum(vote) AS vote FROM nv GROUP BY ALL)",
    q.normalize("fl", "fn", "instance_id", cols="instance_id, label"),
)


@query("flat_combine", q.with_(*FLAT) + "SELECT instance_id, label, round(vote, 6) AS vote FROM fn")
def flat_combine(spark, sf_dir):
    spec = events_spec(spark, sf_dir)
    return vt.long_votes(sc.flat_rows(row_votes(spark, sf_dir), len(spec.classes), ["instance_id"], ensemble=ENSEMBLE), ["instance_id"], spec.classes)


@query("vote_combiner", q.with_(*FLAT) + "SELECT instance_id, label, round(vote, 6) AS vote FROM fl")
def vote_combiner(spark, sf_dir):
    spec = events_spec(spark, sf_dir)
    return vt.long_votes(sc.flat_rows(row_votes(spark, sf_dir), len(spec.classes), ["instance_id"], ensemble=ENSEMBLE, keep_zero=True), ["instance_id"], spec.classes)


ORDER_VOTES = """arr AS MATERIALIZED (SELECT l_orderkey AS instance_id, epoch_us(l_shipdate) // 1000 AS ts_ms, l_suppkey AS combiner, l_returnflag AS label
  FROM lineitem)"""


@query(
    "complete_only",
    q.with_(
        *_votes_sql(BOOST),
        "es AS MATERIALIZED (SELECT instance_id, label, sum(vote) AS vote, CAST(count(*) AS INTEGER) AS n_votes FROM nv GROUP BY ALL)",
        q.normalize("es", "en", "instance_id", cols="instance_id, label, n_votes"),
        ORDER_VOTES,
        f"n AS MATERIALIZED (SELECT instance_id, CAST(count(*) AS INTEGER) AS n_votes FROM arr GROUP BY instance_id HAVING count(*) = {BOOST})",
        "sm AS (SELECT instance_id, n_votes, c.label, count(*) FILTER (WHERE arr.label = c.label) / n_votes AS vote "
        "FROM arr JOIN n USING (instance_id) CROSS JOIN (SELECT DISTINCT label FROM arr) c GROUP BY instance_id, n_votes, c.label)",
    )
    + f"""SELECT 'event' AS stream, instance_id, n_votes, label, round(vote, 6) AS vote FROM en WHERE n_votes = {BOOST}
    UNION ALL SELECT 'order', instance_id, n_votes, label, round(vote, 6) FROM sm""",
)
def complete_only(spark, sf_dir):
    """Two streams of votes, of which only instances with exactly three are emitted.

    Every event gets the votes of three bagged members, none of which is lost. An
    order's lines vote for their return flag, and there are more or fewer of them.
    """
    spec = events_spec(spark, sf_dir)
    k = len(spec.classes)
    partials = sc.part_rows(sc.part_vectors(row_votes(spark, sf_dir, BOOST), k, BOOST, PARTS), k, ["instance_id"])
    answered = vt.long_votes(vt.complete_only(partials, k, BOOST), ["'event' AS stream", "instance_id", "n_votes"], spec.classes)
    classes = lineitem_spec(spark, sf_dir).classes
    n = len(classes)
    votes = order_votes(spark, sf_dir).withColumn("part", F.pmod(F.col("combiner"), F.lit(PARTS)).cast("int"))
    votes = votes.select("instance_id", "part", *[F.when(F.col("label") == c, 1.0).otherwise(0.0).alias(v) for c, v in zip(classes, vt.vote_cols(n))])
    asked = vt.long_votes(vt.complete_only(vt.bag_partial_votes(votes, n), n, BOOST), ["'order' AS stream", "instance_id", "n_votes"], classes)
    return answered.unionByName(asked)


VOTE_SETS = (
    q.with_(
        ORDER_VOTES,
        "v AS MATERIALIZED (SELECT instance_id, ts_ms, row_number() OVER (PARTITION BY instance_id ORDER BY ts_ms) AS rn FROM arr)",
        # Where the set that begins with a vote ends: when it is full, or before the first vote that is too late.
        f"""nx AS MATERIALIZED (SELECT a.instance_id, a.rn, a.ts_ms, least(a.rn + {BOOST}, count(*) FILTER (WHERE b.ts_ms < a.ts_ms + {SET_MS}) + 1) AS nxt
      FROM v a JOIN v b ON b.instance_id = a.instance_id GROUP BY a.instance_id, a.rn, a.ts_ms)""",
        """st AS (SELECT instance_id, rn, ts_ms, nxt FROM nx WHERE rn = 1
      UNION ALL SELECT nx.instance_id, nx.rn, nx.ts_ms, nx.nxt FROM st JOIN nx ON nx.instance_id = st.instance_id AND nx.rn = st.nxt)""",
    )
    + f"SELECT instance_id, ts_ms AS first_ms, nxt - rn AS n_votes, nxt - rn = {BOOST} AS complete FROM st"
)


@query("vote_timeout", VOTE_SETS)
def vote_timeout(spark, sf_dir):
    """Sets of three line items of an order within a year of the first."""
    return vote_timeout_op(order_votes(spark, sf_dir), BOOST, SET_MS)


@query("vote_timeout_stream", VOTE_SETS)
def vote_timeout_stream(spark, sf_dir):
    """The same votes as a stream, in order of time; a closing row behind all of them ends the last sets.

    A reader does not keep the order of files written by one job, so each stretch
    of time is published and read by a run of its own, which goes on from the
    checkpoint of the one before.
    """
    votes = order_votes(spark, sf_dir).select("instance_id", "ts_ms", "n_votes")
    closing = votes.agg(F.lit(-1).cast("long").alias("instance_id"), (F.max("ts_ms") + 2 * SET_MS).alias("ts_ms"), F.lit(1).cast("long").alias("n_votes"))
    rows = votes.unionByName(closing.where("ts_ms IS NOT NULL")).withColumn("ts", F.timestamp_millis("ts_ms"))
    folder = new_folder(spark, "vote-channel")
    out, checkpoint = new_folder(spark, "vote-sets"), new_folder(spark, "vote-ckpt")
    ends = votes.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    low, high = ends if ends[0] is not None else (0, 0)
    cuts = [low + (high - low) * i // STRETCHES for i in range(1, STRETCHES)]
    before = {c: spark.conf.get(c) for c in (STATE_STORE, SHUFFLES)}
    spark.conf.set(STATE_STORE, ROCKSDB)
    # Every partition of the state is opened and stored in every batch, whatever it holds.
    spark.conf.set(SHUFFLES, min(int(before[SHUFFLES]), max(32, 2 * spark.sparkContext.defaultParallelism)))
    try:
        for start, end in zip([None, *cuts], [*cuts, None]):
            part = rows if start is None else rows.where(F.col("ts_ms") >= start)
            channels.publish_instances(part if end is None else part.where(F.col("ts_ms") < end), folder)
            stream = channels.read_channel(spark, folder, rows.schema).drop("ts_ms")
            sets = vote_timeout_stream_op(stream, BOOST, SET_MS).writeStream.foreachBatch(lambda batch, i: channels.write_predictions(batch, i, out))
            sets.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    return spark.read.parquet(out).where("instance_id >= 0").select("instance_id", "first_ms", "n_votes", "complete")


@query("argmax_label", q.with_(*FLAT, q.argmax("fn", "best")) + "SELECT instance_id, pred FROM best")
def argmax_label(spark, sf_dir):
    spec = events_spec(spark, sf_dir)
    n = len(spec.classes)
    c = sc.flat_rows(row_votes(spark, sf_dir), n, ["instance_id"])
    return vt.with_argmax(c, n).select("instance_id", spec.class_at(F.col("pred_index")).alias("pred"))


@query(
    "positional_votes",
    q.with_(*FLAT) + f"SELECT instance_id // 100 AS batch_id, CAST(instance_id % 100 AS INTEGER) AS pos, CAST({ENSEMBLE} AS INTEGER) AS n_votes, label, round(vote, 6) AS vote FROM fl",
)
def positional_votes(spark, sf_dir):
    """Each member sends one list of 100 vote vectors per batch."""
    spec = events_spec(spark, sf_dir)
    v = instance_batches(all_votes(spark, sf_dir)).withColumnRenamed("batch_no", "batch_id")
    # A batch has 100 places, so a list has at most 100 vectors.
    lists = v.groupBy("batch_id", "member").agg(F.array_sort(F.collect_list(F.struct("pos", F.array(*vt.vote_cols(len(spec.classes))).alias("votes")))).alias("l"))
    sent = lists.select("batch_id", "member", F.transform("l", lambda s: s["votes"]).alias("vote_list"))
    return vt.long_votes(vt.positional_votes(sent, len(spec.classes)), ["batch_id", "pos", "n_votes"], spec.classes)


# -- accuracy ----------------------------------------------------------------

METRIC_SQL = """SELECT n AS instances, round(acc, 6) AS accuracy, round((acc - pc) / (1 - pc), 6) AS kappa FROM (
  SELECT sum(weight) AS n, sum(CASE WHEN pred = truth THEN weight ELSE 0 END) / sum(weight) AS acc,
    (SELECT sum(t.w * p.w) FROM (SELECT truth AS c, sum(weight) AS w FROM pr GROUP BY truth) t JOIN (SELECT pred AS c, sum(weight) AS w FROM pr GROUP BY pred) p USING (c))
      / (sum(weight) * sum(weight)) AS pc FROM pr)"""


def rounded(df):
    return df.select("instances", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"))


@query("holdout_eval", q.with_(*BAG_PRED) + METRIC_SQL)
def holdout_eval(spark, sf_dir):
    """The flagship: train on the first 80 %, evaluate on the rest."""
    return rounded(bag_holdout(events(spark, sf_dir), events_spec(spark, sf_dir), ENSEMBLE, SEED))


@query(
    "boost_holdout",
    q.with_(
        q.INST,
        f"tr AS MATERIALIZED (SELECT * FROM inst WHERE seq < {q.cut()})",
        *boost_ctes("tr", False),
        *MEMBER_SQL,
        f"bw AS MATERIALIZED ({' UNION ALL '.join(f'SELECT member, label, n_user, x_cents, x_k, w FROM bt{m} WHERE w > 0' for m in range(BOOST))})",
        q.nb_stats("bw"),
        f"te AS (SELECT * FROM inst WHERE seq >= {q.cut()})",
        q.nb_votes("te"),
        q.normalize("votes", "nv", "instance_id, member"),
        """fl AS MATERIALIZED (SELECT n.instance_id, n.label, sum(CASE WHEN b.weight > 0 THEN n.vote * b.weight ELSE 0 END) AS vote
          FROM nv n JOIN bweights b USING (member) GROUP BY ALL)""",
        q.normalize("fl", "fn", "instance_id", cols="instance_id, label"),
        q.argmax("fn", "best"),
        "pr AS MATERIALIZED (SELECT b.pred, i.label AS truth, i.weight FROM best b JOIN inst i USING (instance_id))",
    )
    + METRIC_SQL,
)
def boost_holdout(spark, sf_dir):
    """Boost on the first 80 %, weight the members' votes, evaluate on the rest."""
    spec = events_spec(spark, sf_dir)
    n = len(spec.classes)
    run = bo.boost_train(train_rows(spark, sf_dir), spec, BOOST, seed=SEED)
    weights = bo.member_sums(run.chain).select("member", vt.boost_member_weight(F.col("scms"), F.col("swms")).alias("weight"))
    rows = test_rows(spark, sf_dir).select("instance_id", "weight", *spec.numeric, *spec.nominal, F.col("label").alias("truth"))
    fanned = ensemble_fanout(rows.drop("truth", "weight"), BOOST).withColumn("part", F.lit(0))
    votes = nb.member_votes(fanned, nb.nb_model(run.stats, spec), spec, BOOST)
    best = vt.with_argmax(vt.combine_votes(vt.boost_partial_votes(votes, weights, n, BOOST), n), n)
    scored = rows.join(best.select("instance_id", spec.class_at(F.col("pred_index")).alias("pred")), "instance_id")
    return rounded(ev.basic_evaluator(scored))


ALL_PRED = (
    *BAG_PRED[:-1],
    "pr AS MATERIALIZED (SELECT b.instance_id, b.instance_id AS seq, b.pred, i.label AS truth, i.weight, CASE WHEN b.pred = i.label THEN 1 ELSE 0 END AS correct FROM best b JOIN inst i USING (instance_id))",
)


def _scored(spark, sf_dir):
    """Predictions for the held-out rows: no row that trained the ensemble is scored."""
    spec = events_spec(spark, sf_dir)
    scored = bag_predict(test_rows(spark, sf_dir), trained(spark, sf_dir), spec, ENSEMBLE)
    return scored.select(
        F.col("instance_id").alias("seq"), "truth", "pred", "weight", F.when(F.col("truth") == F.col("pred"), 1).otherwise(0).alias("correct")
    )


@query("basic_evaluator", q.with_(*ALL_PRED) + METRIC_SQL)
def basic_evaluator(spark, sf_dir):
    return rounded(ev.basic_evaluator(_scored(spark, sf_dir)))


@query("confusion", q.with_(*ALL_PRED) + "SELECT truth, pred, sum(weight) AS w FROM pr GROUP BY ALL")
def confusion(spark, sf_dir):
    return ev.confusion(_scored(spark, sf_dir))


@query(
    "window_evaluator",
    q.with_(*ALL_PRED) + """SELECT seq, round(sum(weight * correct) OVER w / sum(weight) OVER w, 6) AS window_accuracy FROM pr
    WINDOW w AS (ORDER BY seq ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
)
def window_evaluator(spark, sf_dir):
    w = ev.window_evaluator(_scored(spark, sf_dir), width=1000)
    return w.select("seq", F.round("window_accuracy", 6).alias("window_accuracy"))


@query(
    "learning_curve",
    q.with_(*ALL_PRED) + "SELECT seq // 1000 AS step_no, sum(weight) AS instances, round(sum(weight * correct) / sum(weight), 6) AS accuracy FROM pr GROUP BY ALL",
)
def learning_curve(spark, sf_dir):
    c = ev.learning_curve(_scored(spark, sf_dir), 1000)
    return c.select("step_no", "instances", F.round("accuracy", 6).alias("accuracy"))


@query("prequential", q.with_(q.INST, *q.running_votes("inst", "pv")) + "SELECT seq, truth, label, round(vote, 6) AS vote FROM pv")
def prequential(spark, sf_dir):
    spec = events_spec(spark, sf_dir)
    inst = events(spark, sf_dir).select("seq", "weight", *spec.numeric, *spec.nominal, "label")
    p = ev.prequential(inst, spec).withColumnRenamed("label", "truth")
    return vt.long_votes(p, ["seq", "truth"], spec.classes)


@query(
    "open_prequential",
    q.with_(q.INST, *q.running_votes("inst", "pv", nominal=(), open_=("o_user",))) + "SELECT seq, truth, label, round(vote, 6) AS vote FROM pv",
)
def open_prequential(spark, sf_dir):
    """Test-then-train with the user as an open value."""
    inst = events(spark, sf_dir)
    spec = complete_header(inst, OPEN_EVENTS)
    p = ev.prequential(inst.select("seq", "weight", *spec.numeric, *spec.open, "label"), spec).withColumnRenamed("label", "truth")
    return vt.long_votes(p, ["seq", "truth"], spec.classes)


@query(
    "open_prequential_orders",
    q.with_(
        """inst AS MATERIALIZED (SELECT o_orderkey AS seq, CAST(1.0 AS DOUBLE) AS weight, round(o_totalprice * 100) AS x_cents,
      o_orderstatus AS n_status, CAST(o_custkey AS VARCHAR) AS o_customer, o_orderpriority AS label FROM orders)""",
        *q.running_votes("inst", "pv", numeric=("x_cents",), nominal=("n_status",), open_=("o_customer",)),
        q.argmax("pv", "best", by="seq", carry=", truth"),
    )
    + """SELECT seq // 1000 AS step_no, CAST(count(*) AS DOUBLE) AS instances,
    round(sum(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END) / count(*), 6) AS accuracy FROM best GROUP BY ALL""",
)
def open_prequential_orders(spark, sf_dir):
    """Accuracy by steps of the second labelled stream, whose customers are open values."""
    inst = orders_instances(read_table(spark, sf_dir, "orders"))
    spec = complete_header(inst, OPEN_ORDERS)
    p = vt.with_argmax(ev.prequential(inst, spec), len(spec.classes))
    scored = sc.with_label(p, spec, "pred_index").withColumn("correct", F.when(F.col("pred") == F.col("label"), 1).otherwise(0))
    c = ev.learning_curve(scored, 1000)
    return c.select("step_no", "instances", F.round("accuracy", 6).alias("accuracy"))
