"""Queries of bagging weights, naive Bayes, trees and boosting."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyphon.functions.weights import with_poisson_weight
from polyphon.operators import boosting as bo
from polyphon.operators import hoeffding as ht
from polyphon.operators import naive_bayes as nb
from polyphon.operators import versions as vs
from polyphon.operators import votes as vt
from polyphon.operators.streams import ensemble_fanout
from polyphon.plans import sqltext as q
from polyphon.plans.bagging import bag_train
from polyphon.plans.common import (
    BOOST, ENSEMBLE, SEED, events, events_spec, lineitem_spec, stream_cut,
)
from polyphon.plans.learners import bag_stream, learner
from polyphon.plans.registry import query
from polyphon.plans.stream_queries import CHANNEL, COLS, STREAM_FILES
from polyphon.sources import channels
from polyphon.sources.instances import lineitem_instances, read_table
from polyphon.sources.model_store import ModelStore
from polyphon.sources.workspace import materialize, new_folder
from polyphon.streaming import training as tr

ALL_BAG = (q.INST, q.bag("inst", ENSEMBLE, SEED))
STAT_OUT = "label, attr, value, w, round(wx, 6) AS wx, round(wxx, 6) AS wxx"


def stat_rows(stats, *keys):
    return stats.select(*keys, "label", "attr", "value", "w", F.round("wx", 6).alias("wx"), F.round("wxx", 6).alias("wxx"))


@query("poisson_weight", q.with_(*ALL_BAG) + "SELECT instance_id, member, CAST(k AS INTEGER) AS k, w FROM bag")
def poisson_weight(spark, sf_dir):
    fanned = ensemble_fanout(events(spark, sf_dir).select("instance_id", "weight"), ENSEMBLE)
    return with_poisson_weight(fanned, seed=SEED).select("instance_id", "member", "k", "w")


@query(
    "single_train",
    q.with_(q.INST, "one AS (SELECT *, CAST(0 AS INTEGER) AS member FROM inst)", q.nb_stats("one", w="weight")) + f"SELECT {STAT_OUT} FROM stats",
)
def single_train(spark, sf_dir):
    return stat_rows(nb.single_train(events(spark, sf_dir), events_spec(spark, sf_dir)))


LINE = """line AS MATERIALIZED (SELECT CAST(1.0 AS DOUBLE) AS weight, CAST(0 AS INTEGER) AS member, l_quantity AS x_quantity,
  round(l_discount * 100) AS x_discount, round(l_tax * 100) AS x_tax, l_linestatus AS n_status, l_returnflag AS label FROM lineitem)"""


@query(
    "single_train_lineitem",
    q.with_(LINE, q.nb_stats("line", w="weight", numeric=("x_quantity", "x_discount", "x_tax"), nominal=("n_status",))) + f"SELECT {STAT_OUT} FROM stats",
)
def single_train_lineitem(spark, sf_dir):
    """The largest table, which has no key: training needs none."""
    return stat_rows(nb.single_train(lineitem_instances(read_table(spark, sf_dir, "lineitem")), lineitem_spec(spark, sf_dir)))


@query(
    "vector_train",
    """SELECT label, pos, w, round(wx, 6) AS wx, round(wxx, 6) AS wxx FROM (
      SELECT label, CAST(pos AS INTEGER) AS pos, CAST(count(*) AS DOUBLE) AS w, sum(x) AS wx, sum(x * x) AS wxx FROM (
        SELECT label, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos)""",
)
def vector_train(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings").withColumn("weight", F.lit(1.0))
    return nb.vector_train(emb, "embedding").select("label", "pos", "w", F.round("wx", 6).alias("wx"), F.round("wxx", 6).alias("wxx"))


@query("nb_train", q.with_(*ALL_BAG, q.nb_stats("bag")) + f"SELECT member, {STAT_OUT} FROM stats")
def nb_train(spark, sf_dir):
    return stat_rows(bag_train(events(spark, sf_dir), events_spec(spark, sf_dir), ENSEMBLE, SEED), "member")


@query("bag_train_stream", q.with_(*ALL_BAG, q.nb_stats("bag")) + f"SELECT member, {STAT_OUT} FROM stats")
def bag_train_stream(spark, sf_dir):
    """The stream's last version equals training on everything at once."""
    folder = new_folder(spark, "train-channel")
    channels.publish_instances(events(spark, sf_dir).select(*COLS), folder, files=STREAM_FILES)
    store = ModelStore(spark, new_folder(spark, "train-store"), tr.STAT_SCHEMA)
    stream = channels.read_channel(spark, folder, CHANNEL, files_per_trigger=2)
    tr.bag_train_stream(stream, store, events_spec(spark, sf_dir), ENSEMBLE, new_folder(spark, "train-ckpt"), SEED).awaitTermination()
    return stat_rows(store.members(store.current_version()), "member")


@query(
    "trained_count",
    q.with_(*ALL_BAG) + """SELECT 'bagging' AS learner, member, count(*) AS trained_n FROM bag GROUP BY member
    UNION ALL SELECT 'single', CAST(0 AS INTEGER), count(*) FROM inst""",
)
def trained_count(spark, sf_dir):
    inst = events(spark, sf_dir).select("instance_id", "weight")
    bagged = nb.trained_count(with_poisson_weight(ensemble_fanout(inst, ENSEMBLE), seed=SEED))
    single = nb.trained_count(inst.withColumn("member", F.lit(0)))
    return bagged.withColumn("learner", F.lit("bagging")).unionByName(single.withColumn("learner", F.lit("single"))).select("learner", "member", "trained_n")


RESET = "(x_k = 0 AND label = 'error')"


@query(
    "model_replace",
    q.with_(
        q.INST,
        f"rest AS MATERIALIZED (SELECT *, CAST(0 AS INTEGER) AS member FROM inst WHERE NOT {RESET} AND seq > (SELECT coalesce(max(seq), -1) FROM inst WHERE {RESET}))",
        q.nb_stats("rest", w="weight"),
    )
    + f"SELECT {STAT_OUT} FROM stats",
)
def model_replace(spark, sf_dir):
    """Rows with k = 0 and label error bring a fresh model; training restarts after them."""
    rows = vs.model_replace(events(spark, sf_dir), RESET)
    return stat_rows(nb.single_train(rows, events_spec(spark, sf_dir)))


@query(
    "model_epochs",
    q.with_(q.INST, f"e AS (SELECT *, sum(CASE WHEN {RESET} THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS epoch FROM inst)")
    + f"SELECT CAST(epoch AS BIGINT) AS epoch, count(*) AS trained_n, sum(x_cents) AS sum_cents FROM e WHERE NOT {RESET} GROUP BY epoch",
)
def model_epochs(spark, sf_dir):
    """Counters of every model the stream has had, one per replacement."""
    e = vs.epochs(events(spark, sf_dir).select("seq", "x_k", "label", "x_cents"), RESET)
    return e.where(f"NOT {RESET}").groupBy("epoch").agg(F.count(F.lit(1)).alias("trained_n"), F.sum("x_cents").alias("sum_cents"))


# -- trees -------------------------------------------------------------------

TREE_MEMBERS = 3
TREE = ht.TreeParams(
    edges={"x_cents": (1000.0, 2500.0, 5000.0, 10000.0), "x_k": (20.0, 40.0, 60.0, 80.0)},
    tie=0.5, grace=50.0,
)
NODE_BYTES = TREE_MEMBERS * 1024 * 64


def _tree_cells(spark, sf_dir):
    spec = events_spec(spark, sf_dir)
    rows = ht.binned(events(spark, sf_dir), spec, TREE)
    fanned = ensemble_fanout(rows, TREE_MEMBERS)
    return ht.cells(with_poisson_weight(fanned, seed=SEED), spec), spec


def _first_split(spark, sf_dir, again=True):
    """The cells, the header and the roots' splits; the cells are written out when they are read ``again``."""
    cells, spec = _tree_cells(spark, sf_dir)
    if again:
        cells = materialize(cells, "tree-cells")
    at_root = cells.withColumn("node_id", F.lit(1).cast("long"))
    splits = materialize(ht.tree_split(ht.leaf_stats(at_root, spec), spec, TREE), "tree-splits")
    return cells, spec, splits


def bin_sql(col, edges):
    return " + ".join(f"(CASE WHEN {col} > {e} THEN 1 ELSE 0 END)" for e in edges)


TREE_SQL = (
    q.INST,
    q.bag("inst", TREE_MEMBERS, SEED),
    f"""tb AS MATERIALIZED (SELECT *, {bin_sql('x_cents', TREE.edges['x_cents'])} AS b_cents, {bin_sql('x_k', TREE.edges['x_k'])} AS b_k,
      (SELECT count(*) FROM (SELECT DISTINCT n_user FROM inst) d WHERE d.n_user < bag.n_user) AS b_user FROM bag)""",
    """tc AS MATERIALIZED (SELECT member, 'x_cents' AS attr, b_cents AS bin, label, w FROM tb UNION ALL SELECT member, 'x_k', b_k, label, w FROM tb
      UNION ALL SELECT member, 'n_user', b_user, label, w FROM tb)""",
    "ts AS MATERIALIZED (SELECT member, attr, bin, label, sum(w) AS w FROM tc GROUP BY ALL)",
    "cuts AS (SELECT DISTINCT member, attr, bin AS cut FROM ts)",
    """pl AS MATERIALIZED (SELECT c.member, c.attr, c.cut, t.label, sum(t.w) AS t,
      sum(CASE WHEN (t.attr = 'n_user' AND t.bin = c.cut) OR (t.attr <> 'n_user' AND t.bin <= c.cut) THEN t.w ELSE 0 END) AS l
      FROM cuts c JOIN ts t ON t.member = c.member AND t.attr = c.attr GROUP BY ALL)""",
    """pz AS MATERIALIZED (SELECT member, attr, cut, sum(t) AS n, sum(l) AS nl, sum(t - l) AS nr,
      sum(CASE WHEN t > 0 THEN t * log2(t) ELSE 0 END) AS ht, sum(CASE WHEN l > 0 THEN l * log2(l) ELSE 0 END) AS hl,
      sum(CASE WHEN t - l > 0 THEN (t - l) * log2(t - l) ELSE 0 END) AS hr FROM pl GROUP BY ALL)""",
    """pg AS MATERIALIZED (SELECT member, attr, cut, n, round((log2(n) - ht / n) - nl / n * (log2(nl) - hl / nl) - nr / n * (log2(nr) - hr / nr), 9) AS gain
      FROM pz WHERE nl > 0 AND nr > 0)""",
    "pa AS (SELECT *, row_number() OVER (PARTITION BY member, attr ORDER BY gain DESC, cut) AS rc FROM pg)",
    "pb AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY gain DESC, attr) AS ra FROM pa WHERE rc = 1)",
    """sp AS MATERIALIZED (SELECT a.member, a.attr, CASE WHEN a.attr = 'n_user' THEN 'eq' ELSE 'le' END AS op, CAST(a.cut AS INTEGER) AS cut, a.n, a.gain,
      coalesce(b.gain, 0) AS second_gain, sqrt(log2((SELECT count(DISTINCT label) FROM inst)) * log2((SELECT count(DISTINCT label) FROM inst)) * ln(1 / 1e-7) / (2 * a.n)) AS bound
      FROM pb a LEFT JOIN pb b ON b.member = a.member AND b.ra = 2 WHERE a.ra = 1)""",
    f"win AS MATERIALIZED (SELECT * FROM sp WHERE n >= {TREE.grace} AND gain > 0 AND (gain - second_gain > bound OR bound < {TREE.tie}))",
    """routed AS MATERIALIZED (SELECT t.*, CASE WHEN w2.attr IS NULL THEN CAST(1 AS BIGINT)
      WHEN (w2.attr = 'x_cents' AND b_cents <= cut) OR (w2.attr = 'x_k' AND b_k <= cut) OR (w2.attr = 'n_user' AND b_user = cut) THEN CAST(2 AS BIGINT)
      ELSE CAST(3 AS BIGINT) END AS node_id FROM tb t LEFT JOIN win w2 ON w2.member = t.member)""",
)


@query(
    "tree_split",
    q.with_(*TREE_SQL) + """SELECT member, CAST(1 AS BIGINT) AS node_id, attr, op, cut, n, round(gain, 6) AS gain, round(second_gain, 6) AS second_gain,
    round(bound, 6) AS bound FROM win""",
)
def tree_split(spark, sf_dir):
    """The root's split in each member, from the counts of the whole stream."""
    _, _, splits = _first_split(spark, sf_dir, again=False)
    return splits.select(
        "member", "node_id", "attr", "op", "cut", "n", F.round("gain", 6).alias("gain"),
        F.round("second_gain", 6).alias("second_gain"), F.round("bound", 6).alias("bound"),
    )


@query(
    "tree_leaf_stats",
    q.with_(*TREE_SQL) + """SELECT member, node_id, attr, CAST(bin AS INTEGER) AS bin, label, sum(w) AS w FROM (
      SELECT member, node_id, '#class' AS attr, 0 AS bin, label, w FROM routed UNION ALL SELECT member, node_id, 'x_cents', b_cents, label, w FROM routed
      UNION ALL SELECT member, node_id, 'x_k', b_k, label, w FROM routed UNION ALL SELECT member, node_id, 'n_user', b_user, label, w FROM routed) GROUP BY ALL""",
)
def tree_leaf_stats(spark, sf_dir):
    """Counts at the leaves of the once-split trees."""
    cells, spec, splits = _first_split(spark, sf_dir)
    nodes = ht.apply_splits(ht.root_nodes(spark, TREE_MEMBERS), splits)
    return ht.leaf_stats(ht.route(cells, nodes, spec, 1, NODE_BYTES), spec)


@query(
    "tree_votes",
    q.with_(*TREE_SQL, "lw AS MATERIALIZED (SELECT member, node_id, label, sum(w) AS w FROM routed GROUP BY ALL)",
            "cl AS (SELECT DISTINCT label FROM inst)",
            """tall AS MATERIALIZED (SELECT i.instance_id, m.member, CASE WHEN w2.attr IS NULL THEN CAST(1 AS BIGINT)
      WHEN (w2.attr = 'x_cents' AND b_cents <= cut) OR (w2.attr = 'x_k' AND b_k <= cut) OR (w2.attr = 'n_user' AND n_user_bin = cut) THEN CAST(2 AS BIGINT)
      ELSE CAST(3 AS BIGINT) END AS node_id FROM (SELECT *, """ + bin_sql("x_cents", TREE.edges["x_cents"]) + " AS b_cents, " + bin_sql("x_k", TREE.edges["x_k"])
            + f""" AS b_k, (SELECT count(*) FROM (SELECT DISTINCT n_user FROM inst) d WHERE d.n_user < inst.n_user) AS n_user_bin FROM inst) i
      CROSS JOIN {q.members(TREE_MEMBERS)} m LEFT JOIN win w2 ON w2.member = m.member)""")
    + "SELECT t.instance_id, t.member, t.node_id, cl.label, coalesce(lw.w, 0) AS vote FROM tall t CROSS JOIN cl LEFT JOIN lw ON lw.member = t.member AND lw.node_id = t.node_id AND lw.label = cl.label",
)
def tree_votes(spark, sf_dir):
    """Votes of the once-split trees: the class weights at each instance's leaf."""
    cells, spec, splits = _first_split(spark, sf_dir)
    nodes = ht.apply_splits(ht.root_nodes(spark, TREE_MEMBERS), splits)
    stats = ht.leaf_stats(ht.route(cells, nodes, spec, 1, NODE_BYTES), spec)
    every = ensemble_fanout(ht.binned(events(spark, sf_dir), spec, TREE), TREE_MEMBERS)
    votes = ht.leaf_votes(ht.route(every, nodes, spec, 1, NODE_BYTES), stats, spec, NODE_BYTES)
    return vt.long_votes(votes, ["instance_id", "member", "node_id"], spec.classes)


@query(
    "tree_size_limit",
    q.with_(*TREE_SQL) + """SELECT m.member, n.node_id, CAST(CASE WHEN n.node_id = 1 THEN 0 ELSE 1 END AS INTEGER) AS depth,
    CASE WHEN n.node_id = 1 AND m.member <> 0 THEN w2.attr END AS attr, n.node_id <> 1 OR w2.attr IS NULL OR m.member = 0 AS is_leaf
    FROM (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS member) m CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS node_id) n
    LEFT JOIN win w2 ON w2.member = m.member WHERE n.node_id = 1 OR (w2.attr IS NOT NULL AND m.member <> 0)""",
)
def tree_size_limit(spark, sf_dir):
    """A cap of one split node; member 0 has grown a second one and restarts."""
    _, _, splits = _first_split(spark, sf_dir, again=False)
    nodes = ht.apply_splits(ht.root_nodes(spark, TREE_MEMBERS), splits)
    deeper = splits.where(F.col("member") == 0).withColumn("node_id", F.lit(2).cast("long"))
    return ht.tree_size_limit(ht.apply_splits(nodes, deeper), 1).select("member", "node_id", "depth", "attr", "is_leaf")


# -- boosting ----------------------------------------------------------------

FLAGS_SQL = (
    q.INST,
    q.bag("inst", BOOST, SEED),
    q.nb_stats("bag"),
    q.nb_votes("inst", carry=", r.label AS truth"),
    q.argmax("votes", "best", by="instance_id, member", carry=", truth"),
    "flags AS MATERIALIZED (SELECT instance_id AS seq, member, CAST(1.0 AS DOUBLE) AS weight, pred = truth AS ok FROM best)",
)


def _chain_sql(n):
    ctes = ["c0 AS MATERIALIZED (SELECT seq, weight, CAST(1.0 AS DOUBLE) AS lam, sum(weight) OVER (ORDER BY seq) AS tw FROM flags WHERE member = 0)"]
    for m in range(n):
        ctes.append(
            f"""s{m} AS MATERIALIZED (SELECT c.seq, c.weight, c.tw, f.ok, c.lam AS lam_in,
      sum(CASE WHEN f.ok THEN c.lam ELSE 0 END) OVER w AS scms, sum(CASE WHEN f.ok THEN 0 ELSE c.lam END) OVER w AS swms
      FROM c{m} c JOIN flags f ON f.seq = c.seq AND f.member = {m} WINDOW w AS (ORDER BY c.seq))"""
        )
        ctes.append(
            f"c{m + 1} AS MATERIALIZED (SELECT seq, weight, lam_in * tw / (2 * CASE WHEN ok THEN scms ELSE swms END) AS lam, tw FROM s{m})"
        )
    union = " UNION ALL ".join(
        f"SELECT s.seq, CAST({m} AS INTEGER) AS member, s.ok AS correct, s.lam_in, c.lam AS lam_out, s.weight FROM s{m} s JOIN c{m + 1} c USING (seq)"
        for m in range(n)
    )
    return [*ctes, f"chain AS MATERIALIZED ({union})"]


CHAIN_SQL = (*FLAGS_SQL, *_chain_sql(BOOST))
MEMBER_SQL = (
    """bstats AS MATERIALIZED (SELECT member, sum(CASE WHEN correct THEN lam_in ELSE 0 END) AS scms,
      sum(CASE WHEN correct THEN 0 ELSE lam_in END) AS swms, sum(weight) AS tw FROM chain GROUP BY member)""",
    """bweights AS MATERIALIZED (SELECT member, CASE WHEN swms / (scms + swms) = 0 OR swms / (scms + swms) > 0.5 THEN 0
      ELSE ln((1 - swms / (scms + swms)) / (swms / (scms + swms))) END AS weight FROM bstats)""",
)
STATS_SQL = (*CHAIN_SQL, *MEMBER_SQL)


def boost_members(spark, sf_dir):
    """Statistics of the frozen members, which are trained once."""
    return materialize(bag_train(events(spark, sf_dir), events_spec(spark, sf_dir), BOOST, SEED), "boost-members")


def boost_flags(spark, sf_dir, members=None):
    """Whether each frozen member (statistics ``members``, when they are at hand) classifies each event correctly."""
    spec = events_spec(spark, sf_dir)
    model = nb.nb_model(boost_members(spark, sf_dir) if members is None else members, spec)
    flagged = bo.correct_flags(events(spark, sf_dir), model, spec, BOOST)
    return flagged.select("seq", "weight", *[f"correct_{m}" for m in range(BOOST)])


def event_chain(spark, sf_dir, members=None):
    return bo.boost_chain(materialize(boost_flags(spark, sf_dir, members), "boost-flags"), BOOST)


def event_member_weights(spark, sf_dir, members=None):
    stats = bo.boost_member_stats(event_chain(spark, sf_dir, members), BOOST)
    return stats.select("member", vt.boost_member_weight(F.col("scms"), F.col("swms")).alias("weight"))


@query("boost_chain", q.with_(*CHAIN_SQL) + "SELECT seq, member, correct, round(lam_in, 6) AS lam_in, round(lam_out, 6) AS lam_out FROM chain")
def boost_chain(spark, sf_dir):
    rows = bo.chain_long(event_chain(spark, sf_dir), BOOST)
    return rows.select("seq", "member", "correct", F.round("lam_in", 6).alias("lam_in"), F.round("lam_out", 6).alias("lam_out"))


@query("boost_member_stats", q.with_(*STATS_SQL) + "SELECT member, round(scms, 6) AS scms, round(swms, 6) AS swms, tw FROM bstats")
def boost_member_stats(spark, sf_dir):
    s = bo.boost_member_stats(event_chain(spark, sf_dir), BOOST)
    return s.select("member", F.round("scms", 6).alias("scms"), F.round("swms", 6).alias("swms"), "tw")


@query("boost_member_weight", q.with_(*STATS_SQL) + "SELECT member, round(weight, 6) AS weight FROM bweights")
def boost_member_weight(spark, sf_dir):
    return event_member_weights(spark, sf_dir).select("member", F.round("weight", 6).alias("weight"))


def boost_ctes(source, pure):
    """Online boosting as subqueries, one member after the other: ``bt_m`` has the weighted rows, ``bc_m`` the chain."""
    ctes = [f"br0 AS MATERIALIZED (SELECT *, CAST(1.0 AS DOUBLE) AS lam FROM {source})"]
    for m in range(BOOST):
        k = "lam"
        if not pure:
            # Poisson(lam): pieces of at most 16, each by the inverse distribution function.
            u = f"(({q.hash32('instance_id', f'({m} + p * 65536)', SEED)}) / 4294967296.0)"
            share = "(lam / greatest(ceil(lam / 16.0), 1))"
            term = f"exp(i * ln({share}) - {share} - lgamma(i + 1))"
            k = (
                f"list_sum(list_transform(range(0, CAST(greatest(ceil(lam / 16.0), 1) AS BIGINT)), lambda p: "
                f"len(list_filter(range(0, CAST(ceil({share} + sqrt({share}) * 8 + 12) AS BIGINT)), lambda j: "
                f"{u} >= list_sum(list_transform(range(0, j + 1), lambda i: {term}))))))"
            )
        ctes += [
            f"bt{m} AS MATERIALIZED (SELECT *, CAST({m} AS INTEGER) AS member, CAST(weight * {k} AS DOUBLE) AS w FROM br{m})",
            *q.running_votes(f"bt{m}", f"bv{m}", w="w", upto="CURRENT ROW"),
            q.argmax(f"bv{m}", f"bb{m}", by="seq", carry=", truth"),
            f"bf{m} AS (SELECT t.*, b.pred = b.truth AS ok FROM bt{m} t JOIN bb{m} b USING (seq))",
            f"""bc{m} AS MATERIALIZED (SELECT *, lam * tw / (2 * CASE WHEN ok THEN scms ELSE swms END) AS lam_out FROM (
      SELECT *, sum(CASE WHEN ok THEN lam ELSE 0 END) OVER o AS scms, sum(CASE WHEN ok THEN 0 ELSE lam END) OVER o AS swms,
             sum(weight) OVER o AS tw FROM bf{m} WINDOW o AS (ORDER BY seq)))""",
            f"br{m + 1} AS MATERIALIZED (SELECT * EXCLUDE (member, w, ok, scms, swms, tw, lam, lam_out), lam_out AS lam FROM bc{m})",
        ]
    union = " UNION ALL ".join(f"SELECT seq, member, weight, ok AS correct, lam AS lam_in, lam_out FROM bc{m}" for m in range(BOOST))
    return [*ctes, f"chain AS MATERIALIZED ({union})"]


CHAIN_OUT = "SELECT seq, member, correct, round(lam_in, 6) AS lam_in, round(lam_out, 6) AS lam_out FROM chain"


def _boosted(spark, sf_dir, pure):
    run = bo.boost_train(events(spark, sf_dir), events_spec(spark, sf_dir), BOOST, pure=pure, seed=SEED)
    return run.chain.select("seq", "member", "correct", F.round("lam_in", 6).alias("lam_in"), F.round("lam_out", 6).alias("lam_out"))


@query("boost_train", q.with_(q.INST, *boost_ctes("inst", False)) + CHAIN_OUT)
def boost_train(spark, sf_dir):
    """Poisson boosting, instance by instance: what each member saw and decided."""
    return _boosted(spark, sf_dir, pure=False)


@query("boost_pure", q.with_(q.INST, *boost_ctes("inst", True)) + CHAIN_OUT)
def boost_pure(spark, sf_dir):
    """The same with the chained weight itself in place of the draw."""
    return _boosted(spark, sf_dir, pure=True)


@query(
    "tree_train",
    q.with_(
        q.INST,
        f"first AS MATERIALIZED (SELECT * FROM inst WHERE seq < {q.cut(0.5)})",
        q.bag("first", TREE_MEMBERS, SEED),
        *TREE_SQL[2:-1],
        f"second AS MATERIALIZED (SELECT * FROM inst WHERE seq >= {q.cut(0.5)})",
        q.bag("second", TREE_MEMBERS, SEED, name="bag2"),
        f"""tb2 AS MATERIALIZED (SELECT *, {bin_sql('x_cents', TREE.edges['x_cents'])} AS b_cents, {bin_sql('x_k', TREE.edges['x_k'])} AS b_k,
      (SELECT count(*) FROM (SELECT DISTINCT n_user FROM inst) d WHERE d.n_user < bag2.n_user) AS b_user FROM bag2)""",
        """r2 AS MATERIALIZED (SELECT t.*, CASE WHEN w2.attr IS NULL THEN CAST(1 AS BIGINT)
      WHEN (w2.attr = 'x_cents' AND b_cents <= cut) OR (w2.attr = 'x_k' AND b_k <= cut) OR (w2.attr = 'n_user' AND b_user = cut) THEN CAST(2 AS BIGINT)
      ELSE CAST(3 AS BIGINT) END AS node_id FROM tb2 t LEFT JOIN win w2 ON w2.member = t.member)""",
        """seen AS (SELECT member, node_id, label, w FROM r2 UNION ALL
      SELECT t.member, CAST(1 AS BIGINT), t.label, t.w FROM tb t WHERE t.member NOT IN (SELECT member FROM win))""",
    )
    + "SELECT member, node_id, label, sum(w) AS w FROM seen GROUP BY ALL",
)
def tree_train(spark, sf_dir):
    """Trees grown over two batches: what the first batch's leaves saw of the second.

    Roots split after the first batch; a depth of one keeps their children
    leaves, and counts start anew at them.
    """
    half = stream_cut(spark, sf_dir, 0.5)
    base = learner("hoeffding", events_spec(spark, sf_dir), edges=TREE.edges, tie=TREE.tie, grace=TREE.grace, max_depth=1)
    state = bag_stream(events(spark, sf_dir), [half, None], base, TREE_MEMBERS, SEED)
    return state.stats.where(F.col("attr") == nb.CLASS_ATTR).select("member", "node_id", "label", "w")
