"""Queries of tree ensembles that grow over several batches, under a size limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from polyphon.plans import sqltext as q
from polyphon.plans.common import ENSEMBLE, SEED, events, events_spec, stream_cut, test_rows
from polyphon.plans.learners import HoeffdingTrees, TreeState, bag_evaluate, bag_stream, learner
from polyphon.plans.registry import query
from polyphon.plans.training_queries import TREE, bin_sql
from polyphon.plans.vote_queries import METRIC_SQL, rounded

# Ends of the batches, as shares of the stream; what follows the last one is held out.
BATCH_ENDS = (0.16, 0.32, 0.48, 0.64, 0.8)
# Each member's tree may be twice as large as the one's before.
CAPS = tuple(2 ** (m + 2) - 1 for m in range(ENSEMBLE))

BINS = ("b_cents", "b_k", "b_user")
ATTRS = dict(zip(BINS, ("x_cents", "x_k", "n_user")))
HOLDS = "((n.attr = 'x_cents' AND r.b_cents <= n.cut) OR (n.attr = 'x_k' AND r.b_k <= n.cut) OR (n.attr = 'n_user' AND r.b_user = n.cut))"


def _walk_sql(source: str, nodes: str, name: str, depth: int) -> list[str]:
    """Steps that take the rows of ``source`` (with ``member`` and bins) down to their leaves; the last one is ``name``."""
    steps = [f"{name}_0 AS (SELECT *, CAST(1 AS BIGINT) AS node_id FROM {source})"]
    for i in range(1, depth + 1):
        steps.append(
            f"{name}_{i} AS (SELECT r.* EXCLUDE (node_id), CASE WHEN n.is_leaf THEN r.node_id WHEN {HOLDS} THEN n.yes ELSE n.no END AS node_id"
            f" FROM {name}_{i - 1} r JOIN {nodes} n ON n.member = r.member AND n.node_id = r.node_id)"
        )
    return [*steps, f"{name} AS MATERIALIZED (SELECT * FROM {name}_{depth})"]


def _batch_sql(b: int) -> list[str]:
    """One batch: route, add up, split, number the new leaves, restart trees over their cap."""
    cells = f"member, node_id, {', '.join(BINS)}, label, w"
    before = f"SELECT {cells} FROM k{b - 1} UNION ALL " if b > 1 else ""
    by_attr = " UNION ALL ".join(f"SELECT member, node_id, '{a}' AS attr, {c} AS bin, label, w FROM s{b}" for c, a in ATTRS.items())
    classes = "log2((SELECT count(DISTINCT label) FROM inst))"
    caps = " ".join(f"WHEN {m} THEN {c}" for m, c in enumerate(CAPS))
    empty = "CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)"
    return [
        *_walk_sql(f"(SELECT * FROM tg WHERE batch = {b})", f"n{b - 1}", f"t{b}", b - 1),
        f"s{b} AS MATERIALIZED (SELECT member, node_id, {', '.join(BINS)}, label, sum(w) AS w FROM ({before}SELECT {cells} FROM t{b}) GROUP BY ALL)",
        f"a{b} AS MATERIALIZED (SELECT member, node_id, attr, bin, label, sum(w) AS w FROM ({by_attr}) GROUP BY ALL)",
        f"""l{b} AS MATERIALIZED (SELECT c.member, c.node_id, c.attr, c.cut, t.label, sum(t.w) AS t,
          sum(CASE WHEN (t.attr = 'n_user' AND t.bin = c.cut) OR (t.attr <> 'n_user' AND t.bin <= c.cut) THEN t.w ELSE 0 END) AS l
          FROM (SELECT DISTINCT member, node_id, attr, bin AS cut FROM a{b}) c JOIN a{b} t USING (member, node_id, attr) GROUP BY ALL)""",
        f"""z{b} AS MATERIALIZED (SELECT member, node_id, attr, cut, sum(t) AS n, sum(l) AS nl, sum(t - l) AS nr,
          sum(CASE WHEN t > 0 THEN t * log2(t) ELSE 0 END) AS ht, sum(CASE WHEN l > 0 THEN l * log2(l) ELSE 0 END) AS hl,
          sum(CASE WHEN t - l > 0 THEN (t - l) * log2(t - l) ELSE 0 END) AS hr FROM l{b} GROUP BY ALL)""",
        f"""g{b} AS MATERIALIZED (SELECT *, round((log2(n) - ht / n) - nl / n * (log2(nl) - hl / nl) - nr / n * (log2(nr) - hr / nr), 9) AS gain
          FROM z{b} WHERE nl > 0 AND nr > 0)""",
        f"b{b} AS (SELECT *, row_number() OVER (PARTITION BY member, node_id, attr ORDER BY gain DESC, cut) AS rc FROM g{b})",
        f"""r{b} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY member, node_id ORDER BY gain DESC, attr) AS ra,
          sqrt({classes} * {classes} * ln(1 / {TREE.delta!r}) / (2 * n)) AS bound FROM b{b} WHERE rc = 1)""",
        f"""w{b} AS MATERIALIZED (SELECT x.member, x.node_id, x.attr, x.cut, row_number() OVER (PARTITION BY x.member ORDER BY x.node_id) AS nth
          FROM r{b} x LEFT JOIN r{b} y ON y.member = x.member AND y.node_id = x.node_id AND y.ra = 2
          WHERE x.ra = 1 AND x.n >= {TREE.grace} AND x.gain > 0 AND (x.gain - coalesce(y.gain, 0) > x.bound OR x.bound < {TREE.tie}))""",
        f"""j{b} AS MATERIALIZED (SELECT n.*, w.attr AS wa, w.cut AS wc, (SELECT max(m.node_id) FROM n{b - 1} m WHERE m.member = n.member) + 2 * w.nth - 1 AS wy
          FROM n{b - 1} n LEFT JOIN w{b} w ON w.member = n.member AND w.node_id = n.node_id)""",
        f"""p{b} AS MATERIALIZED (SELECT member, node_id, depth, coalesce(wa, attr) AS attr, CASE WHEN wa = 'n_user' THEN 'eq' WHEN wa IS NOT NULL THEN 'le' ELSE op END AS op,
          coalesce(wc, cut) AS cut, coalesce(wy, yes) AS yes, coalesce(wy + 1, no) AS no, is_leaf AND wa IS NULL AS is_leaf FROM j{b}
          UNION ALL SELECT member, wy + c.side, depth + 1, {empty}, true FROM j{b}, (SELECT unnest([0, 1]) AS side) c WHERE wa IS NOT NULL)""",
        f"f{b} AS (SELECT member, count(*) FILTER (WHERE NOT is_leaf) > CASE member {caps} END AS is_full FROM p{b} GROUP BY member)",
        f"""n{b} AS MATERIALIZED (SELECT p.* FROM p{b} p JOIN f{b} f USING (member) WHERE NOT f.is_full
          UNION ALL SELECT member, 1, 0, {empty}, true FROM f{b} WHERE is_full)""",
        f"""i{b} AS MATERIALIZED (SELECT x.* FROM i{b - 1} x JOIN n{b} n USING (member, node_id) JOIN f{b} f USING (member) WHERE n.is_leaf AND NOT f.is_full
          UNION ALL SELECT j.member, j.wy + c.side, l.label, CASE c.side WHEN 0 THEN l.l ELSE l.t - l.l END FROM j{b} j JOIN f{b} f USING (member)
          JOIN l{b} l ON l.member = j.member AND l.node_id = j.node_id AND l.attr = j.wa AND l.cut = j.wc, (SELECT unnest([0, 1]) AS side) c WHERE NOT f.is_full)""",
        f"k{b} AS MATERIALIZED (SELECT s.* FROM s{b} s JOIN n{b - 1} o USING (member, node_id) JOIN n{b} n USING (member, node_id) WHERE o.is_leaf AND n.is_leaf)",
    ]


GROWTH_SQL = (
    q.INST,
    "uv AS MATERIALIZED (SELECT n_user, row_number() OVER (ORDER BY n_user) - 1 AS b_user FROM (SELECT DISTINCT n_user FROM inst))",
    f"""binned AS MATERIALIZED (SELECT i.*, uv.b_user, {bin_sql('x_cents', TREE.edges['x_cents'])} AS b_cents, {bin_sql('x_k', TREE.edges['x_k'])} AS b_k,
      CASE {' '.join(f'WHEN seq < {q.cut(s)} THEN {b}' for b, s in enumerate(BATCH_ENDS, 1))} END AS batch FROM inst i JOIN uv USING (n_user))""",
    "known AS (SELECT * FROM binned WHERE batch IS NOT NULL)",
    q.bag("known", ENSEMBLE, SEED),
    f"tg AS MATERIALIZED (SELECT batch, member, {', '.join(BINS)}, label, sum(w) AS w FROM bag GROUP BY ALL)",
    f"""n0 AS MATERIALIZED (SELECT member, CAST(1 AS BIGINT) AS node_id, 0 AS depth, CAST(NULL AS VARCHAR) AS attr, CAST(NULL AS VARCHAR) AS op,
      CAST(NULL AS BIGINT) AS cut, CAST(NULL AS BIGINT) AS yes, CAST(NULL AS BIGINT) AS no, true AS is_leaf FROM {q.members(ENSEMBLE)})""",
    "i0 AS (SELECT member, node_id, CAST(NULL AS VARCHAR) AS label, CAST(0 AS DOUBLE) AS w FROM n0 WHERE false)",
    *(step for b in range(1, len(BATCH_ENDS) + 1) for step in _batch_sql(b)),
)
LAST = len(BATCH_ENDS)


def _grown(spark: SparkSession, sf_dir: str) -> tuple[HoeffdingTrees, TreeState]:
    ends = [stream_cut(spark, sf_dir, s) for s in BATCH_ENDS]
    base = learner("hoeffding", events_spec(spark, sf_dir), edges=TREE.edges, tie=TREE.tie, grace=TREE.grace, max_split_nodes=CAPS)
    return base, bag_stream(events(spark, sf_dir), ends, base, ENSEMBLE, SEED)


@query(
    "tree_growth",
    q.with_(*GROWTH_SQL)
    + f"""SELECT member, node_id, CAST(depth AS INTEGER) AS depth, attr, op, CAST(cut AS INTEGER) AS cut, CAST(yes AS BIGINT) AS yes, CAST(no AS BIGINT) AS no, is_leaf,
    coalesce((SELECT sum(w) FROM k{LAST} k WHERE k.member = n.member AND k.node_id = n.node_id), 0) AS seen,
    coalesce((SELECT sum(w) FROM i{LAST} i WHERE i.member = n.member AND i.node_id = n.node_id), 0) AS taken FROM n{LAST} n""",
)
def tree_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of a bagged ensemble of size-limited trees after five batches, with the weight each leaf has seen and taken over."""
    _, state = _grown(spark, sf_dir)
    seen = state.stats.where(F.col("attr") == "#class").groupBy("member", "node_id").agg(F.sum("w").alias("seen"))
    taken = F.aggregate(F.coalesce("init", F.array().cast("array<double>")), F.lit(0.0), lambda total, w: total + w)
    joined = state.nodes.join(seen, ["member", "node_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(0.0)))
    return joined.withColumn("taken", taken).drop("init")


@query(
    "tree_holdout",
    q.with_(
        *GROWTH_SQL,
        f"cells AS (SELECT DISTINCT m.member, {', '.join(BINS)} FROM binned, {q.members(ENSEMBLE)} m WHERE batch IS NULL)",
        *_walk_sql("cells", f"n{LAST}", "fell", LAST),
        f"leaf AS (SELECT member, node_id, label, sum(w) AS w, sum(sum(w)) OVER (PARTITION BY member, node_id) AS total FROM (SELECT member, node_id, label, w FROM k{LAST} UNION ALL SELECT * FROM i{LAST}) GROUP BY member, node_id, label)",
        f"votes AS MATERIALIZED (SELECT {', '.join(BINS)}, label, sum(w / total) AS vote FROM fell JOIN leaf USING (member, node_id) GROUP BY ALL)",
        q.argmax("votes", "best", by=", ".join(BINS)),
        f"pr AS MATERIALIZED (SELECT pred, label AS truth, weight FROM binned JOIN best USING ({', '.join(BINS)}) WHERE batch IS NULL)",
    )
    + METRIC_SQL,
)
def tree_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ensemble, scored on the events after the last batch."""
    base, state = _grown(spark, sf_dir)
    return rounded(bag_evaluate(test_rows(spark, sf_dir), base, state, events_spec(spark, sf_dir), ENSEMBLE))
