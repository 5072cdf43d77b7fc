"""Hoeffding trees as tables: leaf statistics, splits, growth and size limits.

A tree is rows ``member, node_id, depth, attr, op, cut, yes, no, is_leaf, init``. Node 1
is the root, a member's nodes are numbered without gaps in the order in which they
came, and a split node names its children: ``yes`` where the test holds, ``no``
where it doesn't. So depth is not limited by the numbering. An instance's
attributes are whole-number bins: numeric values fall between fixed edges, nominal
values have their place in the header. A numeric split asks ``bin <= cut``, a
nominal one ``bin = cut``. ``init`` has the class weights that a new leaf takes over
from the split that made it, so that it can vote before it has seen anything; its
counts for the next split start from nothing.

All members' trees are one value, an array of node arrays, which reaches the tasks
as a scalar subquery; a row walks it from the root to its leaf in one step, without
a join. Trees above ``BROADCAST_BYTES`` are walked by one join per level.

Rows with the same bins and label take the same way in any tree, so training adds
them up to one row, their cell, before they are routed. How many cells there can be
is known from the header; above ``CELLS`` a member the rows are routed one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from polyphon.functions.sqlexpr import add, name, text
from polyphon.operators.lookup import BROADCAST_BYTES, model_join
from polyphon.operators.naive_bayes import CLASS_ATTR
from polyphon.operators.scoring import gathered, let
from polyphon.operators.streams import ensemble_fanout
from polyphon.operators.votes import vote_cols
from polyphon.sources.instances import FeatureSpec

NODE_SCHEMA = "member int, node_id long, depth int, attr string, op string, cut int, yes long, no long, is_leaf boolean, init array<double>"
LEAF_STAT_COLUMNS = ["member", "node_id", "attr", "bin", "label", "w"]
# Up to this many possible cells, a member's rows are added up to them before they are routed.
CELLS = 1 << 16


@dataclass(frozen=True)
class TreeParams:
    """Options of the tree learner.

    ``edges`` gives each numeric attribute's bin edges. ``max_split_nodes`` is one cap
    for all members or a cap per member; members beyond the list take its last one.
    """

    edges: dict[str, tuple[float, ...]] = field(default_factory=dict)
    delta: float = 1e-7
    tie: float = 0.05
    grace: float = 200.0
    max_depth: int | None = None
    max_split_nodes: int | tuple[int, ...] | None = None


def binned(instances: DataFrame, spec: FeatureSpec, params: TreeParams) -> DataFrame:
    """Add ``bin_<attr>`` for every attribute."""
    out = instances
    for a in spec.numeric:
        b = F.lit(0)
        for e in params.edges[a]:
            b = b + F.when(F.col(a) > F.lit(float(e)), 1).otherwise(0)
        out = out.withColumn(f"bin_{a}", F.when(F.col(a).isNotNull(), b))
    for a, values in spec.nominal.items():
        idx = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(a))
        out = out.withColumn(f"bin_{a}", F.when(idx > 0, (idx - 1).cast("int")))
    return out


def cell_count(spec: FeatureSpec, params: TreeParams) -> int:
    """How many cells one member's rows can have: a label and, for each attribute, a bin or none."""
    bins = [*(len(params.edges[a]) + 2 for a in spec.numeric), *(len(v) + 1 for v in spec.nominal.values())]
    return math.prod(bins) * (len(spec.classes) + 1)


def cells(rows: DataFrame, spec: FeatureSpec, weight: str = "w", keys: tuple[str, ...] = ("member",)) -> DataFrame:
    """Binned rows with equal ``keys``, bins and label as one row with their whole weight ``w``.

    Equal rows add up inside the task first, so what is shuffled depends on the
    number of cells and not on that of the rows. ``cell`` hashes the bins.
    """
    bins = [f"bin_{a}" for a in [*spec.numeric, *spec.nominal]]
    summed = rows.groupBy(*keys, *bins, spec.label).agg(F.sum(weight).alias("w"))
    return summed.withColumn("cell", F.xxhash64(*bins, spec.label))


def alike(instances: DataFrame, spec: FeatureSpec, params: TreeParams, key: str, weight: str) -> DataFrame:
    """Instances with equal bins and ``key`` as one, with their whole weight.

    It has the smallest id and the smallest value of each attribute; a bin holds
    neighbouring values, so that value falls into the same bin as theirs.
    """
    attrs = [*spec.numeric, *spec.nominal]
    rows = binned(instances, spec, params)
    return (
        rows.groupBy(key, *[f"bin_{a}" for a in attrs])
        .agg(F.min("instance_id").alias("instance_id"), F.sum(weight).alias(weight), *[F.min(a).alias(a) for a in attrs])
        .select("instance_id", key, weight, *attrs)
    )


def root_nodes(spark: SparkSession, ensemble: int) -> DataFrame:
    """An empty tree for each member."""
    return spark.range(ensemble).select(
        F.col("id").cast("int").alias("member"), F.lit(1).cast("long").alias("node_id"), F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("attr"), F.lit(None).cast("string").alias("op"),
        F.lit(None).cast("int").alias("cut"), F.lit(None).cast("long").alias("yes"), F.lit(None).cast("long").alias("no"), F.lit(True).alias("is_leaf"),
        F.lit(None).cast("array<double>").alias("init"),
    )


def trees_value(nodes: DataFrame, spec: FeatureSpec, leaves: DataFrame | None = None) -> DataFrame:
    """One row, one column: ``member`` and its nodes in the order of their numbers, by member.

    A node has the place of its attribute (null in a leaf), the test and its children.
    With ``leaves`` (``member, node_id`` and a vote vector) it has the vector too, zero
    where the leaf saw nothing.
    """
    attrs = ", ".join(text(a) for a in [*spec.numeric, *spec.nominal])
    fields = {"node_id": "node_id", "a": f"cast(nullif(array_position(array({attrs}), attr), 0) AS INT)", "le": "op = 'le'", "cut": "cut", "yes": "yes", "no": "no"}
    if leaves is not None:
        nodes = nodes.join(leaves, ["member", "node_id"], "left")
        fields["v"] = f"array({', '.join(f'coalesce({v}, 0D)' for v in vote_cols(len(spec.classes)))})"
    node = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    by_number = "array_sort(collect_list(n), (a, b) -> if(a.node_id < b.node_id, -1, 1))"
    by_member = nodes.selectExpr("member", f"{node} AS n").groupBy("member").agg(F.expr(f"{by_number} AS nodes"))
    return by_member.agg(F.expr("array_sort(collect_list(struct(member, nodes)), (a, b) -> a.member - b.member) AS trees"))


def _walk(tree: str, bins: str, depth: int) -> str:
    """Number of the leaf (SQL text) that the bins reach in an array of nodes; a missing value takes the second branch."""
    if depth == 0:
        return "1L"
    at = f"{tree}[cast(n AS INT) - 1]"
    value = f"{bins}[{at}.a - 1]"
    holds = f"coalesce(if({at}.le, {value} <= {at}.cut, {value} = {at}.cut), false)"
    return f"aggregate(sequence(1, {depth}), 1L, (n, level) -> if({at}.a IS NULL, n, if({holds}, {at}.yes, {at}.no)))"


def _bins(spec: FeatureSpec) -> str:
    return f"array({', '.join(name(f'bin_{a}') for a in [*spec.numeric, *spec.nominal])})"


def route(rows: DataFrame, nodes: DataFrame, spec: FeatureSpec, depth: int, node_bytes: int, spread_by: str = "instance_id") -> DataFrame:
    """Leaf of each (instance, member) row, or cell, as ``node_id``.

    ``depth`` is the depth of the deepest leaf; ``node_bytes`` bounds the node
    table's size. ``spread_by`` tells a member's rows apart.
    """
    if node_bytes > BROADCAST_BYTES:
        return _route_by_joins(rows, nodes, spec, depth, node_bytes, spread_by)
    held = rows.withColumn("_trees", trees_value(nodes, spec).scalar())
    own = "filter(_trees, m -> m.member = member)[0].nodes"
    return add(held, {"node_id": let("t", own, let("b", _bins(spec), _walk("t", "b", depth)))}).drop("_trees")


def _route_by_joins(rows: DataFrame, nodes: DataFrame, spec: FeatureSpec, depth: int, node_bytes: int, spread_by: str) -> DataFrame:
    """The same for trees that are too large for one value: one join with the split nodes per level."""
    splits = nodes.where(~F.col("is_leaf")).select("member", "node_id", F.struct("attr", "op", "cut", "yes", "no").alias("_test"))
    out = rows.withColumn("node_id", F.lit(1).cast("long"))
    for _ in range(depth):
        out = model_join(out, splits, ["member", "node_id"], node_bytes, spread_by, how="left")
        value = F.lit(None).cast("int")
        for a in [*spec.numeric, *spec.nominal]:
            value = F.when(F.col("_test.attr") == a, F.col(f"bin_{a}")).otherwise(value)
        holds = F.when(F.col("_test.op") == "le", value <= F.col("_test.cut")).otherwise(value == F.col("_test.cut"))
        child = F.when(F.coalesce(holds, F.lit(False)), F.col("_test.yes")).otherwise(F.col("_test.no"))
        out = out.withColumn("node_id", F.when(F.col("_test").isNull(), F.col("node_id")).otherwise(child)).drop("_test")
    return out


def leaf_stats(routed: DataFrame, spec: FeatureSpec, weight: str = "w") -> DataFrame:
    """Weighted counts per (member, leaf, attribute, bin, label).

    Attribute ``#class`` (bin 0) holds the leaf's class weights.
    Each row becomes one row per attribute inside the task; equal cells add up
    before the shuffle.
    """
    attrs = [F.struct(F.lit(a).alias("attr"), F.col(f"bin_{a}").alias("bin")) for a in [*spec.numeric, *spec.nominal]]
    cells = F.explode(F.array(F.struct(F.lit(CLASS_ATTR).alias("attr"), F.lit(0).alias("bin")), *attrs))
    return (
        routed.select("member", "node_id", F.col(spec.label).alias("label"), F.col(weight).alias("_w"), cells.alias("c"))
        .where(F.col("c.bin").isNotNull())
        .groupBy("member", "node_id", F.col("c.attr").alias("attr"), F.col("c.bin").alias("bin"), "label")
        .agg(F.sum("_w").alias("w"))
    )


def merge_leaf_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("member", "node_id", "attr", "bin", "label").agg(F.sum("w").alias("w"))


def _entropy(sums: Column, plogp: Column) -> Column:
    """Entropy in bits from Σw and Σ w·log2 w."""
    return F.when(sums > 0, F.log2(sums) - plogp / sums).otherwise(F.lit(0.0))


def _wlogw(w: Column) -> Column:
    return F.when(w > 0, w * F.log2(w)).otherwise(F.lit(0.0))


def split_candidates(stats: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Information gain of every possible cut of every leaf.

    Works on leaf statistics only: one row per (leaf, attribute, bin), with the
    class weights side by side. A cut's left side holds bins up to the cut
    (numeric), as running sums over the bins in order, or the cut's own bin
    (nominal); what is left of the totals is the right side.
    """
    numeric = F.col("attr").isin(list(spec.numeric)) if spec.numeric else F.lit(False)
    own = [f"_own_{i}" for i in range(len(spec.classes))]
    by_bin = stats.where(F.col("attr") != CLASS_ATTR).groupBy("member", "node_id", "attr", F.col("bin").alias("cut"))
    by_bin = by_bin.agg(*[F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0)).alias(o) for o, c in zip(own, spec.classes)])
    leaf = Window.partitionBy("member", "node_id", "attr")
    upto = leaf.orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = by_bin.select(
        "member", "node_id", "attr", "cut", *[F.sum(o).over(leaf).alias(f"_t{o}") for o in own],
        *[F.when(numeric, F.sum(o).over(upto)).otherwise(F.col(o)).alias(f"_l{o}") for o in own],
    )
    total, left = [F.col(f"_t{o}") for o in own], [F.col(f"_l{o}") for o in own]
    right = [t - x for t, x in zip(total, left)]
    summed = lambda columns: reduce(lambda x, y: x + y, columns)
    g = sides.select(
        "member", "node_id", "attr", "cut",
        F.array(*left).alias("left"), F.array(*right).alias("right"),
        *[summed(c).alias(n) for n, c in (("n", total), ("nl", left), ("nr", right))],
        *[summed([_wlogw(x) for x in c]).alias(n) for n, c in (("ht", total), ("hl", left), ("hr", right))],
    )
    gain = (
        _entropy(F.col("n"), F.col("ht"))
        - F.col("nl") / F.col("n") * _entropy(F.col("nl"), F.col("hl"))
        - F.col("nr") / F.col("n") * _entropy(F.col("nr"), F.col("hr"))
    )
    # A cut that leaves one side empty splits nothing.
    return (
        g.where((F.col("nl") > 0) & (F.col("nr") > 0))
        .withColumn("gain", F.round(gain, 9))
        .withColumn("op", F.when(numeric, F.lit("le")).otherwise(F.lit("eq")))
        .select("member", "node_id", "attr", "op", "cut", "n", "gain", "left", "right")
    )


def hoeffding_bound(n: Column, classes: int, delta: float) -> Column:
    value_range = math.log2(max(classes, 2))
    return F.sqrt(F.lit(value_range * value_range * math.log(1.0 / delta)) / (2 * n))


def tree_split(stats: DataFrame, spec: FeatureSpec, params: TreeParams) -> DataFrame:
    """Leaves that split now, with the chosen test.

    The best cut of each attribute competes with the best of the others. The
    leaf splits when their gap exceeds the Hoeffding bound, or the bound is
    below the tie threshold. Equal gains go to the attribute, then the cut, that
    comes first. ``left`` and ``right`` are the class weights on the two sides of it;
    rows that lack the attribute are on neither.
    """
    best_cut = (
        split_candidates(stats, spec)
        .groupBy("member", "node_id", "attr")
        .agg(F.max_by(F.struct("op", "cut", "n", "gain", "left", "right"), F.struct(F.col("gain"), -F.col("cut"))).alias("b"))
        .select("member", "node_id", "attr", "b.*")
    )
    w = Window.partitionBy("member", "node_id").orderBy(F.col("gain").desc(), F.col("attr"))
    ranked = best_cut.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2)
    per_leaf = ranked.groupBy("member", "node_id").agg(
        F.max_by(F.struct("attr", "op", "cut", "n", "gain", "left", "right"), -F.col("rank")).alias("b"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("gain"))), F.lit(0.0)).alias("second_gain"),
    )
    flat = per_leaf.select("member", "node_id", "b.*", "second_gain").withColumn(
        "bound", hoeffding_bound(F.col("n"), len(spec.classes), params.delta)
    )
    wins = ((F.col("gain") - F.col("second_gain")) > F.col("bound")) | (F.col("bound") < params.tie)
    return flat.where((F.col("n") >= params.grace) & (F.col("gain") > 0) & wins)


def apply_splits(nodes: DataFrame, splits: DataFrame) -> DataFrame:
    """The tree after its leaves in ``splits`` became split nodes with two leaves.

    A member's new leaves are numbered on from its last node, in the order of the
    leaves that they come from. What is ranked is one member's splits of one batch.
    """
    s = splits.selectExpr("member", "node_id", "attr AS _a", "op AS _o", "cut AS _c", "left AS _l", "right AS _r")
    own = Window.partitionBy("member")
    j = nodes.join(s, ["member", "node_id"], "left")
    j = j.withColumn("_top", F.max("node_id").over(own)).withColumn("_nth", F.count("_a").over(own.orderBy("node_id")))
    j = j.withColumn("_yes", F.when(F.col("_a").isNotNull(), F.col("_top") + 2 * F.col("_nth") - 1))
    # A split node keeps nothing of what its leaf took over.
    node = (
        "named_struct('node_id', node_id, 'depth', depth, 'attr', coalesce(_a, attr), 'op', coalesce(_o, op), 'cut', coalesce(_c, cut), "
        "'yes', coalesce(_yes, yes), 'no', coalesce(_yes + 1, no), 'is_leaf', is_leaf AND _a IS NULL, 'init', if(_a IS NULL, init, NULL))"
    )
    nothing = "'attr', cast(NULL AS STRING), 'op', cast(NULL AS STRING), 'cut', cast(NULL AS INT), 'yes', cast(NULL AS LONG), 'no', cast(NULL AS LONG), 'is_leaf', true"
    child = f"named_struct('node_id', _yes + {{}}, 'depth', depth + 1, {nothing}, 'init', {{}})".format
    return j.selectExpr("member", f"inline(if(_a IS NULL, array({node}), array({node}, {child(0, '_l')}, {child(1, '_r')})))")


def tree_size_limit(nodes: DataFrame, max_split_nodes: int | tuple[int, ...]) -> DataFrame:
    """Members over their cap restart from an empty root; the others stay as they are."""
    caps = (max_split_nodes,) if isinstance(max_split_nodes, int) else max_split_nodes
    cap = F.element_at(F.array(*[F.lit(c) for c in caps]), F.least(F.col("member") + 1, F.lit(len(caps))))
    splits = F.count_if(~F.col("is_leaf")).over(Window.partitionBy("member"))
    flagged = nodes.withColumn("_full", splits > cap)
    keep = flagged.where(~F.col("_full") | (F.col("node_id") == 1))
    reset = F.col("_full")
    return keep.select(
        "member", "node_id", "depth", *[F.when(~reset, F.col(c)).alias(c) for c in ("attr", "op", "cut", "yes", "no")],
        (reset | F.col("is_leaf")).alias("is_leaf"), F.when(~reset, F.col("init")).alias("init"),
    )


def leaf_vectors(stats: DataFrame, spec: FeatureSpec, nodes: DataFrame | None = None) -> DataFrame:
    """Class weights of every leaf that saw something, as a vote vector; with ``nodes``, what leaves took over counts too."""
    per_class = [F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0)) for c in spec.classes]
    votes = vote_cols(len(spec.classes))
    seen = stats.where(F.col("attr") == CLASS_ATTR).groupBy("member", "node_id").agg(*[c.alias(v) for c, v in zip(per_class, votes)])
    if nodes is None:
        return seen
    taken = nodes.where("is_leaf AND init IS NOT NULL").select("member", "node_id", *[F.col("init")[i].alias(v) for i, v in enumerate(votes)])
    return seen.unionByName(taken).groupBy("member", "node_id").agg(*[F.sum(v).alias(v) for v in votes])


def leaf_votes(routed: DataFrame, stats: DataFrame, spec: FeatureSpec, node_bytes: int, nodes: DataFrame | None = None) -> DataFrame:
    """Vote vector of a tree member: class weights at the instance's leaf (``leaf_vectors``).

    A leaf that has none votes zero everywhere.
    """
    out = model_join(routed, leaf_vectors(stats, spec, nodes), ["member", "node_id"], node_bytes, "instance_id", how="left")
    return out.withColumns({v: F.coalesce(v, F.lit(0.0)) for v in vote_cols(len(spec.classes))})


def row_votes(
    instances: DataFrame, nodes: DataFrame, stats: DataFrame, spec: FeatureSpec, params: TreeParams, ensemble: int, depth: int, node_bytes: int
) -> DataFrame:
    """Adds ``votes``: ``member`` and vote vector ``v`` of every member, in member order, on the instance's own row."""
    kept = [name(c) for c in instances.columns]
    rows = binned(instances, spec, params)
    if node_bytes > BROADCAST_BYTES:
        numbered = ensemble_fanout(add(rows, {"_row": "monotonically_increasing_id()"}), ensemble)
        routed = route(numbered, nodes, spec, depth, node_bytes)
        return gathered(leaf_votes(routed, stats, spec, node_bytes, nodes), len(spec.classes), instances.columns)
    held = rows.withColumn("_trees", trees_value(nodes, spec, leaf_vectors(stats, spec, nodes)).scalar())
    leaf = f"m.nodes[cast({_walk('m.nodes', 'b', depth)} AS INT) - 1].v"
    votes = let("b", _bins(spec), f"transform(_trees, m -> named_struct('member', m.member, 'v', {leaf}))")
    return held.selectExpr(*kept, f"{votes} AS votes")
