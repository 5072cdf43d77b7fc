"""Trees of several levels: growth, numbering, walking, caps and votes against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from polyphon.operators import hoeffding as ht
from polyphon.operators import streams as st
from polyphon.plans.learners import bag_batches, learner
from polyphon.sources.instances import FeatureSpec

SPEC = FeatureSpec(numeric=("x", "y"), nominal={"n": ("p", "q")}, classes=("a", "b"))
EDGES = {"x": (2.0, 4.0, 6.0), "y": (2.0, 4.0, 6.0)}


def instances(spark, n=1500):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        x, y = (rng.choice([None, *range(10)]) for _ in "xy")
        label = "a" if ((x or 0) <= 4) != ((y or 0) <= 4) else "b"
        rows.append((i, i, 1.0, None if x is None else float(x), None if y is None else float(y), rng.choice(["p", "q", None]), label))
    return spark.createDataFrame(rows, "instance_id long, seq long, weight double, x double, y double, n string, label string").coalesce(2)


def leaf_of(nodes, member, bins):
    at = nodes[member, 1]
    while at.attr is not None:
        value = bins[at.attr]
        holds = value is not None and (value <= at.cut if at.op == "le" else value == at.cut)
        at = nodes[member, at.yes if holds else at.no]
    return at


def test_deep_trees_number_walk_and_vote(spark, monkeypatch):
    df = instances(spark)
    batches = [df.where(f"seq % 3 = {i}") for i in range(3)]
    tree = learner("hoeffding", SPEC, edges=EDGES, grace=20, tie=0.9, max_split_nodes=(1, 100))
    state = bag_batches(batches, tree, 2, seed=3)
    nodes = {(r.member, r.node_id): r for r in state.nodes.collect()}
    assert state.size == len(nodes) and state.depth == max(r.depth for r in nodes.values()) == 3
    for member in (0, 1):
        own = sorted(n for m, n in nodes if m == member)
        assert own == list(range(1, len(own) + 1))  # no gaps, also after a restart
    assert sum(not r.is_leaf for (m, _), r in nodes.items() if m == 0) <= 1 < sum(not r.is_leaf for (m, _), r in nodes.items() if m == 1)
    children = [c for r in nodes.values() if not r.is_leaf for c in ((r.member, r.yes), (r.member, r.no))]
    assert sorted(children) == sorted(k for k in nodes if k[1] > 1)
    assert all(r.init is None for r in nodes.values() if not r.is_leaf)

    fanned = ht.binned(st.ensemble_fanout(df, 2), SPEC, tree.params)
    walked = {(r.instance_id, r.member): r.node_id for r in ht.route(fanned, state.nodes, SPEC, state.depth, 1000).collect()}
    for r in fanned.collect():
        bins = {a: r[f"bin_{a}"] for a in ("x", "y", "n")}
        assert walked[r.instance_id, r.member] == leaf_of(nodes, r.member, bins).node_id
    joined = ht.route(fanned, state.nodes, SPEC, state.depth, 1 << 40)
    assert {(r.instance_id, r.member): r.node_id for r in joined.collect()} == walked

    counts = {}
    for r in state.stats.where("attr = '#class'").collect():
        counts.setdefault((r.member, r.node_id), [0.0, 0.0])["ab".index(r.label)] += r.w
    want = {}
    for k, r in nodes.items():
        seen, taken = counts.get(k, [0.0, 0.0]), r.init or [0.0, 0.0]
        want[k] = [a + b for a, b in zip(seen, taken)]
    votes = {r.instance_id: [(z.member, z.v) for z in r.votes] for r in tree.row_votes(df, state, 2).collect()}
    assert votes == {i: [(m, want[m, walked[i, m]]) for m in (0, 1)] for i in range(1500)}
    # The same votes when the trees are too large for one value.
    monkeypatch.setattr(ht, "BROADCAST_BYTES", 0)
    assert {r.instance_id: [(z.member, z.v) for z in r.votes] for r in tree.row_votes(df, state, 2).collect()} == votes


def test_new_leaves_vote_with_their_side_of_the_split(spark):
    df = instances(spark).where("x IS NOT NULL AND y IS NOT NULL AND n IS NOT NULL").withColumn("label", F.expr("if(x <= 4, 'a', 'b')"))
    tree = learner("hoeffding", SPEC, edges=EDGES, grace=20)
    state = tree.train(df.withColumn("member", F.lit(0)).withColumn("w", F.col("weight")), None, 1)
    found = {r.node_id: r for r in state.nodes.collect()}
    assert (found[1].attr, found[1].yes, found[1].no) == ("x", 2, 3) and state.stats.isEmpty()
    sides = [df.where("x <= 4").count(), df.where("x > 4").count()]
    assert found[2].init == [sides[0], 0.0] and found[3].init == [0.0, sides[1]]


def test_no_instances_and_unknown_values(spark):
    empty = instances(spark, 1).where("false")
    tree = learner("hoeffding", SPEC, edges=EDGES)
    state = bag_batches([empty, empty], tree, 3, seed=1)
    assert state.size == 3 and state.depth == 0 and state.stats.isEmpty()
    lone = spark.createDataFrame([(1, None, None, "other")], "instance_id long, x double, y double, n string")
    assert [z.v for z in tree.row_votes(lone, state, 3).first().votes] == [[0.0, 0.0]] * 3
    with pytest.raises(ValueError):
        learner("hoeffding", SPEC, leaves=3)
