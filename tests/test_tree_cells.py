"""Trees trained on cells, their rows added up by bins and label, against training row by row."""

import random

import pytest
from pyspark.sql import functions as F

from polyphon.operators import hoeffding as ht
from polyphon.plans.learners import bag_batches, bag_evaluate, bag_stream, learner
from polyphon.sources.instances import FeatureSpec

SPEC = FeatureSpec(numeric=("x",), nominal={"n": ("p", "q")}, classes=("a", "b"))


def instances(spark, n=1200):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        x, kind = rng.choice([None, float("nan"), *map(float, range(10))]), rng.choice(["p", "q", "new", None])
        label = rng.choice(["a", "b", "other", None]) if i % 10 == 0 else "ab"[(x or 0) > 4]
        # Rows without a number, and rows that come twice.
        rows += [(i, None if i % 50 == 7 else i, rng.choice([0.5, 1.0, 2.0, None]), x, kind, label)] * (2 if i % 9 == 0 else 1)
    return spark.createDataFrame(rows, "instance_id long, seq long, weight double, x double, n string, label string").coalesce(3)


def tree():
    return learner("hoeffding", SPEC, edges={"x": (2.0, 4.0, 6.0)}, grace=20, tie=0.9, max_split_nodes=(1, 100))


def grown(state):
    stats = {tuple(r) for r in state.stats.select(*ht.LEAF_STAT_COLUMNS).collect()}
    return {tuple(map(str, r)) for r in state.nodes.collect()}, stats, state.depth, state.size


def slices(df, *ends):
    return [df.where(F.col("seq") < ends[0]), *(df.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(ends, ends[1:]))]


def test_cells_take_the_way_of_their_rows(spark, monkeypatch):
    batches = slices(instances(spark), 400, 800, 1200)
    counts, route = [], ht.route

    def counted(rows, *args, **kwargs):
        counts.append(rows.count())
        return route(rows, *args, **kwargs)

    monkeypatch.setattr(ht, "route", counted)
    short = grown(bag_batches(batches, tree(), 2, seed=3))
    # Five bins or none by two values or none by two labels, others and none: for two members.
    assert all(c <= 2 * 5 * 3 * 4 for c in counts) and ht.cell_count(SPEC, tree().params) == 5 * 3 * 3
    with monkeypatch.context() as m:
        m.setattr(ht, "BROADCAST_BYTES", 0)
        assert grown(bag_batches(batches, tree(), 2, seed=3)) == short
    monkeypatch.setattr(ht, "CELLS", 0)
    counts.clear()
    assert grown(bag_batches(batches, tree(), 2, seed=3)) == short
    assert min(counts) > 300 and short[2] > 1


@pytest.mark.parametrize("cells", [ht.CELLS, 0])
def test_a_stream_is_its_batches(spark, monkeypatch, cells):
    monkeypatch.setattr(ht, "CELLS", cells)
    df = instances(spark)
    want = grown(bag_batches(slices(df, 400, 400), tree(), 2, seed=3))
    assert grown(bag_stream(df, [F.lit(e) for e in (400, 400)], tree(), 2, seed=3)) == want
    rest = grown(bag_batches([df.where("seq < 500"), df.where("seq >= 500")], tree(), 2, seed=3))
    assert grown(bag_stream(df, [F.lit(500), None], tree(), 2, seed=3)) == rest != want
    empty = bag_stream(df.where("false"), [F.lit(5), None], tree(), 2, seed=3)
    assert empty.size == 2 and empty.depth == 0 and empty.stats.isEmpty()


def test_naive_bayes_takes_the_batches_one_by_one(spark):
    df = instances(spark).where("x = x")
    sums = lambda s: {tuple(map(str, r)) for r in s.collect()}
    want = bag_batches(slices(df, 400, 900), learner("nb", SPEC), 2, seed=3)
    assert sums(bag_stream(df, [F.lit(400), F.lit(900)], learner("nb", SPEC), 2, seed=3)) == sums(want)


def test_instances_are_scored_as_cells(spark, monkeypatch):
    df = instances(spark)
    state = bag_batches([df], tree(), 2, seed=3)
    voted, row_votes = [], ht.row_votes

    def counted(rows, *args, **kwargs):
        voted.append(rows.count())
        return row_votes(rows, *args, **kwargs)

    monkeypatch.setattr(ht, "row_votes", counted)
    score = bag_evaluate(df, tree(), state, SPEC, 2).first()
    monkeypatch.setattr(ht, "CELLS", 0)
    assert bag_evaluate(df, tree(), state, SPEC, 2).first() == score and 0.5 < score.accuracy < 1
    assert voted[0] <= 5 * 3 * 4 < voted[1] == df.count()


def test_each_cell_has_the_values_of_its_bins(spark):
    params = tree().params
    df = instances(spark).withColumn("truth", F.col("label"))
    bins = lambda d: {tuple(r) for r in ht.binned(d, SPEC, params).select("bin_x", "bin_n", "truth").collect()}
    short = ht.alike(df, SPEC, params, "truth", "weight")
    assert bins(short) == bins(df) and short.count() == len(bins(df))
    assert short.agg(F.sum("weight")).first() == df.agg(F.sum("weight")).first()
