"""Votes worked out in columns equal the folds over arrays, also with members and attributes missing."""

import random

import pytest
from pyspark.sql import functions as F

from polyphon.operators import boosting as bo
from polyphon.operators import naive_bayes as nb
from polyphon.operators import scoring as sc
from polyphon.plans.bagging import bag_train
from polyphon.sources.instances import FeatureSpec

SCHEMA = "instance_id long, seq long, weight double, x double, kind string, user string, label string"
SPEC = FeatureSpec(numeric=("x",), nominal={"kind": ("p", "q")}, open=("user",), classes=("a", "b", "c"))
CLOSED = FeatureSpec(numeric=("x",), nominal={"kind": ("p", "q")}, classes=("a", "b", "c"))


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(4)
    return spark.createDataFrame(
        [
            (i, i, 1.0, None if i % 11 == 0 else float(r.randrange(9)), r.choice(["p", "q", "new", None]), r.choice(["u", "v", None]), r.choice("ab" if i < 40 else "abcd"))
            for i in range(60)
        ],
        SCHEMA,
    )


def stats_of(frame, spec):
    """Member 1 was never trained, and no member knows class c."""
    return bag_train(frame.where("seq < 40"), spec, 3, 5).where("member <> 1")


def test_votes_parts_and_sums(monkeypatch, frame):
    def all_of():
        voted = sc.row_votes(frame.drop("label"), stats_of(frame, SPEC), SPEC, 3).withColumn("w", F.expr("map(0, 0.5D, 2, -1D)"))
        parts = [sc.part_vectors(voted, 3, 3, p, w).select("instance_id", "parts") for p, w in ((2, None), (2, "w"), (5, None))]
        flat = [sc.flat_rows(voted, 3, ["instance_id"], zero, ensemble=3) for zero in (False, True)]
        return [sorted(map(str, f.collect())) for f in (voted.select("instance_id", "votes"), *parts, *flat)]

    in_columns = all_of()
    monkeypatch.setattr(sc, "COLUMN_VOTES", 0)
    assert in_columns == all_of()


def test_flags(monkeypatch, frame):
    model = nb.nb_model(stats_of(frame, CLOSED), CLOSED)
    flagged = bo.correct_flags(frame, model, CLOSED, 3)
    # The models stand in the plan as one value; a join would copy them to every row, member by member.
    assert "Join" not in flagged._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(str, flagged.collect()))
    monkeypatch.setattr(sc, "COLUMN_VOTES", 0)
    assert got == sorted(map(str, bo.correct_flags(frame, model, CLOSED, 3).collect()))


def test_frozen_members_are_trained_once(monkeypatch, spark):
    from polyphon.plans import common, training_queries, vote_queries

    calls = []
    for module in (common, training_queries):
        monkeypatch.setattr(module, "bag_train", lambda *a: calls.append(a) or bag_train(*a))
    vote_queries.boost_partial_votes(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_line_statistics_are_gathered_once(monkeypatch, spark):
    """Votes, terms and the number of values come from one written table."""
    from polyphon.plans import vote_queries

    written = []
    put = vote_queries.materialize
    monkeypatch.setattr(vote_queries, "materialize", lambda df, name: written.append(name) or put(df, name))
    got = vote_queries.open_votes_lineitem(spark, "/root/testdata/sf0.001")
    assert written == ["line-stats"]
    assert got.count() > 0
