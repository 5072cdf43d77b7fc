"""Row-local scoring and open attributes against plain Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from polyphon.operators import evaluation as ev
from polyphon.operators import naive_bayes as nb
from polyphon.operators import scoring as sc
from polyphon.operators import votes as vt
from polyphon.operators.streams import ensemble_fanout, member_partition
from polyphon.plans.bagging import bag_train
from polyphon.plans.common import ENSEMBLE, SEED, row_votes
from polyphon.sources.instances import FeatureSpec, complete_header

SCHEMA = "instance_id long, seq long, weight double, x double, kind string, user string, label string"


def rows(n=400, users=150, seed=2):
    """A third of all rows have one user; some values are missing."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        user = "hot" if i % 3 == 0 else f"u{r.randrange(users)}"
        out.append((
            i, i, 1.0, None if i % 41 == 0 else float(r.randrange(50)), r.choice(["p", "q", None]), None if i % 37 == 0 else user, r.choice("abc"),
        ))
    return out


SPEC = FeatureSpec(numeric=("x",), nominal={"kind": ("p", "q")}, open=("user",), classes=("a", "b", "c"))


def gauss(pairs, x):
    w = sum(k for k, _ in pairs)
    if x is None or w == 0:
        return 0.0
    mu = sum(k * v for k, v in pairs) / w
    var = max(sum(k * (v - mu) ** 2 for k, v in pairs) / (w - 1), 1e-9) if w > 1 else 1e-9
    return -0.5 * math.log(2 * math.pi * var) - (x - mu) ** 2 / (2 * var)


def naive(train, row, values):
    """Vote vector of naive Bayes trained on (weight, row) pairs; ``values``: those of the open attribute that count."""
    total = sum(k for k, _ in train)
    logs = []
    for c in "abc":
        own = [(k, t) for k, t in train if t[6] == c]
        n = sum(k for k, _ in own)
        if n == 0:
            logs.append(None)
            continue
        lv = math.log(n / total) + gauss([(k, t[3]) for k, t in own if t[3] is not None], row[3])
        if row[4] is not None:
            lv += math.log((sum(k for k, t in own if t[4] == row[4]) + 1) / (n + 2))
        if row[5] is not None:
            lv += math.log((sum(k for k, t in own if t[5] == row[5]) + 1) / (n + len(values | {row[5]})))
        logs.append(lv)
    top = max((x for x in logs if x is not None), default=0)
    return [0.0 if x is None else math.exp(x - top) for x in logs]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def trained(spark, frame):
    """Three members on the first 300 rows, and what each of them was trained on."""
    first = frame.where("seq < 300")
    from polyphon.functions.weights import with_poisson_weight

    weights = defaultdict(list)
    data = {r[0]: r for r in rows()}
    for r in with_poisson_weight(ensemble_fanout(first.select("instance_id", "weight"), 3), seed=SEED).collect():
        weights[r.member].append((r.w, data[r.instance_id]))
    return bag_train(first, SPEC, 3, SEED), weights


@pytest.mark.parametrize("heavy", [2, 256, 100_000])
def test_open_values_with_any_number_of_heavy_ones(frame, trained, heavy):
    """All, some or (nearly) no values are looked up in the broadcast: the terms are the same."""
    stats, weights = trained
    terms = sc.with_open_terms(frame, stats, SPEC, 3, heavy=heavy).select("instance_id", "user", "_o_0", "_V_0").collect()
    assert len(terms) == 400
    values = {t[5] for own in weights.values() for _, t in own if t[5] is not None}
    for r in terms:
        assert (r._o_0 is None) == (r.user not in values)
        assert r._V_0 == len(values) + (r.user not in values)
        if r._o_0 is not None:
            for m, own in weights.items():
                for i, c in enumerate("abc"):
                    assert r._o_0[m * 3 + i] == pytest.approx(math.log(1 + sum(k for k, t in own if t[5] == r.user and t[6] == c)))


def test_row_votes(monkeypatch, frame, trained):
    """Votes on the row, and gathered votes of a model too large for one value, against plain Python."""
    stats, weights = trained
    values = {t[5] for own in weights.values() for _, t in own if t[5] is not None}
    data = {r[0]: r for r in rows()}
    for limit in (64 << 20, 0):
        monkeypatch.setattr(sc, "BROADCAST_BYTES", limit)
        got = sc.row_votes(frame.drop("label"), stats, SPEC, 3).collect()
        assert len(got) == 400
        for r in got:
            assert [z.member for z in r.votes] == sorted(weights)
            for m, v in r.votes:
                assert v == pytest.approx(naive(weights[m], data[r.instance_id], values), abs=1e-9)


def test_vote_rows_equal_grouped_votes(spark):
    """Parts, both modes, two stages and the flat form against the operators that group by instance."""
    sf = "/root/testdata/sf0.001"
    from polyphon.plans.common import all_votes

    voted, grouped = row_votes(spark, sf), all_votes(spark, sf)
    n = 5

    by = lambda df, *keys: {tuple(r[k] for k in keys): [round(r[v], 9) for v in vt.vote_cols(n)] for r in df.collect()}
    parted = sc.part_vectors(voted, n, ENSEMBLE, 2)
    partial = vt.bag_partial_votes(grouped, n)
    assert by(sc.part_rows(parted, n, ["instance_id"]), "instance_id", "part", "n_votes") == by(partial, "instance_id", "part", "n_votes")
    for mode in ("flat", "hierarchical"):
        assert by(sc.combined_rows(parted, n, ["instance_id"], mode), "instance_id", "n_votes") == by(vt.combine_votes(partial, n, mode), "instance_id", "n_votes")
    assert sc.combined_rows(parted, n, ["instance_id"], complete=ENSEMBLE + 1).count() == 0
    three = vt.bag_partial_votes(member_partition(grouped.drop("part"), ENSEMBLE, 3), n)
    two = vt.combine_two_stage(three, n, F.floor(F.col("part") / 2).cast("int"))
    assert by(sc.two_stage_rows(sc.part_vectors(voted, n, ENSEMBLE, 3), n, ["instance_id"], 2), "instance_id") == by(two, "instance_id")
    for zero in (False, True):
        assert by(sc.flat_rows(voted, n, ["instance_id"], zero), "instance_id") == by(vt.flat_combine(grouped, n, keep_zero=zero), "instance_id")
    more = sc.part_rows(sc.part_vectors(voted, n, ENSEMBLE, ENSEMBLE + 2), n, ["instance_id"])
    assert {r.part for r in more.collect()} == {ENSEMBLE + 1}


def test_votes_need_no_shuffle(spark):
    """Behind the model's own aggregation, a scored row meets no exchange."""
    plan = sc.flat_rows(row_votes(spark, "/root/testdata/sf0.001"), 5, ["instance_id"])._jdf.queryExecution().executedPlan().toString()
    # Lines of subqueries stand behind a colon.
    main = [line for line in plan.splitlines() if ":" not in line.split("Generate")[0].split("Project")[0].split("Scan")[0]]
    assert any("FileScan" in line for line in main) and any("Exchange" in line for line in plan.splitlines())
    assert not any("Exchange" in line or "Join" in line for line in main)


def test_untrained_rows_have_no_vote(frame, trained):
    stats, _ = trained
    empty = stats.where("false")
    assert sc.flat_rows(sc.row_votes(frame, empty, SPEC, 3).drop("label"), 3, ["instance_id"]).count() == 0
    assert sc.row_votes(frame.where("false"), stats, SPEC, 3).count() == 0


@pytest.mark.parametrize("inclusive", [False, True])
def test_prequential_with_open_values(frame, inclusive):
    got = {r.seq: [r.v_0, r.v_1, r.v_2] for r in ev.prequential(frame, SPEC, bucket_rows=16, inclusive=inclusive).collect()}
    data = rows()
    for i, row in enumerate(data):
        before = data[: i + inclusive]
        values = {t[5] for t in before if t[5] is not None}
        want = naive([(1.0, t) for t in before], row, values) if before else [0.0] * 3
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_header_with_many_values_is_open(spark):
    df = spark.range(2000).selectExpr("cast(id AS STRING) AS many", "cast(id % 3 AS STRING) AS few", "cast(id % 2 AS STRING) AS label")
    spec = complete_header(df, FeatureSpec(nominal={"many": (), "few": ()}))
    assert spec.open == ("many",) and spec.nominal == {"few": ("0", "1", "2")} and spec.classes == ("0", "1")
