"""Operators against brute force on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from polyphon.functions import payload as pl
from polyphon.functions import routing
from polyphon.functions.weights import hash32, poisson_thresholds, with_poisson_rate, with_poisson_weight
from polyphon.operators import boosting as bo
from polyphon.operators import hoeffding as ht
from polyphon.operators import lookup, metrics as mt, naive_bayes as nb, streams as st, versions as vs, votes as vt
from polyphon.operators.evaluation import basic_evaluator, prequential, window_evaluator
from polyphon.operators.orbit import orbit
from polyphon.operators.prefix import Running, running, sliding_sums
from polyphon.sources.instances import FeatureSpec, complete_header
from polyphon.sources.schema import flat_schema


# -- weights -------------------------------------------------------------------


def test_all_64_bits_of_an_id_reach_the_draw(spark):
    """Ids whose low words, or whose words folded together, are equal draw differently over members and seeds."""
    fold = 0x1B873593
    pairs = [(fold + 5, 2**32 + 5), (7, 2**40 + 7), (3 * fold + 2, 3 * 2**32 + 2), (5, -(2**63) + 5), (-1, 2**32 - 1)]
    for a, b in pairs:
        ids = spark.createDataFrame([(a, b)], "a long, b long")
        same = ids.select(*((hash32("a", str(m), s) == hash32("b", str(m), s)).alias(f"s{m}_{s}") for m in range(8) for s in (1, 7))).first()
        assert sum(same) <= 1
    wide = spark.range(20_000).selectExpr("id * 4294967296L + id AS instance_id", "1.0D AS weight")
    k = with_poisson_weight(wide.withColumn("member", F.lit(2)), seed=4).agg(F.sum("k"), F.sum(F.col("k") * F.col("k"))).first()
    assert abs(k[0] / 20_000 - 1) < 0.04 and abs(k[1] / 20_000 - 2) < 0.15


def test_poisson_thresholds_follow_the_distribution():
    steps = poisson_thresholds(1.0)
    cdf = 0.0
    for j, s in enumerate(steps):
        cdf += math.exp(-1) / math.factorial(j)
        assert abs(s / 2**32 - cdf) < 1e-9


def test_hash_is_even_and_members_are_independent(spark):
    n = 200_000
    h = spark.range(n).select("id", *[hash32("id", str(m), 3).alias(f"h{m}") for m in range(3)])
    counts = [r["count"] for r in h.groupBy(F.floor(F.col("h0") / (1 << 28))).count().collect()]
    expected = n / 16
    assert len(counts) == 16
    assert sum((c - expected) ** 2 / expected for c in counts) < 40  # 15 degrees of freedom
    assert abs(h.stat.corr("h0", "h1")) < 0.01 and abs(h.stat.corr("h1", "h2")) < 0.01


def test_members_and_seeds_are_not_shifted_copies(spark):
    """Draws of one member do not come back as another one's (or another seed's) at any of the steps used in mixing."""
    from polyphon.functions.weights import HIGH_STEP, MEMBER_STEP, SEED_STEP

    ids = spark.range(20_000).withColumn("k", F.lit(0))
    for step in (MEMBER_STEP, SEED_STEP, HIGH_STEP, 1, 1 << 32):
        for sign in (1, -1):
            moved = ids.withColumn("to", F.col("id") + sign * step)
            same = moved.select(*((hash32("id", "1", 3) == hash32("to", m, s)).cast("int").alias(f"s{i}") for i, (m, s) in enumerate((("0", 3), ("2", 3), ("1", 4)))))
            assert same.agg(F.sum(F.col("s0") + F.col("s1") + F.col("s2"))).first()[0] <= 2
    pair = ids.select(*(hash32("id", str(m), 3).cast("double").alias(f"h{m}") for m in (0, 1)))
    assert abs(pair.corr("h0", "h1")) < 0.03


def test_weights_are_replayable_and_drop_zero(spark):
    rows = st.ensemble_fanout(spark.range(5000).selectExpr("id AS instance_id", "2D AS weight"), 4)
    a = with_poisson_weight(rows, seed=9)
    b = with_poisson_weight(rows.repartition(7), seed=9)
    key = lambda df: sorted((r.instance_id, r.member, r.k, r.w) for r in df.collect())
    assert key(a) == key(b)
    assert a.where("k < 1 OR w <> 2 * k").isEmpty()
    share = a.count() / 20_000
    assert abs(share - (1 - math.exp(-1))) < 0.02


@pytest.mark.parametrize("rate", [0.05, 1.0, 15.9, 16.1, 250.0, 5_000.0, 1e11])
def test_rate_draws_have_poisson_moments(spark, rate):
    d = with_poisson_rate(spark.range(20_000).selectExpr("id AS instance_id", f"{rate}D AS lam", "2 AS member"), "lam", "member", "k")
    r = d.agg(F.avg("k").alias("m"), F.var_samp("k").alias("v")).first()
    assert abs(r.m - rate) < 5 * math.sqrt(rate / 20_000)
    assert abs(r.v / rate - 1) < 0.06


# -- order ---------------------------------------------------------------------


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_matches_a_loop(spark, exclusive):
    rng = random.Random(4)
    seqs = rng.sample(range(-500, 5000), 600)
    # One key holds most rows, another is null.
    data = [(s, rng.choice(["hot", "hot", "hot", "cold", None]), rng.randint(-5, 9)) for s in seqs]
    df = spark.createDataFrame(data, "seq long, k string, x long")
    got = {
        r.seq: (r.total, r.top)
        for r in running(df, "seq", [Running("total", "x"), Running("top", "x", "max")], keys=["k"], exclusive=exclusive, bucket_rows=16).collect()
    }
    want, state = {}, {}
    for s, k, x in sorted(data, key=lambda t: t[0]):
        total, top = state.get(k, (0, None))
        after = (total + x, x if top is None else max(top, x))
        want[s] = (total, top) if exclusive else after
        state[k] = after
    assert got == want


def test_running_does_not_use_one_task(spark):
    df = running(spark.range(10_000).withColumnRenamed("id", "seq"), "seq", [Running("n", "1L")], bucket_rows=64)
    plan = df._jdf.queryExecution().executedPlan().toString()
    over_rows = [line for line in plan.splitlines() if " Window [" in line and "_run0" in line]
    assert over_rows and all("windowspecdefinition(_bucket" in line for line in over_rows)


def test_sliding_matches_a_loop(spark):
    xs = [(i, (i * 37) % 11) for i in range(500)]
    got = {r.i: r.s for r in sliding_sums(spark.createDataFrame(xs, "i long, x long"), "i", 7, {"s": "x"}, bucket_rows=16).collect()}
    assert got == {i: sum(x for _, x in xs[max(0, i - 6) : i + 1]) for i, _ in xs}


def test_orbit_matches_a_walk(spark):
    rng = random.Random(2)
    nodes, want = [], set()
    for k in range(3):
        pos = sorted(rng.sample(range(1000), 120))
        nxt = {p: (rng.choice(pos[i + 1 : i + 6] or [None])) for i, p in enumerate(pos)}
        # A pointer to a position without a row ends the chain.
        nxt[pos[90]] = 5000
        nodes += [(k, p, n) for p, n in nxt.items()]
        at = pos[0]
        while at is not None and at in nxt:
            want.add((k, at))
            at = nxt[at]
    got = {(r.k, r.p) for r in orbit(spark.createDataFrame(nodes, "k int, p long, n long"), ["k"], "p", "n").collect()}
    assert got == want


def test_message_id_counts_per_source(spark):
    df = spark.range(300).selectExpr("if(id % 3 = 0, 'b', 'a') AS src", "id AS at")
    got = [(r.src, r.msg_seq) for r in st.message_id(df, "src", "at", bucket_rows=16).orderBy("at").collect()]
    seen = {}
    for src, n in got:
        seen[src] = seen.get(src, 0) + 1
        assert n == seen[src]


# -- routing -------------------------------------------------------------------


@pytest.mark.parametrize("ensemble,parts", [(7, 3), (6, 3), (1, 1), (2, 5)])
def test_member_partition(spark, ensemble, parts):
    rows = spark.range(ensemble).select(F.col("id").cast("int").alias("member"))
    got = [r.part for r in st.member_partition(rows, ensemble, parts).orderBy("member").collect()]
    size = ensemble // parts
    assert got == [min(m // size, parts - 1) if size else parts - 1 for m in range(ensemble)]
    assert [got.count(p) for p in range(parts)] == routing.partition_sizes(ensemble, parts)


def test_replica_sets_and_sub_ensembles(spark):
    seqs = spark.range(12).withColumnRenamed("id", "seq")
    sets = {}
    for r in st.replica_set(seqs, 5, 3).collect():
        sets.setdefault(r.seq, set()).add(r.member)
    assert sets == {s: {m for m in range(5) if m % 3 == s % 3} for s in range(12)}
    # More sets than members: the sets without members get nothing.
    assert st.replica_set(seqs, 2, 3).where("seq % 3 = 2").isEmpty()
    subs = {}
    for r in st.sub_ensemble_sample(seqs, 8, 3).collect():
        subs.setdefault(r.seq, set()).add(r.member)
    assert subs == {s: {0, 1, 2} if s % 2 == 0 else {3, 4, 5} for s in range(12)}


# -- look-ups ------------------------------------------------------------------


def test_large_model_is_joined_by_salt(spark):
    rows = st.ensemble_fanout(spark.range(400).selectExpr("id AS instance_id"), 3)
    model = spark.createDataFrame([(0, 1.5), (1, 2.5)], "member int, c double")
    small = lookup.model_join(rows, model, ["member"], 100, "instance_id")
    large = lookup.model_join(rows, model, ["member"], 1 << 40, "instance_id")
    key = lambda df: sorted((r.instance_id, r.member, r.c) for r in df.collect())
    assert key(small) == key(large) and len(key(large)) == 800
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()


def test_version_asof(spark):
    msgs = spark.range(250).withColumnRenamed("id", "seq")
    vers = spark.createDataFrame([(5, 7), (9, 130), (11, 131)], "version long, published_seq long")
    got = {r.seq: r.version for r in lookup.version_asof(msgs, vers, pending=100, bucket_rows=32).collect()}
    # Nothing before the first poll that finds a version; both later ones at the next poll.
    assert got == {s: 5 if s < 200 else 11 for s in range(100, 250)}
    every = {r.seq: r.version for r in lookup.version_asof(msgs, vers, pending=1, bucket_rows=32).collect()}
    assert every == {s: 5 if s < 130 else 9 if s < 131 else 11 for s in range(7, 250)}
    # A smaller version that comes later is not newer.
    late = spark.createDataFrame([(9, 50), (4, 60), (4, 60)], "version long, published_seq long")
    assert {r.version for r in lookup.version_asof(msgs, late, pending=100).collect()} == {9}


# -- votes ---------------------------------------------------------------------

# Parts of 3 and 1 members; member 2 of instance 1 votes nothing.
VOTES = [
    (1, 0, 0, 3.0, 1.0), (1, 1, 0, 1.0, 1.0), (1, 2, 0, 0.0, 0.0), (1, 3, 1, 0.0, 2.0),
    (2, 0, 0, 1.0, 0.0), (2, 1, 0, 1.0, 0.0), (2, 2, 0, 1.0, 0.0), (2, 3, 1, 0.0, 1.0),
]


def votes(spark, rows=VOTES):
    return spark.createDataFrame(rows, "instance_id long, member int, part int, v_0 double, v_1 double")


def vectors(df):
    return {r.instance_id: (round(r.v_0, 9), round(r.v_1, 9)) for r in df.collect()}


def test_hierarchical_and_flat_combine(spark):
    p = vt.bag_partial_votes(votes(spark), 2)
    assert {(r.instance_id, r.part): (r.v_0, r.v_1, r.n_votes) for r in p.collect()} == {
        (1, 0): (1.25, 0.75, 3), (1, 1): (0.0, 1.0, 1), (2, 0): (3.0, 0.0, 3), (2, 1): (0.0, 1.0, 1),
    }
    assert vectors(vt.combine_votes(p, 2, "hierarchical")) == {1: (0.3125, 0.6875), 2: (0.5, 0.5)}
    assert vectors(vt.combine_votes(p, 2, "flat")) == {1: (round(1.25 / 3, 9), round(1.75 / 3, 9)), 2: (0.75, 0.25)}
    assert vectors(vt.combine_two_stage(p, 2, F.col("part"), 4)) == vectors(vt.combine_votes(p, 2, "hierarchical"))


def test_flat_combine_drops_instances_without_a_vote(spark):
    rows = [*VOTES, (3, 0, 0, 0.0, 0.0), (3, 1, 0, 0.0, 0.0)]
    assert 3 not in vectors(vt.flat_combine(votes(spark, rows), 2))
    assert vectors(vt.flat_combine(votes(spark, rows), 2, keep_zero=True))[3] == (0.0, 0.0)


def test_complete_only(spark):
    rows = [r for r in VOTES if not (r[0] == 2 and r[1] == 3)]
    assert set(vectors(vt.complete_only(vt.bag_partial_votes(votes(spark, rows), 2), 2, 4))) == {1}


def test_boost_weight_edges(spark):
    rows = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (1.0, 3.0), (3.0, 1.0)]
    df = spark.createDataFrame(rows, "scms double, swms double")
    got = [r.w for r in df.select(vt.boost_member_weight(F.col("scms"), F.col("swms")).alias("w")).collect()]
    assert got[0] is None and got[1] == 0 and got[2] == 0 and got[3] == 0
    assert got[4] == pytest.approx(math.log(3))


def test_boost_partials_skip_weights_that_are_not_positive(spark):
    weights = spark.createDataFrame([(0, 2.0), (1, None), (2, 1.0), (3, -1.0)], "member int, weight double")
    p = {(r.instance_id, r.part): (r.v_0, r.v_1, r.n_votes) for r in vt.boost_partial_votes(votes(spark), weights, 2, 4).collect()}
    assert p == {(1, 0): (1.5, 0.5, 3), (1, 1): (0.0, 0.0, 1), (2, 0): (3.0, 0.0, 3), (2, 1): (0.0, 0.0, 1)}


def test_argmax_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([(0.1 + 0.2, 0.3, 0.0), (0.2, 0.5, 0.5), (0.0, 0.0, 0.0)], "v_0 double, v_1 double, v_2 double")
    assert [r.pred_index for r in vt.with_argmax(df, 3).collect()] == [0, 1, 0]


def test_positional_votes(spark):
    lists = [(0, 0, [[1.0, 1.0], [0.0, 4.0]]), (0, 1, [[3.0, 1.0], [0.0, 0.0]])]
    df = spark.createDataFrame(lists, "batch_id long, member int, vote_list array<array<double>>")
    got = {(r.batch_id, r.pos): (r.v_0, r.v_1, r.n_votes) for r in vt.positional_votes(df, 2).collect()}
    assert got == {(0, 0): (1.25, 0.75, 2), (0, 1): (0.0, 1.0, 2)}


# -- naive Bayes ---------------------------------------------------------------

SPEC = FeatureSpec(numeric=("x",), nominal={"n": ("p", "q")}, classes=("a", "b"))


def small(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(i, i, 1.0, float(rng.randint(0, 9)), rng.choice("pq"), rng.choice("ab")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "instance_id long, seq long, weight double, x double, n string, label string")


class Counts:
    """Naive Bayes by hand, one instance at a time."""

    def __init__(self):
        self.rows = []

    def train(self, x, n, label, w):
        if w > 0:
            self.rows.append((x, n, label, w))

    def votes(self, x, n):
        logs = []
        total = sum(r[3] for r in self.rows)
        for c in "ab":
            mine = [r for r in self.rows if r[2] == c]
            w = sum(r[3] for r in mine)
            if w == 0:
                logs.append(None)
                continue
            s, q = sum(r[3] * r[0] for r in mine), sum(r[3] * r[0] ** 2 for r in mine)
            var = max((q - s * s / w) / (w - 1), 1e-9) if w > 1 and q - s * s / w > q * 1e-12 else 1e-9
            hits = sum(r[3] for r in mine if r[1] == n)
            logs.append(math.log(w / total) - 0.5 * math.log(2 * math.pi * var) - (x - s / w) ** 2 / (2 * var) + math.log((hits + 1) / (w + 2)))
        top = max((v for v in logs if v is not None), default=0)
        return [0.0 if v is None else math.exp(v - top) for v in logs]

    def correct(self, x, n, label):
        v = [round(a * 1e9) for a in self.votes(x, n)]
        return "ab"[v.index(max(v))] == label


def test_training_counts_any_number_of_values_declared_or_not(spark):
    df = spark.range(20_000).selectExpr("0 AS member", "2D AS w", "cast(id % 10000 AS STRING) AS n", "if(id = 3, NULL, 1D) AS x", "if(id % 2 = 0, 'a', 'b') AS label")
    stats = nb.nb_train(df, SPEC)
    assert stats.columns == nb.STAT_COLUMNS
    values = stats.where("attr = 'n'").agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi")).first()
    assert tuple(values) == (10_000, 4.0, 4.0)
    rest = {(r.label, r.attr): (r.value, r.w, r.wx, r.wxx) for r in stats.where("attr <> 'n'").collect()}
    assert rest == {
        ("a", "#class"): (None, 20_000.0, None, None), ("b", "#class"): (None, 20_000.0, None, None),
        ("a", "x"): (None, 20_000.0, 20_000.0, 20_000.0), ("b", "x"): (None, 19_998.0, 19_998.0, 19_998.0),
    }


def test_votes_match_the_hand_count_also_for_unseen_values(spark):
    rows, df = small(spark)
    hand = Counts()
    for _, _, w, x, n, label in rows:
        hand.train(x, n, label, w)
    model = nb.nb_model(nb.single_train(df, SPEC), SPEC)
    asked = spark.createDataFrame([(0, 0, 3.0, "p"), (1, 0, 8.0, "never"), (2, 0, 0.0, "q")], "instance_id long, member int, x double, n string")
    got = {r.instance_id: (r.v_0, r.v_1) for r in nb.member_votes(asked, model, SPEC, 1).collect()}
    for i, x, n in [(0, 3.0, "p"), (1, 8.0, "never"), (2, 0.0, "q")]:
        assert got[i] == pytest.approx(hand.votes(x, n))


def test_prequential_scores_before_it_trains(spark):
    rows, df = small(spark)
    got = {r.seq: (r.v_0, r.v_1) for r in prequential(df, SPEC, bucket_rows=8).collect()}
    hand = Counts()
    for i, _, w, x, n, label in rows:
        assert got[i] == pytest.approx(hand.votes(x, n) if hand.rows else [0.0, 0.0])
        hand.train(x, n, label, w)


def test_header_is_completed(spark):
    _, df = small(spark)
    spec = complete_header(df, FeatureSpec(numeric=("x",), nominal={"n": ()}))
    assert spec.classes == ("a", "b") and spec.nominal == {"n": ("p", "q")}
    # No value is left out and no job ends, however many there are.
    assert len(complete_header(spark.range(2000).selectExpr("cast(id AS STRING) AS label"), FeatureSpec()).classes) == 2000


# -- boosting ------------------------------------------------------------------


def test_boost_chain_matches_a_loop(spark):
    rng = random.Random(3)
    n, e = 200, 3
    flags = [(i, 1.0 + i % 2, *[rng.random() < 0.6 for _ in range(e)]) for i in range(n)]
    df = spark.createDataFrame(flags, "seq long, weight double, correct_0 boolean, correct_1 boolean, correct_2 boolean")
    got = {(r.seq, r.member): (r.lam_in, r.lam_out) for r in bo.chain_long(bo.boost_chain(df, e, bucket_rows=16), e).collect()}
    state = [[0.0, 0.0, 0.0] for _ in range(e)]
    for i, w, *ok in flags:
        lam = 1.0
        for m in range(e):
            before = lam
            state[m][2] += w
            side = 0 if ok[m] else 1
            state[m][side] += lam
            lam *= state[m][2] / (2 * state[m][side])
            assert got[(i, m)] == pytest.approx((before, lam))


def test_boosting_is_the_instance_by_instance_algorithm(spark):
    rows, df = small(spark, n=40, seed=8)
    run = bo.boost_train(df, SPEC, 2, pure=True, bucket_rows=8)
    got = {(r.seq, r.member): (r.correct, r.lam_in, r.lam_out) for r in run.chain.collect()}
    members = [(Counts(), [0.0, 0.0, 0.0]) for _ in range(2)]
    for i, _, w, x, n, label in rows:
        lam = 1.0
        for m, (model, sums) in enumerate(members):
            before = lam
            sums[2] += w
            model.train(x, n, label, w * lam)
            ok = model.correct(x, n, label)
            sums[0 if ok else 1] += lam
            lam *= sums[2] / (2 * sums[0 if ok else 1])
            assert got[(i, m)] == (ok, pytest.approx(before), pytest.approx(lam))
    sums = {r.member: (r.scms, r.swms, r.tw) for r in bo.member_sums(run.chain).collect()}
    weights = {r.member: r.w for r in run.stats.where("attr = '#class'").groupBy("member").agg(F.sum("w").alias("w")).collect()}
    for m, (model, own) in enumerate(members):
        assert sums[m] == pytest.approx(tuple(own))
        assert weights[m] == pytest.approx(sum(r[3] for r in model.rows))


# -- trees ---------------------------------------------------------------------


def entropy(ws):
    n = sum(ws)
    return -sum(w / n * math.log2(w / n) for w in ws if w)


def test_split_matches_brute_force_and_routing_follows_it(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        x, n = float(rng.randint(0, 9)), rng.choice("pq")
        label = "a" if (x <= 4) == (rng.random() < 0.9) else "b"
        rows.append((i, 0, x, n, label, 1.0))
    df = spark.createDataFrame(rows, "instance_id long, member int, x double, n string, label string, w double")
    params = ht.TreeParams(edges={"x": (2.0, 4.0, 6.0)}, grace=10, delta=0.05)
    binned = ht.binned(df, SPEC, params)
    nodes = ht.root_nodes(spark, 1)
    stats = ht.leaf_stats(ht.route(binned, nodes, SPEC, 0, 1000), SPEC)
    cands = {(r.attr, r.cut): r.gain for r in ht.split_candidates(stats, SPEC).collect()}
    labels = lambda sel: [sum(1 for r in sel if r[4] == c) for c in "ab"]
    for (attr, cut), gain in cands.items():
        edge = params.edges["x"]
        left = [r for r in rows if (sum(r[2] > e for e in edge) <= cut if attr == "x" else "pq".index(r[3]) == cut)]
        right = [r for r in rows if r not in left]
        want = entropy(labels(rows)) - sum(len(s) / len(rows) * entropy(labels(s)) for s in (left, right))
        assert gain == pytest.approx(want, abs=1e-8)
    split = ht.tree_split(stats, SPEC, params).first()
    assert (split.attr, split.op, split.cut) == ("x", "le", 1)
    grown = ht.apply_splits(nodes, ht.tree_split(stats, SPEC, params))
    routed = {r.instance_id: r.node_id for r in ht.route(binned, grown, SPEC, 1, 1000).collect()}
    assert routed == {r[0]: 2 if r[2] <= 4 else 3 for r in rows}
    assert ht.tree_size_limit(grown, 1).count() == 3
    restarted = ht.tree_size_limit(grown, 0).collect()
    assert len(restarted) == 1 and restarted[0].is_leaf and restarted[0].attr is None


def test_leaf_does_not_split_without_evidence(spark):
    rows = [(i, 0, float(i % 10), "pq"[i % 2], "ab"[(i // 3) % 2], 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "instance_id long, member int, x double, n string, label string, w double")
    params = ht.TreeParams(edges={"x": (2.0, 4.0, 6.0)}, grace=10)
    stats = ht.leaf_stats(ht.binned(df, SPEC, params).withColumn("node_id", F.lit(1).cast("long")), SPEC)
    assert ht.tree_split(stats, SPEC, params).isEmpty()


# -- evaluation and metrics ----------------------------------------------------


def test_kappa_and_accuracy(spark):
    cells = [("a", "a", 20), ("a", "b", 5), ("b", "a", 10), ("b", "b", 15)]
    df = spark.createDataFrame([(t, p, 1.0) for t, p, n in cells for _ in range(n)], "truth string, pred string, weight double")
    r = basic_evaluator(df).first()
    assert (r.instances, r.accuracy) == (50, 0.7) and r.kappa == pytest.approx(0.4)
    assert basic_evaluator(df.where("weight < 0")).first().instances == 0


def test_window_accuracy(spark):
    rows = [(i, i % 3 == 0) for i in range(90)]
    df = spark.createDataFrame([(i, int(c), 1.0) for i, c in rows], "seq long, correct int, weight double")
    got = {r.seq: r.window_accuracy for r in window_evaluator(df, width=10, bucket_rows=16).collect()}
    for i, _ in rows:
        last = rows[max(0, i - 9) : i + 1]
        assert got[i] == pytest.approx(sum(c for _, c in last) / len(last))


def test_rearmed_throughput_matches_a_walk(spark):
    rng = random.Random(7)
    times, t = [], 1_000_000
    for _ in range(300):
        t += rng.choice([0, 100, 5_000, 30_000, 90_000])
        times.append(t)
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(times)], "counter string, rn long, ts_ms long")
    got = sorted((r.window_start_ms, r.n_events, r.per_second) for r in mt.throughput_rearmed(df, "counter", order="rn").collect())
    want, start, count = [], times[0], 0
    for t in times:
        count += 1
        if t - start > 60_000:
            want.append((start, count, count * 100 * 1000 // (t - start)))
            start, count = t, 0
    assert got == want


def test_latency_pending_and_empty_counters(spark):
    rows = [(0, i, 10 * i) for i in range(10)]
    v = spark.createDataFrame(rows, "combiner int, seq long, delay_ms long")
    got = [(r.n, r.mean_delay_ms) for r in mt.emit_latency(v, "combiner", "seq", every=4, bucket_rows=4).orderBy("n").collect()]
    assert got == [(4, 15), (8, 35)]
    sets = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 2)], "instance_id long, n_votes long")
    r = mt.pending_stats(sets, 3).first()
    assert (r.pending, r.with_two) == (3, 2)
    assert mt.processed_stats(spark.createDataFrame([], "member int, trained_n long")).first().processed == 0


# -- versions ------------------------------------------------------------------


def test_publish_barrier(spark):
    reports = [(1, 0, 5), (1, 1, 6), (2, 0, 7), (1, 2, 9), (2, 1, 8), (2, 1, 10), (3, 0, 11)]
    df = spark.createDataFrame(reports, "version long, part int, seq long")
    assert [(r.version, r.published_seq) for r in vs.publish_barrier(df, 3).collect()] == [(1, 9)]
    # One part is enough when there is one.
    assert {r.version for r in vs.publish_barrier(df, 1).collect()} == {3}
    assert vs.version_pointer(vs.publish_barrier(df, 9)).first().version == -1


def test_retain_two_over_many_versions(spark):
    rows = [(m, v) for v in range(100) for m in (0, 1) if not (m == 1 and v == 98)]
    df = spark.createDataFrame(rows, "member int, version long")
    got = {(r.member, r.version) for r in vs.retain_two(df).collect()}
    assert got == {(0, 99), (0, 98), (1, 99), (1, 97)}
    assert {(r.member, r.version) for r in vs.retain_two(df.unionByName(df)).collect()} == got


def test_restore_is_all_or_nothing(spark):
    rows = [(0, 0, 1), (0, 1, 1), (0, 0, 2), (1, 2, 2)]
    df = spark.createDataFrame(rows, "part int, member int, version long")
    sizes = spark.createDataFrame([(0, 2), (1, 1), (2, 4)], "part int, n_members long")
    assert {r.part: r.version for r in vs.restore_all_or_nothing(df, sizes).collect()} == {0: 1, 1: 2, 2: -1}


def test_checkpoint_waits_for_the_last_request(spark):
    delay = {0: 250, 100: 10, 200: 10, 300: 10, 400: 500}
    rows = [(v, v + delay.get(v, 10)) for v in range(0, 1000)]
    df = spark.createDataFrame(rows, "version long, published_at long")
    got = sorted(r.version for r in vs.checkpoint_plan(df, 100).collect())
    want, sent, published = [], -1, -1
    for v, at in rows:
        if v % 100 == 0 and published <= v:
            want.append(v)
            published = at
    assert got == want == [0, 300, 400, 900]


def test_model_replace_restarts_training(spark):
    df = spark.range(20).selectExpr("id AS seq", "id IN (3, 11) AS fresh")
    assert sorted(r.seq for r in vs.model_replace(df, "fresh").collect()) == list(range(12, 20))
    assert sorted(r.seq for r in vs.model_replace(df.where("NOT fresh"), "fresh").collect()) == [s for s in range(20) if s not in (3, 11)]


# -- payloads ------------------------------------------------------------------


def test_payload_round_trip_and_broken_payloads(spark):
    schema = flat_schema("a long, b string")
    good = spark.createDataFrame([(1, "x" * 200)], "a long, b string").select(pl.encode_payload("a", "b").alias("t")).first().t
    rows = [("text", good, None), ("text", "no base64!", None), ("bytes", None, b'{"a": 2, "b": "y"}'), ("bytes", None, b"{"), ("text", None, None)]
    df = spark.createDataFrame(rows, "kind string, text string, raw binary")
    none = F.lit(None).cast(schema)
    d = df.select(pl.decode_payload(F.col("kind"), F.col("text"), F.col("raw"), none, schema).alias("d"))
    assert [None if r.d is None else (r.d.a, r.d.b) for r in d.collect()] == [(1, "x" * 200), None, (2, "y"), None, None]
    bad = spark.createDataFrame([("drawing", "", None)], "kind string, text string, raw binary")
    with pytest.raises(Exception, match="cannot decode payload kind drawing"):
        bad.select(pl.decode_payload(F.col("kind"), F.col("text"), F.col("raw"), none, schema).alias("d")).collect()


def test_trees_learn_what_naive_bayes_cannot_forget(spark):
    """Both learners through the same steps; the tree follows a threshold exactly."""
    from polyphon.plans.learners import bag_batches, learner

    df = spark.range(800).selectExpr(
        "id AS instance_id", "id AS seq", "1D AS weight", "double(id * 7 % 10) AS x", "if(id % 3 = 0, 'p', 'q') AS n",
        "if(id * 7 % 10 <= 4, 'a', 'b') AS label",
    )
    batches = [df.where("seq < 400"), df.where("seq >= 400")]
    tree = learner("hoeffding", SPEC, edges={"x": (2.0, 4.0, 6.0)}, grace=50, max_split_nodes=4)
    state = bag_batches(batches, tree, 3, seed=2)
    assert state.depth == 1 and state.nodes.count() == 9
    scored = tree.votes(st.ensemble_fanout(df, 3), state, 3)
    best = vt.with_argmax(vt.flat_combine(scored, 2, keys=("instance_id", "label")), 2)
    assert best.where("if(pred_index = 0, 'a', 'b') <> label").isEmpty()
    bayes = learner("nb", SPEC)
    state = bag_batches(batches, bayes, 3, seed=2)
    assert bayes.votes(st.ensemble_fanout(df, 3), state, 3).count() == 2400
    with pytest.raises(ValueError):
        learner("nb", SPEC, grace=3)
    with pytest.raises(ValueError):
        learner("forest", SPEC)


def test_model_and_evaluator_are_replaced_on_their_own(spark):
    rows = [(i, {4: "model", 9: "evaluator"}.get(i, "instance")) for i in range(12)]
    df = spark.createDataFrame(rows, "seq long, kind string")
    trained, judged = vs.replace_in_stream(df)
    assert sorted(r.seq for r in trained.collect()) == [5, 6, 7, 8, 10, 11]
    assert sorted(r.seq for r in judged.collect()) == [10, 11]
    with pytest.raises(Exception, match="unknown kind picture"):
        vs.known_kinds(spark.createDataFrame([(1, "picture")], "seq long, kind string"), "kind").collect()


def test_latest_value_is_carried_over_empty_ranges(spark):
    rows = [(i, {3: 30, 40: 7, 41: 5}.get(i)) for i in range(0, 400, 1)]
    df = spark.createDataFrame(rows, "seq long, v long")
    got = {r.seq: r.at for r in running(df, "seq", [Running("at", "v", "last")], bucket_rows=8).collect()}
    assert got == {i: None if i < 3 else 30 if i < 40 else 7 if i < 41 else 5 for i in range(400)}
