"""Running sums carry their source's own columns through the shuffle; draws count as the plain loop does."""

import math

from pyspark.sql import functions as F

from polyphon.functions.weights import hash32_text, with_poisson_rate
from polyphon.operators.prefix import Running, running


def test_inputs_are_worked_out_behind_the_shuffle(spark):
    rows = spark.range(50).selectExpr("id AS seq", "id % 3 AS c")
    got = running(rows, "seq", [Running(f"s{i}", f"if(c = {i}, seq, 0L)") for i in range(3)], bucket_rows=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    placed = [i for i, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert placed and not any("_in" in line for line in plan[placed[0] : placed[0] + 2])
    for r in got.collect():
        assert [r.s0, r.s1, r.s2] == [sum(s for s in range(r.seq + 1) if s % 3 == i) for i in range(3)]


def test_draws_equal_the_plain_loop(spark):
    rates = [0.0, 0.3, 1.0, 2.5, 15.9, 16.0, 40.0, 900.0, None]
    rows = spark.createDataFrame([(i, m, r) for i in range(40) for m, r in enumerate(rates)], "instance_id long, member int, rate double")
    hashed = rows.withColumn("hs", F.expr(f"transform(sequence(0L, 99L), p -> {hash32_text('instance_id', '(member + p * 65536L)', 3)})"))
    drawn = with_poisson_rate(hashed, "rate", "member", "k", seed=3)
    assert "ArrowEvalPython" in drawn._jdf.queryExecution().executedPlan().toString()
    for r in drawn.collect():
        if r.rate is None:
            assert r.k is None
            continue
        pieces = max(math.ceil(r.rate / 16), 1)
        share, k = r.rate / pieces, 0
        for h in r.hs[:pieces]:
            term = cdf = math.exp(-share)
            for j in range(1, math.ceil(share + math.sqrt(share) * 8 + 12) + 1):
                k += h / 2**32 >= cdf
                term = term * share / j
                cdf += term
        assert r.k == k
