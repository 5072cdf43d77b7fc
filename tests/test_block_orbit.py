"""Chains found block by block against plain Python."""

import random

import pytest

from polyphon.operators import orbit as ob

BIG = 1 << 60


@pytest.mark.parametrize("far", [3, 40])
def test_block_orbit(monkeypatch, spark, far):
    """Several levels of blocks; targets without a row, missing ends, keys of one row and without a name."""
    r = random.Random(far)
    rows, want = [], set()
    for key in ("a", "b", "c", None):
        at = sorted(r.sample(range(0, 900), 1 if key == "c" else 300))
        nxt = {p: r.choice([None, p + 1000]) if p == at[-1] else next((q for q in at if q > p + far), None) for p in at}
        if key == "b":
            nxt[at[200]] = at[200] + 1 if at[200] + 1 not in nxt else None
        rows += [(key, BIG + p, None if n is None else BIG + n) for p, n in nxt.items()]
        p = at[0]
        while key is not None and p in nxt:
            want.add((key, BIG + p))
            p = nxt[p]
    r.shuffle(rows)
    monkeypatch.setattr(ob, "orbit", lambda *a: pytest.fail("the blocks' exits are few"))
    frame = spark.createDataFrame(rows, "k string, p long, n long")
    for size in (150, 10_000):
        got = ob.block_orbit(frame, "k", "p", "n", block_rows=size).collect()
        assert {(x.k, x.p) for x in got} == want and len(got) == len(want)


def test_far_jumps_are_doubled(spark):
    rows = [("a", p, p + 90) for p in range(200)]
    got = ob.block_orbit(spark.createDataFrame(rows, "k string, p long, n long"), "k", "p", "n", block_rows=20).collect()
    assert sorted(x.p for x in got) == [0, 90, 180]
