"""Vote sets that are forgotten a fixed time after their first vote."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TIMEOUT_MS = 30_000
BUCKETS = 256
SET_SCHEMA = "instance_id long, first_ms long, n_votes long, complete boolean"
OPEN_SCHEMA = "ids array<bigint>, firsts array<bigint>, counts array<bigint>"


def vote_sets(ensemble: int, timeout_ms: int):
    """The step of one bucket of instances: takes its votes, or the end of its time, and gives the sets that close.

    Its state is the open sets, each with its start and its votes so far: two numbers,
    and nothing for an instance without an open set. Votes of an instance count in the
    order they arrive, by time within one arrival. A set is emitted when it is complete,
    or when its time is up (incomplete). The bucket's timer is at the end of the set
    that ends first.
    """

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sets = {i: (first, n) for i, first, n in zip(*state.get)} if state.exists else {}
        out = []
        # One arrival may come in several chunks, in any order.
        arrived = [] if state.hasTimedOut else list(chunks)
        if arrived:
            votes = pd.concat(arrived).sort_values(["ts_ms", "n_votes"])
            for no_id, i, ts, n_votes in zip(*(votes[c].tolist() for c in ("no_id", "id", "ts_ms", "n_votes"))):
                i = None if no_id else i
                first, n = sets.get(i, (ts, 0))
                if ts >= first + timeout_ms:
                    out.append((i, first, n, False))
                    first, n = ts, 0
                n += n_votes
                if n == ensemble:
                    out.append((i, first, n, True))
                    sets.pop(i, None)
                else:
                    sets[i] = (first, n)
        now = state.getCurrentWatermarkMs()
        for i in [i for i, (first, _) in sets.items() if first + timeout_ms <= now]:
            out.append((i, *sets.pop(i), False))
        if sets:
            firsts = [first for first, _ in sets.values()]
            state.update((list(sets), firsts, [n for _, n in sets.values()]))
            state.setTimeoutTimestamp(min(firsts) + timeout_ms)
        elif state.exists:
            state.remove()
        if not out:
            return
        # Whole numbers as they are: next to the empty rows that Spark adds, a numeric column would become double.
        yield pd.DataFrame(out, columns=["instance_id", "first_ms", "n_votes", "complete"], dtype=object)

    return step


def vote_timeout_stream(
    votes: DataFrame, ensemble: int, timeout_ms: int = TIMEOUT_MS, delay: str = "10 seconds", buckets: int = BUCKETS
) -> DataFrame:
    """Vote sets of a stream of ``instance_id, ts, n_votes`` rows, by event time.

    Open sets are emitted as incomplete once the watermark has passed their end.
    Instances are kept in ``buckets`` groups, so that Python is called once per bucket
    and batch, not once per instance; a batch's votes and the open sets of one bucket
    are held in memory. A checkpoint belongs to its number of buckets.
    """
    timed = votes.withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts"))
    # A null would turn the ids of its chunk into doubles.
    rows = timed.selectExpr(
        f"cast(pmod(xxhash64(instance_id), {buckets}L) AS INT) AS bucket",
        "coalesce(instance_id, 0L) AS id", "instance_id IS NULL AS no_id", "ts", "ts_ms", "n_votes",
    )
    return rows.groupBy("bucket").applyInPandasWithState(
        vote_sets(ensemble, timeout_ms), SET_SCHEMA, OPEN_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )


def vote_timeout(votes: DataFrame, ensemble: int, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """Vote sets of a finished stream: ``instance_id, first_ms, n_votes, complete``.

    A set opens with a vote and takes the votes of the following ``timeout_ms``
    (exclusive). It closes when it has ``ensemble`` votes, else when its time is
    up; the next vote opens another one, as in the streaming form. One shuffle
    brings an instance's votes together (every member sends it one per set), and
    a fold over their time order cuts them into sets.
    """
    lists = votes.groupBy("instance_id").agg(F.expr("array_sort(collect_list(struct(ts_ms, n_votes))) AS _votes"))
    one = "array(named_struct('first_ms', {}, 'n_votes', {}, 'complete', {}))".format
    none = "cast(array() AS array<struct<first_ms: bigint, n_votes: bigint, complete: boolean>>)"
    late = f"(s.first IS NOT NULL AND v.ts_ms >= s.first + {timeout_ms}L)"
    first, n = f"if({late}, v.ts_ms, coalesce(s.first, v.ts_ms))", f"(if({late}, 0L, s.n) + v.n_votes)"
    full = f"{n} = {ensemble}"
    step = (
        f"named_struct('first', if({full}, NULL, {first}), 'n', if({full}, 0L, {n}), "
        f"'sets', concat(s.sets, if({late}, {one('s.first', 's.n', 'false')}, {none}), if({full}, {one(first, n, 'true')}, {none})))"
    )
    start = f"named_struct('first', cast(NULL AS BIGINT), 'n', 0L, 'sets', {none})"
    end = f"concat(s.sets, if(s.first IS NULL, {none}, {one('s.first', 's.n', 'false')}))"
    return lists.selectExpr("instance_id", f"inline(aggregate(_votes, {start}, (s, v) -> {step}, s -> {end}))")
