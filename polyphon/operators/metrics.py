"""Throughput, latency and progress of vote streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from polyphon.operators.orbit import block_orbit
from polyphon.operators.prefix import BUCKET_ROWS, Running, running
from polyphon.sources.workspace import materialize

PERIOD_MS = 60_000


def throughput_tumbling(events: DataFrame, counter: str, batch_size: int = 100, period_ms: int = PERIOD_MS, start: str = "epoch") -> DataFrame:
    """Instances per second of each counter, for each period.

    An event stands for a batch of ``batch_size`` instances. Periods are aligned
    to the clock (``epoch``) or to the counter's first event (``first``).
    ``events`` has ``ts_ms``.
    """
    if start == "first":
        # One row per counter; the minimum is combined before its shuffle.
        t0 = events.groupBy(counter).agg(F.min("ts_ms").alias("_t0"))
        events = events.join(t0, counter)
    else:
        events = events.withColumn("_t0", F.lit(0).cast("long"))
    no = F.expr(f"(ts_ms - _t0) div {period_ms}L")
    return (
        events.groupBy(counter, (F.col("_t0") + no * period_ms).alias("window_start_ms"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .withColumn("per_second", F.expr(f"n_events * {batch_size} * 1000 div {period_ms}"))
    )


def throughput_rearmed(events: DataFrame, counter: str, order: str = "seq", batch_size: int = 100, period_ms: int = PERIOD_MS) -> DataFrame:
    """The same rate with periods that re-arm on traffic.

    A period opens with an event and closes with the first event more than
    ``period_ms`` later, which is still counted; the next period starts at that
    moment. The rate divides by the real length. ``order`` is a gapless row
    number per counter along which ``ts_ms`` never falls. An unfinished period
    is not reported.
    """
    # Written: the moments and their ends are read by every step that follows.
    moments = materialize(events.groupBy(counter, "ts_ms").agg(F.min(order).alias("_row")), "rearmed-moments")
    ends = materialize(first_later(moments.select(counter, "ts_ms"), counter, period_ms), "rearmed-ends")
    opens = block_orbit(ends, counter, "ts_ms", "_next_ms")
    ends = ends.where(F.col("_next_ms").isNotNull())
    close_row = moments.select(counter, F.col("ts_ms").alias("_next_ms"), F.col("_row").alias("_close"))
    t0 = moments.groupBy(counter).agg(F.min("ts_ms").alias("_t0"))
    # Rows (open, close] belong to a period, and the very first row as well.
    return (
        opens.join(ends, [counter, "ts_ms"])
        .join(moments, [counter, "ts_ms"])
        .join(close_row, [counter, "_next_ms"])
        .join(t0, counter)
        .withColumn("n_events", F.col("_close") - F.col("_row") + F.when(F.col("ts_ms") == F.col("_t0"), 1).otherwise(0))
        .withColumn("elapsed_ms", F.col("_next_ms") - F.col("ts_ms"))
        .select(
            counter,
            F.col("ts_ms").alias("window_start_ms"),
            "n_events",
            "elapsed_ms",
            F.expr(f"n_events * {batch_size} * 1000 div elapsed_ms").alias("per_second"),
        )
    )


def first_later(moments: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """For each distinct (key, ts_ms): the key's first moment more than ``gap_ms`` later.

    Moments, and probes at ``ts_ms + gap_ms``, go through one descending time
    order; the smallest moment seen so far is the first one later.
    """
    rows = moments.select(key, (-F.col("ts_ms")).alias("_down"), F.lit(0).alias("_probe"))
    probes = moments.select(key, (-(F.col("ts_ms") + gap_ms)).alias("_down"), F.lit(1).alias("_probe"))
    seen = running(
        rows.unionByName(probes),
        "_down",
        [Running("_best", "CASE WHEN _probe = 0 THEN _down END", how="max")],
        keys=[key],
        # At one time the probe comes first: it must not see its own moment.
        tie=["_probe DESC"],
    )
    return seen.where(F.col("_probe") == 1).select(
        key, (-F.col("_down") - gap_ms).alias("ts_ms"), (-F.col("_best")).alias("_next_ms")
    )


def ack_throughput(acks: DataFrame, component: str, tracked: list[str], batch_size: int = 100, period_ms: int = PERIOD_MS, start: str = "epoch") -> DataFrame:
    """Throughput driven by acknowledgements of the tracked components only."""
    return throughput_tumbling(acks.where(F.col(component).isin(tracked)), component, batch_size, period_ms, start)


def throughput_warmup(events: DataFrame, counter: str, delay_ms: int = PERIOD_MS, period_ms: int = PERIOD_MS) -> DataFrame:
    """Per cycle of warm-up plus measurement: events in the measured part.

    Cycles run from the counter's first event. Events up to ``delay_ms`` into a
    cycle are not counted.
    """
    t0 = events.groupBy(counter).agg(F.min("ts_ms").alias("_t0"))
    cycle = delay_ms + period_ms
    off = F.col("ts_ms") - F.col("_t0")
    # Offsets count from 1 ms: the last millisecond of a cycle is measured.
    return (
        events.join(t0, counter)
        .withColumn("_into", F.when(off == 0, F.lit(0)).otherwise(F.pmod(off - 1, F.lit(cycle)) + 1))
        .withColumn("cycle", F.when(off == 0, F.lit(0)).otherwise(F.expr(f"(ts_ms - _t0 - 1) div {cycle}L")))
        .where(F.col("_into") > delay_ms)
        .groupBy(counter, "cycle")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


def emit_latency(votes: DataFrame, combiner: str, order: str, every: int = 10_000, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Mean delay since the start of each combiner, at each ``every``-th vote.

    ``votes`` has ``delay_ms`` (arrival minus emission). The mean is whole
    milliseconds. Votes that share a place in ``order`` count by their delay.
    """
    r = running(
        votes.select(combiner, order, "delay_ms"),
        order,
        [Running("n", "1L"), Running("_sum", "delay_ms")],
        keys=[combiner],
        bucket_rows=bucket_rows,
        tie=["delay_ms"],
    )
    return r.where(F.col("n") % every == 0).select(combiner, "n", F.expr("_sum div n").alias("mean_delay_ms"))


def pending_stats(sets: DataFrame, ensemble: int) -> DataFrame:
    """Open vote sets, and how many of them have exactly two votes.

    ``sets`` has one row per instance with ``n_votes``.
    """
    return sets.where(F.col("n_votes") < ensemble).agg(
        F.count(F.lit(1)).alias("pending"), F.count_if(F.col("n_votes") == 2).alias("with_two")
    )


def span_per_n(events: DataFrame, index: str, n: int = 25_000) -> DataFrame:
    """Elapsed time of each full run of n events, and the age of the run's last.

    ``events`` has ``ts_ms`` (arrival), ``sent_ms`` and a gapless row number from
    1. Elapsed time runs from the last event of the run before.
    """
    run = F.expr(f"(`{index}` - 1) div {n}L")
    per_run = events.groupBy(run.alias("run")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.max_by(F.col("ts_ms") - F.col("sent_ms"), index).alias("age_ms"),
    )
    return per_run.where(F.col("n_events") == n).select("run", "n_events", (F.col("last_ms") - F.col("first_ms")).alias("span_ms"), "age_ms")


def run_summary(events: DataFrame) -> DataFrame:
    """Instances, seconds and instances per second of a run."""
    s = events.agg(F.count(F.lit(1)).alias("instances"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("seconds"))
    return s.withColumn("per_second", F.try_divide(F.col("instances"), F.col("seconds")))


def processed_stats(counters: DataFrame) -> DataFrame:
    """Instances processed by all learners; 0 when there is no state yet."""
    return counters.agg(F.coalesce(F.sum("trained_n"), F.lit(0)).cast("long").alias("processed"))
