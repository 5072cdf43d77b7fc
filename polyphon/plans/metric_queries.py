"""Queries of throughput, latency, progress and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyphon.functions.timeutil import epoch_ms
from polyphon.functions.weights import with_poisson_weight
from polyphon.operators import metrics as mt
from polyphon.operators import naive_bayes as nb
from polyphon.operators.prefix import row_index
from polyphon.operators.streams import ensemble_fanout
from polyphon.plans import sqltext as q
from polyphon.plans.common import BOOST, ENSEMBLE, SEED, delayed_votes, events, order_votes, stream_cut
from polyphon.plans.registry import query
from polyphon.plans.training_queries import ALL_BAG
from polyphon.plans.vote_queries import ORDER_VOTES
from polyphon.sources import channels
from polyphon.sources.instances import read_table
from polyphon.sources.workspace import new_folder
from polyphon.streaming.training import rolling_reduce as rolling_reduce_op

HOUR = 3_600_000


def _counted(spark, sf_dir):
    return events(spark, sf_dir).select("seq", "ts_ms", F.col("label").alias("counter"))


@query(
    "processed_stats",
    q.with_(*ALL_BAG) + "SELECT count(*) AS processed FROM bag",
)
def processed_stats(spark, sf_dir):
    fanned = ensemble_fanout(events(spark, sf_dir).select("instance_id", "weight"), ENSEMBLE)
    return mt.processed_stats(nb.trained_count(with_poisson_weight(fanned, seed=SEED)))


@query(
    "throughput_tumbling",
    q.with_(q.INST) + """SELECT label AS counter, (ts_ms // 60000) * 60000 AS window_start_ms, count(*) AS n_events,
    count(*) * 100 * 1000 // 60000 AS per_second FROM inst GROUP BY ALL""",
)
def throughput_tumbling(spark, sf_dir):
    return mt.throughput_tumbling(_counted(spark, sf_dir), "counter")


@query(
    "throughput_first_event",
    q.with_(q.INST, "t0 AS (SELECT label, min(ts_ms) AS t0 FROM inst GROUP BY label)")
    + """SELECT label AS counter, t0 + ((ts_ms - t0) // 3600000) * 3600000 AS window_start_ms, count(*) AS n_events,
    count(*) * 100 * 1000 // 3600000 AS per_second FROM inst JOIN t0 USING (label) GROUP BY ALL""",
)
def throughput_first_event(spark, sf_dir):
    """Hourly periods that start at each counter's first event."""
    return mt.throughput_tumbling(_counted(spark, sf_dir), "counter", period_ms=HOUR, start="first")


@query(
    "throughput_rearmed",
    q.with_(
        q.INST,
        "e AS MATERIALIZED (SELECT label, ts_ms, row_number() OVER (PARTITION BY label ORDER BY seq) AS rn FROM inst)",
        """nx AS MATERIALIZED (SELECT e.label, e.ts_ms, e.rn, n.ts_ms AS close_ms, n.rn AS close_rn FROM e ASOF LEFT JOIN e n ON n.label = e.label AND n.ts_ms > e.ts_ms + 3600000)""",
        """ch AS (SELECT label, ts_ms, rn, close_ms, close_rn FROM nx WHERE rn = 1
      UNION ALL SELECT n.label, n.ts_ms, n.rn, n.close_ms, n.close_rn FROM ch JOIN nx n ON n.label = ch.label AND n.rn = ch.close_rn)""",
    )
    + """SELECT label AS counter, ts_ms AS window_start_ms, close_rn - rn + CASE WHEN rn = 1 THEN 1 ELSE 0 END AS n_events,
    close_ms - ts_ms AS elapsed_ms, (close_rn - rn + CASE WHEN rn = 1 THEN 1 ELSE 0 END) * 100 * 1000 // (close_ms - ts_ms) AS per_second
    FROM ch WHERE close_ms IS NOT NULL""",
)
def throughput_rearmed(spark, sf_dir):
    """Periods of an hour that re-arm at the event that closed the last one."""
    numbered = row_index(_counted(spark, sf_dir), "seq", keys=["counter"], name="rn")
    return mt.throughput_rearmed(numbered, "counter", order="rn", period_ms=HOUR)


@query(
    "ack_throughput",
    q.with_(q.INST) + """SELECT label AS component, (ts_ms // 60000) * 60000 AS window_start_ms, count(*) AS n_events,
    count(*) * 100 * 1000 // 60000 AS per_second FROM inst WHERE label IN ('click', 'view') GROUP BY ALL""",
)
def ack_throughput(spark, sf_dir):
    acks = _counted(spark, sf_dir).withColumnRenamed("counter", "component")
    return mt.ack_throughput(acks, "component", ["click", "view"])


@query(
    "throughput_warmup",
    q.with_(q.INST, "t0 AS (SELECT label, min(ts_ms) AS t0 FROM inst GROUP BY label)", "o AS (SELECT label, ts_ms - t0 AS off FROM inst JOIN t0 USING (label))")
    + "SELECT label AS counter, (off - 1) // 7200000 AS cycle, count(*) AS n_events FROM o WHERE off > 0 AND (off - 1) % 7200000 + 1 > 3600000 GROUP BY ALL",
)
def throughput_warmup(spark, sf_dir):
    """One hour of warm-up, one hour counted, over again."""
    return mt.throughput_warmup(_counted(spark, sf_dir), "counter", delay_ms=HOUR, period_ms=HOUR)


@query(
    "emit_latency",
    q.with_(
        """d AS (SELECT l_suppkey AS combiner, l_shipdate AS ts, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000 AS delay_ms
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
        "l AS (SELECT combiner, row_number() OVER w AS n, sum(delay_ms) OVER w AS s FROM d "
        "WINDOW w AS (PARTITION BY combiner ORDER BY ts, delay_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    )
    + "SELECT combiner, n, CAST(sign(s) * (abs(s) // n) AS BIGINT) AS mean_delay_ms FROM l WHERE n % 100 = 0",
)
def emit_latency(spark, sf_dir):
    """Real delays, from an order's date to the shipping of its lines; some lines ship before."""
    return mt.emit_latency(delayed_votes(spark, sf_dir), "combiner", "ts_ms", every=100)


@query(
    "pending_stats",
    q.with_(ORDER_VOTES, "v AS (SELECT instance_id, count(*) AS n FROM arr GROUP BY instance_id)")
    + f"SELECT count(*) AS pending, count(*) FILTER (WHERE n = 2) AS with_two FROM v WHERE n < {BOOST}",
)
def pending_stats(spark, sf_dir):
    sets = order_votes(spark, sf_dir).groupBy("instance_id").agg(F.sum("n_votes").alias("n_votes"))
    return mt.pending_stats(sets, BOOST)


@query(
    "span_per_n",
    q.with_(q.INST) + """SELECT seq // 1000 AS run, count(*) AS n_events, max(ts_ms) - min(ts_ms) AS span_ms,
    CAST(arg_max(x_k, seq) AS BIGINT) AS age_ms FROM inst GROUP BY ALL HAVING count(*) = 1000""",
)
def span_per_n(spark, sf_dir):
    ev = events(spark, sf_dir).select((F.col("seq") + 1).alias("idx"), "ts_ms", (F.col("ts_ms") - F.col("x_k").cast("long")).alias("sent_ms"))
    return mt.span_per_n(ev, "idx", n=1000)


@query(
    "run_summary",
    q.with_(q.INST) + """SELECT count(*) AS instances, round((max(ts_ms) - min(ts_ms)) / 1000, 6) AS seconds,
    round(count(*) / ((max(ts_ms) - min(ts_ms)) / 1000), 6) AS per_second FROM inst""",
)
def run_summary(spark, sf_dir):
    s = mt.run_summary(events(spark, sf_dir))
    return s.select("instances", F.round("seconds", 6).alias("seconds"), F.round("per_second", 6).alias("per_second"))


@query(
    "rolling_reduce",
    "SELECT event_type, count(*) AS n, sum(round(value * 100)) AS cents, max(event_id) AS last_id FROM events GROUP BY event_type",
)
def rolling_reduce(spark, sf_dir):
    """A streaming aggregate in complete mode, fed in several batches."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    folder = new_folder(spark, "reduce-channel")
    channels.publish_instances(ev, folder, files=4, order="event_id")
    stream = channels.read_channel(spark, folder, ev.schema, files_per_trigger=2)
    return rolling_reduce_op(
        stream, ["event_type"],
        [F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100)).alias("cents"), F.max("event_id").alias("last_id")],
        new_folder(spark, "reduced"), new_folder(spark, "reduce-ckpt"),
    )


@query(
    "throughput_stream",
    "SELECT event_type AS counter, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS window_start_ms, count(*) AS n_events FROM events GROUP BY ALL",
)
def throughput_stream(spark, sf_dir):
    """Tumbling windows over a stream with a watermark, in update mode."""
    from polyphon.streaming.metrics import tumbling_counts

    ev = events(spark, sf_dir).select(
        F.col("seq").alias("event_id"), F.timestamp_millis("ts_ms").alias("ts"), F.col("label").alias("counter")
    )
    folder = new_folder(spark, "throughput-channel")
    # Two calls: a watermark drops what comes late, so the halves must arrive in order.
    half = stream_cut(spark, sf_dir, 0.5)
    channels.publish_instances(ev.where(F.col("event_id") < half), folder, files=2, order="event_id")
    channels.publish_instances(ev.where(F.col("event_id") >= half), folder, files=2, order="event_id")
    stream = channels.read_channel(spark, folder, ev.schema, files_per_trigger=2)
    out = tumbling_counts(stream, "counter", "1 hour", new_folder(spark, "throughput"), new_folder(spark, "throughput-ckpt"))
    return out.select("counter", epoch_ms(out, "window_start").alias("window_start_ms"), "n_events")


# The stream arrives in four parts; rows with a small k come one part later than the others.
ARRIVAL = "CASE WHEN seq < {a} THEN 0 WHEN seq < {b} THEN 1 WHEN seq < {c} THEN 2 ELSE 3 END + CASE WHEN x_k < 10 THEN 1 ELSE 0 END"


@query(
    "throughput_late",
    q.with_(
        q.INST,
        f"a AS MATERIALIZED (SELECT label, ts_ms, ts_ms // {HOUR} * {HOUR} AS win, {ARRIVAL.format(a=q.cut(0.25), b=q.cut(0.5), c=q.cut(0.75))} AS arrival FROM inst)",
        "t AS (SELECT arrival, max(ts_ms) AS top FROM a GROUP BY arrival)",
        "w AS (SELECT x.arrival, max(y.top) - 600000 AS mark FROM t x LEFT JOIN t y ON y.arrival < x.arrival GROUP BY x.arrival)",
    )
    + f"""SELECT label AS counter, win AS window_start_ms, count(*) FILTER (WHERE NOT coalesce(win + {HOUR} <= mark, false)) AS n_events,
    count(*) FILTER (WHERE coalesce(win + {HOUR} <= mark, false)) AS n_late FROM a JOIN w USING (arrival) GROUP BY ALL""",
)
def throughput_late(spark, sf_dir):
    """Hourly counts of events that arrive out of order, with the rows that came too late."""
    from polyphon.streaming.late import count_with_late

    cuts = dict(zip("abc", ("_a", "_b", "_c")))
    ends = {n: stream_cut(spark, sf_dir, s) for n, s in zip(cuts.values(), (0.25, 0.5, 0.75))}
    ev = events(spark, sf_dir).withColumns(ends).selectExpr("label AS counter", "ts_ms", f"{ARRIVAL.format(**cuts)} AS arrival")
    folder = new_folder(spark, "late-channel")
    # One call and one file for each part: a reader takes them in this order, one a batch.
    for n in range(5):
        channels.publish_instances(ev.where(F.col("arrival") == n), folder, files=1, order="ts_ms")
    stream = channels.read_channel(spark, folder, ev.schema, files_per_trigger=1)
    out = count_with_late(stream, "counter", HOUR, new_folder(spark, "late"), new_folder(spark, "late-ckpt"))
    return out.select("counter", "window_start_ms", "n_events", "n_late")
