"""Running aggregates over one global order, without a one-task window.

A window that has an order but no partition runs in a single task. Here the
stream number is cut into ranges of ``bucket_rows`` numbers. Numbers are unique
in a stream, so a range holds at most ``bucket_rows`` rows, however the data is
skewed. Each range gets its own window; the ranges' totals get the same
treatment one level up, and are joined back on the range. The rows are shuffled
once: the window and the join use the same keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from polyphon.functions.sqlexpr import add, name

BUCKET_ROWS = 4096


@dataclass(frozen=True)
class Running:
    """One running aggregate: output name, input (SQL text) and how to combine.

    ``last`` carries the latest value that is not null.
    """

    name: str
    value: str
    how: str = "sum"  # "sum", "max" or "last"

    def over(self, column: str) -> str:
        """The aggregate as used in an ordered window."""
        return f"last({column}, true)" if self.how == "last" else f"{self.how}({column})"

    def total(self, column: str, order: str) -> str:
        """The aggregate of a whole range; its buffers are plain numbers, so it hashes."""
        if self.how == "last":
            return f"max_by({column}, if({column} IS NULL, NULL, {order}))"
        return f"{self.how}({column})"

    def merge(self, before: str, here: str) -> str:
        if self.how == "max":
            return f"greatest({before}, {here})"
        if self.how == "last":
            return f"coalesce({here}, {before})"
        # A sum over nothing is 0 for the caller.
        return f"coalesce({before}, 0) + coalesce({here}, 0)"


def range_of(order: str, size: int) -> str:
    """Whole-number range of a stream number; exact for all 64-bit numbers."""
    return f"{name(order)} div {size}L"


def running(
    df: DataFrame,
    order: str,
    aggs: list[Running],
    keys: list[str] | None = None,
    exclusive: bool = False,
    bucket_rows: int = BUCKET_ROWS,
    tie: list[str] | None = None,
) -> DataFrame:
    """Append running aggregates in ``order`` (a whole number, unique per key).

    ``keys`` start separate streams. ``exclusive`` leaves out the current row.
    ``tie`` (SQL text) orders the few rows that share one number.

    The source is read twice (rows, and range totals that combine map-side), so
    an expensive source should be written out first.
    """
    kept = [name(c) for c in df.columns]
    steps = {"_bucket": range_of(order, bucket_rows)}
    # The keys travel as one struct, which is never null itself: plain equality
    # then also matches null keys, and window and join share one shuffle.
    if keys:
        steps["_key"] = f"struct({', '.join(name(k) for k in keys)})"
    keys = ["_key"] if keys else []
    inputs = {f"_in{i}": a.value for i, a in enumerate(aggs)}
    bucketed = add(df, steps)
    prepared = add(bucketed, inputs)
    # The rows are shuffled and sorted as they came; a hundred inputs are worked out behind that.
    orders = [F.expr(t.removesuffix(" DESC")).desc() if t.endswith(" DESC") else F.expr(t) for t in (tie or [])]
    placed = bucketed.repartition(*keys, "_bucket").sortWithinPartitions(*keys, "_bucket", F.col(name(order)), *orders)

    part = ", ".join([*keys, "_bucket"])
    by = ", ".join([name(order), *(tie or [])])
    upto = "1 PRECEDING" if exclusive else "CURRENT ROW"
    over = f"OVER (PARTITION BY {part} ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})"
    rows = add(placed, inputs).selectExpr(*kept, *keys, "_bucket", *[f"{a.over(f'_in{i}')} {over} AS _run{i}" for i, a in enumerate(aggs)])

    totals = prepared.groupBy(*keys, "_bucket").agg(*[F.expr(f"{a.total(f'_in{i}', name(order))} AS _tot{i}") for i, a in enumerate(aggs)])
    offsets = _bucket_offsets(totals, aggs, keys, bucket_rows)

    joined = rows.join(offsets, [*keys, "_bucket"], "left")
    return joined.selectExpr(*kept, *[f"{a.merge(f'_off{i}', f'_run{i}')} AS {name(a.name)}" for i, a in enumerate(aggs)])


def _bucket_offsets(totals: DataFrame, aggs: list[Running], keys: list[str], fan: int) -> DataFrame:
    """Aggregate of all earlier ranges, for each range: the same scheme one level up.

    With n rows the top window sees n / bucket_rows² totals per key.
    """
    leveled = add(totals, {"_group": range_of("_bucket", fan)})
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    over = f"OVER (PARTITION BY {', '.join([*keys, '_group'])} ORDER BY _bucket {frame})"
    local = leveled.selectExpr(*keys, "_group", "_bucket", *[f"{a.over(f'_tot{i}')} {over} AS _loc{i}" for i, a in enumerate(aggs)])
    top = leveled.groupBy(*keys, "_group").agg(*[F.expr(f"{a.total(f'_tot{i}', '_bucket')} AS _gt{i}") for i, a in enumerate(aggs)])
    # An unkeyed stream has one top group per bucket_rows² rows: this small
    # remainder is one window, and a constant key says so.
    top_over = f"OVER (PARTITION BY {keys[0] if keys else '0'} ORDER BY _group {frame})"
    top = top.selectExpr(*keys, "_group", *[f"{a.over(f'_gt{i}')} {top_over} AS _up{i}" for i, a in enumerate(aggs)])
    joined = local.join(top, [*keys, "_group"], "left")
    return joined.selectExpr(*keys, "_bucket", *[f"{a.merge(f'_up{i}', f'_loc{i}')} AS _off{i}" for i, a in enumerate(aggs)])


def sliding_sums(df: DataFrame, index: str, width: int, sums: dict[str, str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Sums over the last ``width`` rows by ``index`` (a gapless row number).

    Each range of rows also gets a copy of the ``width - 1`` rows before it, so
    one shuffle is enough. A frame of ``width`` rows would add all of them again
    for every row; the difference of two running sums costs the same for any
    width. ``sums`` maps a name to its input (SQL text).
    """
    size = max(bucket_rows, width)
    kept = [name(c) for c in df.columns]
    homed = add(df, {"_home": range_of(index, size)} | {f"_in{i}": v for i, v in enumerate(sums.values())})
    # The last width - 1 rows of a range are copied into the next one.
    copies = add(
        homed, {"_bucket": f"explode(if(pmod({name(index)}, {size}) >= {size - (width - 1)}, array(_home, _home + 1), array(_home)))"}
    )
    over = f"PARTITION BY _bucket ORDER BY {name(index)}"
    run = copies.selectExpr(
        *kept, "_home", "_bucket",
        *[f"sum(_in{i}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _run{i}" for i in range(len(sums))],
    )
    out = run.selectExpr(
        *kept, "_home", "_bucket",
        *[f"_run{i} - coalesce(lag(_run{i}, {width}) OVER ({over}), 0) AS {name(n)}" for i, n in enumerate(sums)],
    )
    return out.where("_bucket = _home").drop("_home", "_bucket")


def row_index(df: DataFrame, order: str, keys: list[str] | None = None, name: str = "row_idx", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Gapless row number from 0 in ``order``, per key."""
    return running(df, order, [Running(name, "1L")], keys=keys, bucket_rows=bucket_rows).withColumn(name, F.col(name) - 1)
