"""Accuracy of predictions: whole stream, sliding window, steps, test-then-train."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from polyphon.functions.sqlexpr import add, name, text

from polyphon.operators import naive_bayes as nb
from polyphon.operators.prefix import BUCKET_ROWS, Running, running, sliding_sums
from polyphon.operators.votes import vote_cols
from polyphon.sources.instances import FeatureSpec
from polyphon.sources.workspace import materialize


def confusion(scored: DataFrame, truth: str = "truth", pred: str = "pred", weight: str = "weight") -> DataFrame:
    return scored.groupBy(truth, pred).agg(F.sum(weight).alias("w"))


def basic_evaluator(scored: DataFrame, truth: str = "truth", pred: str = "pred", weight: str = "weight") -> DataFrame:
    """Weighted accuracy and kappa of ``(truth, pred, weight)`` rows, as one row.

    The rows shrink to a classes × classes table first; marginals and agreement
    are taken from that.
    """
    cells = confusion(scored, truth, pred, weight)
    # Each cell speaks for its true and for its predicted class, so the scored
    # rows are gone through once.
    t, p = name(truth), name(pred)
    roles = cells.selectExpr(
        f"inline(array(named_struct('c', {t}, 't', w, 'p', 0D, 'd', if({t} = {p}, w, 0D)), "
        f"named_struct('c', {p}, 't', 0D, 'p', w, 'd', 0D)))"
    )
    per_class = roles.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("d").alias("d"))
    sums = per_class.agg(F.sum("t").alias("n"), F.sum("d").alias("agree"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    accuracy = F.try_divide(F.col("agree"), F.col("n"))
    chance = F.try_divide(F.col("tp"), F.col("n") * F.col("n"))
    return sums.select(
        F.coalesce(F.col("n"), F.lit(0.0)).alias("instances"),
        accuracy.alias("accuracy"),
        F.try_divide(accuracy - chance, 1 - chance).alias("kappa"),
    )


def window_evaluator(scored: DataFrame, width: int = 1000, index: str = "seq", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Accuracy over the last ``width`` instances at each instance.

    ``index`` is the stream's gapless number; ``scored`` has ``correct`` (0/1)
    and ``weight``.
    """
    return sliding_sums(
        scored,
        index,
        width,
        {"_good": "weight * correct", "_all": "weight"},
        bucket_rows=bucket_rows,
    ).withColumn("window_accuracy", F.try_divide(F.col("_good"), F.col("_all"))).drop("_good", "_all")


def learning_curve(scored: DataFrame, step: int, index: str = "seq") -> DataFrame:
    """Accuracy of each run of ``step`` instances."""
    return (
        scored.groupBy(F.expr(f"`{index}` div {step}").alias("step_no"))
        .agg(F.sum("weight").alias("instances"), F.sum(F.col("weight") * F.col("correct")).alias("_good"))
        .withColumn("accuracy", F.col("_good") / F.col("instances"))
        .drop("_good")
    )


def prequential(instances: DataFrame, spec: FeatureSpec, bucket_rows: int = BUCKET_ROWS, inclusive: bool = False) -> DataFrame:
    """Test-then-train for naive Bayes: score each row with all rows before it.

    The model before row i is a set of sums over rows 0 … i-1, so one pass of
    exclusive running sums gives every row its own model; the vote is then
    arithmetic on the row. Adds the vote vector (all zero for the first row).
    ``inclusive`` trains on row i first and then scores it.

    An open attribute has running sums of its own, keyed by its value and cut
    into bounded ranges within a value; its number of different values so far
    counts the row's own.
    """
    w, label = name(spec.weight), name(spec.label)
    kept = [name(c) for c in instances.columns]
    aggs = []
    for j, a in enumerate(spec.open):
        own = [Running(f"_o_{i}_{j}", f"if({label} = {text(c)}, {w}, 0D)") for i, c in enumerate(spec.classes)]
        own.append(Running(f"_met_{j}", "1L"))
        instances = running(instances, "seq", own, keys=[a], exclusive=not inclusive, bucket_rows=bucket_rows)
        instances = materialize(instances, "prequential-open")
        first = f"{name(a)} IS NOT NULL AND _met_{j} = {1 if inclusive else 0}"
        # One more than before when the row's own value is new.
        instances = add(instances, {f"_new_{j}": f"if({first}, 1D, 0D)"})
        aggs.append(Running(f"_V_{j}", f"_new_{j}"))
    for i, c in enumerate(spec.classes):
        mine = f"{label} = {text(c)}"
        aggs.append(Running(f"_n_{i}", f"if({mine}, {w}, 0D)"))
        for j, a in enumerate(spec.numeric):
            x = name(a)
            seen = f"{mine} AND {x} IS NOT NULL"
            aggs += [
                Running(f"_w_{i}_{j}", f"if({seen}, {w}, 0D)"),
                Running(f"_wx_{i}_{j}", f"if({seen}, {w} * {x}, 0D)"),
                Running(f"_wxx_{i}_{j}", f"if({seen}, {w} * {x} * {x}, 0D)"),
            ]
        for j, (a, values) in enumerate(spec.nominal.items()):
            for k, v in enumerate(values):
                aggs.append(Running(f"_c_{i}_{j}_{k}", f"if({mine} AND {name(a)} = {text(v)}, {w}, 0D)"))
    state = running(instances, "seq", aggs, exclusive=not inclusive, bucket_rows=bucket_rows)
    moments = {"_n": " + ".join(f"_n_{i}" for i in range(len(spec.classes)))}
    for i in range(len(spec.classes)):
        for j in range(len(spec.numeric)):
            mu, var = nb.gaussian(f"nullif(_w_{i}_{j}, 0D)", f"_wx_{i}_{j}", f"_wxx_{i}_{j}")
            moments |= {f"_mu_{i}_{j}": mu, f"_var_{i}_{j}": var}
    # A step of its own: mean and variance are used several times below.
    state = add(state, moments)
    logs = []
    for i in range(len(spec.classes)):
        terms = [f"if(_n_{i} > 0, ln(_n_{i} / _n), NULL)"]
        for j, a in enumerate(spec.numeric):
            d = f"({name(a)} - _mu_{i}_{j})"
            terms.append(f"coalesce(-0.5D * ln({nb.TWO_PI} * _var_{i}_{j}) - {d} * {d} / (2D * _var_{i}_{j}), 0D)")
        for j, (a, values) in enumerate(spec.nominal.items()):
            arms = " ".join(f"WHEN {text(v)} THEN _c_{i}_{j}_{k}" for k, v in enumerate(values))
            seen = f"CASE {name(a)} {arms} ELSE 0D END" if values else "0D"
            terms.append(f"if({name(a)} IS NULL, 0D, ln(({seen} + 1D) / (_n_{i} + {len(values)}D)))")
        for j, a in enumerate(spec.open):
            values = f"_V_{j}" if inclusive else f"(_V_{j} + _new_{j})"
            terms.append(f"if({name(a)} IS NULL, 0D, ln((_o_{i}_{j} + 1D) / (_n_{i} + {values})))")
        logs.append(" + ".join(terms))
    return nb.votes_from_logs(state, logs).selectExpr(*kept, *vote_cols(len(spec.classes)))
