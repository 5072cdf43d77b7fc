"""Naive Bayes as grouped sums, and scoring as column arithmetic.

Training gathers sufficient statistics per (member, label): weighted counts, and
for each numeric attribute the weighted sums of x and x². They add up, so
Spark's partial aggregation does the work: the shuffle carries one row per
member and label from each task, however many instances there are.

The statistics table is in long form (``member, label, attr, value, w, wx,
wxx``), which is what is versioned, merged and stored. For scoring it is turned
into one wide row per member with every constant worked out, so a vote is a few
additions and multiplications on the instance's own row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from polyphon.functions.sqlexpr import add, name, text
from polyphon.operators.lookup import model_join
from polyphon.sources.instances import FeatureSpec

VARIANCE_FLOOR = 1e-9
ROUNDING = 1e-12
TWO_PI = f"{2 * math.pi!r}D"
CLASS_ATTR = "#class"
STAT_COLUMNS = ["member", "label", "attr", "value", "w", "wx", "wxx"]


def nb_train(weighted: DataFrame, spec: FeatureSpec, weight: str = "w", keys: tuple[str, ...] = ("member",)) -> DataFrame:
    """Sufficient statistics of weighted instances, in long form.

    ``keys`` are the model keys (a member, or a version and a member). Rows of
    attribute ``#class`` hold the class weights. Every value of a nominal
    attribute counts, declared or not, so a header may have any number of them.

    It is one aggregation. A row speaks once for its class, which carries all
    numeric sums, and once for each nominal value it has.
    """
    w, label = name(weight), name(spec.label)
    null_s, null_d = "cast(NULL AS STRING)", "cast(NULL AS DOUBLE)"
    cell = "named_struct('attr', {}, 'value', cast({} AS STRING))".format
    said = [cell(text(CLASS_ATTR), null_s), *(cell(text(a), name(a)) for a in [*spec.nominal, *spec.open])]
    numbers = [f"cast({name(a)} AS DOUBLE) AS _x{i}" for i, a in enumerate(spec.numeric)]
    tall = weighted.selectExpr(*keys, f"{label} AS label", f"{w} AS _w", *numbers, f"inline(array({', '.join(said)}))")
    own = f"attr = {text(CLASS_ATTR)}"
    sums = [F.expr("sum(_w) AS w")]
    for i in range(len(spec.numeric)):
        seen = f"{own} AND _x{i} IS NOT NULL"
        sums += [
            F.expr(f"sum(if({seen}, _w, NULL)) AS _w{i}"),
            F.expr(f"sum(if({seen}, _w * _x{i}, NULL)) AS _wx{i}"),
            F.expr(f"sum(if({seen}, _w * _x{i} * _x{i}, NULL)) AS _wxx{i}"),
        ]
    wide = tall.where(f"{own} OR value IS NOT NULL").groupBy(*keys, "label", "attr", "value").agg(*sums)
    row = "named_struct('attr', {}, 'value', {}, 'w', {}, 'wx', {}, 'wxx', {})".format
    rows = [row("attr", "value", "w", null_d, null_d)]
    rows += [row(text(a), null_s, f"_w{i}", f"_wx{i}", f"_wxx{i}") for i, a in enumerate(spec.numeric)]
    # A cell that no weight fell into is no row of the table.
    return wide.selectExpr(*keys, "label", f"inline(filter(array({', '.join(rows)}), r -> r.w > 0))")


def single_train(instances: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One learner over the whole stream, with the instances' own weights."""
    return nb_train(instances.withColumn("member", F.lit(0)), spec, weight=spec.weight)


def vector_train(instances: DataFrame, vector: str, label: str = "label", weight: str = "weight") -> DataFrame:
    """Statistics of dense-vector instances: attribute i is the vector's i-th value.

    One row is emitted per value, and combined before the shuffle.
    """
    tall = instances.select(
        F.col(label).alias("label"), F.col(weight).alias("_w"), F.posexplode(vector).alias("pos", "x")
    ).withColumn("x", F.col("x").cast("double"))
    return tall.groupBy("label", "pos").agg(
        F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("x")).alias("wx"), F.sum(F.col("_w") * F.col("x") * F.col("x")).alias("wxx")
    )


def merge_stats(*tables: DataFrame, keys: tuple[str, ...] = ("member",)) -> DataFrame:
    """Sum of statistics tables: the state after training on all their inputs."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.groupBy(*keys, "label", "attr", "value").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"), F.sum("wxx").alias("wxx"))


def trained_count(fanned: DataFrame) -> DataFrame:
    """Instances processed per member.

    Bagging counts only rows with k > 0, and ``with_poisson_weight`` has dropped
    the others already.
    """
    return fanned.groupBy("member").agg(F.count(F.lit(1)).alias("trained_n"))


# -- scoring ---------------------------------------------------------------


def nb_model(stats: DataFrame, spec: FeatureSpec, keys: tuple[str, ...] = ("member",)) -> DataFrame:
    """One row per member with the constants of every class's log vote.

    Columns per class i: ``lp_i`` (log prior, null when the class was never
    seen), ``mu_i_a``, ``iv_i_a``, ``lt_i_a`` for each numeric attribute, and
    ``nv_i_a`` (log probability by value) plus ``nd_i_a`` (of an unseen value)
    for each nominal one; ``cw_i`` is the class's weight, for open attributes.
    """
    is_class = f"attr = {text(CLASS_ATTR)}"
    sums = [f"sum(if({is_class}, w, NULL)) AS _n"]
    for i, c in enumerate(spec.classes):
        mine = f"label = {text(c)}"
        sums.append(f"sum(if({mine} AND {is_class}, w, NULL)) AS _n_{i}")
        for j, a in enumerate(spec.numeric):
            here = f"{mine} AND attr = {text(a)}"
            sums += [f"sum(if({here}, {m}, NULL)) AS _{m}_{i}_{j}" for m in ("w", "wx", "wxx")]
        for j, (a, values) in enumerate(spec.nominal.items()):
            here = f"{mine} AND attr = {text(a)}"
            sums += [f"sum(if({here} AND value = {text(v)}, w, NULL)) AS _c_{i}_{j}_{n}" for n, v in enumerate(values)]
    wide = stats.groupBy(*keys).agg(F.expr(f"struct({', '.join(sums)}) AS _s")).selectExpr(*keys, "_s.*")

    moments = {}
    for i in range(len(spec.classes)):
        for j in range(len(spec.numeric)):
            mu, var = gaussian(f"_w_{i}_{j}", f"_wx_{i}_{j}", f"_wxx_{i}_{j}")
            moments |= {f"mu_{i}_{j}": mu, f"_var_{i}_{j}": var}
    out = [*keys]
    for i in range(len(spec.classes)):
        out += [f"if(_n_{i} > 0, ln(_n_{i} / _n), NULL) AS lp_{i}", f"coalesce(_n_{i}, 0D) AS cw_{i}"]
        for j in range(len(spec.numeric)):
            out += [
                f"mu_{i}_{j}",
                f"1D / (2D * _var_{i}_{j}) AS iv_{i}_{j}",
                f"-0.5D * ln({TWO_PI} * _var_{i}_{j}) AS lt_{i}_{j}",
            ]
        for j, (a, values) in enumerate(spec.nominal.items()):
            total = f"(coalesce(_n_{i}, 0D) + {len(values)}D)"
            pairs = ", ".join(f"{text(v)}, ln((coalesce(_c_{i}_{j}_{n}, 0D) + 1D) / {total})" for n, v in enumerate(values))
            out += [f"map({pairs}) AS nv_{i}_{j}", f"ln(1D / {total}) AS nd_{i}_{j}"]
    return (add(wide, moments) if moments else wide).selectExpr(*out)


def gaussian(w: str, wx: str, wxx: str) -> tuple[str, str]:
    """Mean and sample variance (floored) of weighted sums, as SQL text.

    A difference below 1e-12 of the sum of squares is what rounding leaves of 0.
    """
    mu = f"{wx} / {w}"
    spread = f"({wxx} - {wx} * {wx} / {w})"
    var = f"if({w} > 1 AND {spread} > {wxx} * {ROUNDING}D, greatest({spread} / ({w} - 1), {VARIANCE_FLOOR}D), {VARIANCE_FLOOR}D)"
    return mu, var


def log_votes(spec: FeatureSpec) -> list[str]:
    """Log vote of each class (SQL text) for a row that carries instance and model columns."""
    logs = []
    for i in range(len(spec.classes)):
        terms = [f"lp_{i}"]
        for j, a in enumerate(spec.numeric):
            d = f"({name(a)} - mu_{i}_{j})"
            # A missing value, or an attribute never seen with the class, says nothing.
            terms.append(f"coalesce(lt_{i}_{j} - {d} * {d} * iv_{i}_{j}, 0D)")
        for j, a in enumerate(spec.nominal):
            known = f"coalesce(try_element_at(nv_{i}_{j}, {name(a)}), nd_{i}_{j})"
            terms.append(f"if({name(a)} IS NULL, 0D, {known})")
        for j, a in enumerate(spec.open):
            # The terms of all members and classes for the row's value: see ``scoring.with_open_terms``.
            known = f"coalesce(_o_{j}[member * {len(spec.classes)} + {i}], 0D)"
            terms.append(f"if({name(a)} IS NULL, 0D, {known} - ln(cw_{i} + _V_{j}))")
        logs.append(" + ".join(terms))
    return logs


def votes_from_logs(df: DataFrame, logs: list[str]) -> DataFrame:
    """Add the vote vector ``exp(log - max log)``; 0 for a class never seen in training."""
    tmp = [f"_log_{i}" for i in range(len(logs))]
    staged = add(df, dict(zip(tmp, logs)))
    staged = add(staged, {"_top": f"greatest({', '.join(tmp)})" if len(tmp) > 1 else tmp[0]})
    return add(staged, {f"v_{i}": f"coalesce(exp({t} - _top), 0D)" for i, t in enumerate(tmp)}).drop(*tmp, "_top")


def member_votes(
    fanned: DataFrame, model: DataFrame, spec: FeatureSpec, ensemble: int, keys: tuple[str, ...] = ("member",), spread_by: str = "instance_id"
) -> DataFrame:
    """Vote vector of each member for each instance it received.

    The model's size is known from the header (members × classes × constants),
    which decides whether it may be broadcast.
    """
    model_cols = [c for c in model.columns if c not in keys]
    max_bytes = ensemble * spec.model_cells * 24
    joined = model_join(fanned, model, list(keys), max_bytes, spread_by)
    return votes_from_logs(joined, log_votes(spec)).drop(*model_cols)
