"""Scoring a whole ensemble on the instance's own row.

The members' models are one value, an array with one entry per member, which
reaches the tasks as a scalar subquery. A row folds over that array, so members'
votes never become rows: combining them needs no shuffle, and the order of
addition is that of the members, however the data is split. The value's largest
size is known from the header. Beyond ``BROADCAST_BYTES`` the fan-out of
``naive_bayes.member_votes`` scores instead, and its votes are gathered by
instance.

Open nominal attributes, whose values are not declared, are not part of that
value. Their counts stay a table with one row per value, which holds the terms of
all members and classes, and each instance row is joined to the row of its value
once, before any fan-out. Values that make up more than 1 / ``HEAVY`` of the
scored rows are looked up in a broadcast of at most ``HEAVY`` rows; the join
shuffles the others, so no key of it has a larger share than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from polyphon.functions.sqlexpr import add, name, replace, text
from polyphon.operators import naive_bayes as nb
from polyphon.operators.lookup import BROADCAST_BYTES
from polyphon.operators.streams import ensemble_fanout
from polyphon.operators.votes import vote_cols
from polyphon.sources.instances import FeatureSpec

HEAVY = 256
# Up to this many votes (members times classes) are worked out as columns, which are compiled;
# folding over arrays is not, and costs some ten times as much, but its plan does not grow.
COLUMN_VOTES = 256


def models_value(stats: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row, one column: the constants of all members, by member."""
    return packed_models(nb.nb_model(stats, spec), spec)


def packed_models(model: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The same from the rows of ``naive_bayes.nb_model``."""
    entry = []
    for i in range(len(spec.classes)):
        fields = {"lp": f"lp_{i}", "cw": f"cw_{i}"}
        for j in range(len(spec.numeric)):
            fields |= {f"{c}_{j}": f"{c}_{i}_{j}" for c in ("mu", "iv", "lt")}
        for j, values in enumerate(spec.nominal.values()):
            fields |= {f"nv_{j}": f"array({', '.join(f'nv_{i}_{j}[{text(v)}]' for v in values)})", f"nd_{j}": f"nd_{i}_{j}"}
        entry.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")")
    members = model.selectExpr(f"named_struct('member', member, 'classes', array({', '.join(entry)})) AS m")
    return members.agg(F.expr("array_sort(collect_list(m), (a, b) -> a.member - b.member) AS models"))


# -- open attributes ---------------------------------------------------------


def value_terms(stats: DataFrame, spec: FeatureSpec, attr: str, ensemble: int) -> DataFrame:
    """Per value of an open attribute ``terms``: ln(count + 1) of member m and class i at place m * classes + i."""
    n = len(spec.classes)
    own = stats.where(F.col("attr") == attr).select(
        "value", (F.col("member") * n + spec.class_index(F.col("label"))).alias("k"), F.log(F.col("w") + 1).alias("t")
    )
    # At most one entry per member and class.
    by_value = own.where("k IS NOT NULL").groupBy("value").agg(F.expr("map_from_entries(collect_list(struct(k, t))) AS m"))
    return by_value.selectExpr("value", f"transform(sequence(0, {ensemble * n - 1}), k -> coalesce(try_element_at(m, k), 0D)) AS terms")


def with_open_terms(instances: DataFrame, stats: DataFrame, spec: FeatureSpec, ensemble: int, heavy: int = HEAVY) -> DataFrame:
    """Adds, per open attribute j, ``_o_j`` (the terms of the row's value, null when it is new) and
    ``_V_j``, the number of different values, the row's own included.
    """
    out = instances
    for j, attr in enumerate(spec.open):
        terms = value_terms(stats, spec, attr, ensemble)
        values = stats.where((F.col("attr") == attr) & F.col("value").isNotNull()).agg(F.count_distinct("value").alias("n"))
        own = F.col(name(attr)).cast("string")
        counted = instances.select(own.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        rows = instances.agg(F.count(F.lit(1)).alias("n"))
        hot = counted.where(F.col("n") * heavy > rows.scalar()).select("value")
        hot = hot.join(terms, "value", "left").select(F.col("value").alias("_hot_value"), F.col("terms").alias("_hot"), F.lit(True).alias("_is_hot"))
        out = out.withColumn("_own", own).join(F.broadcast(hot), F.col("_own") == F.col("_hot_value"), "left")
        # Rows that need no look-up are spread by keys that match nothing.
        out = add(out, {"_salt": "if(_own IS NULL OR _is_hot, monotonically_increasing_id() + 1L, 0L)"})
        cold = terms.select(F.col("value").alias("_cold_value"), F.col("terms").alias("_cold"), F.lit(0).cast("long").alias("_no_salt"))
        out = out.join(cold, (F.col("_own") == F.col("_cold_value")) & (F.col("_salt") == F.col("_no_salt")), "left")
        out = out.withColumn("_values", F.coalesce(values.scalar(), F.lit(0)))
        out = add(out, {f"_o_{j}": "coalesce(_hot, _cold)", f"_V_{j}": "cast(_values + if(coalesce(_hot, _cold) IS NULL, 1, 0) AS DOUBLE)"})
        out = out.drop("_own", "_hot_value", "_hot", "_is_hot", "_salt", "_cold_value", "_cold", "_no_salt", "_values")
    return out


def let(variable: str, value: str, body: str) -> str:
    """``body`` with ``variable`` standing for ``value``, which is worked out once.

    A column used inside a lambda may be replaced by its expression, which would
    then be worked out once per element.
    """
    return f"transform(array({value}), {variable} -> {body})[0]"


def _logs(spec: FeatureSpec) -> str:
    """Log votes of all members and classes (SQL text) on a row that carries ``_models``."""
    n = len(spec.classes)
    values, terms = {}, ["c.lp"]
    for j, a in enumerate(spec.numeric):
        values[f"x_{j}"] = f"cast({name(a)} AS DOUBLE)"
        terms.append(f"coalesce(c.lt_{j} - power(r.x_{j} - c.mu_{j}, 2D) * c.iv_{j}, 0D)")
    for j, a in enumerate(spec.nominal):
        declared = ", ".join(text(v) for v in spec.nominal[a])
        values[f"k_{j}"] = f"cast(array_position(array({declared}), {name(a)}) AS INT)"
        terms.append(f"if(r.k_{j} IS NULL, 0D, if(r.k_{j} > 0, c.nv_{j}[r.k_{j} - 1], c.nd_{j}))")
    for j, a in enumerate(spec.open):
        values |= {f"has_{j}": f"{name(a)} IS NOT NULL", f"o_{j}": f"_o_{j}", f"V_{j}": f"_V_{j}"}
        terms.append(f"if(r.has_{j}, coalesce(r.o_{j}[m.member * {n} + i], 0D) - ln(c.cw + r.V_{j}), 0D)")
    row = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in (values or {"none": "0"}).items()) + ")"
    return let("r", row, f"transform(_models, m -> named_struct('member', m.member, 'l', transform(m.classes, (c, i) -> {' + '.join(terms)})))")


def apart(df: DataFrame, columns: dict[str, str], mark: str, value: str | None = None) -> DataFrame:
    """A step that is compiled as many small methods, not as part of one generated loop.

    The JVM compiles no method above 8,000 bytes, and a loop over all members' votes is longer.
    A lambda keeps a step out of the loop, so ``mark`` (or ``value``, which becomes it) goes through one;
    later steps use it, or it would be left out.
    """
    kept = [name(c) for c in df.columns if c != mark]
    return df.selectExpr(*kept, f"{let('z', value or mark, 'z')} AS {mark}", *[f"{e} AS {name(c)}" for c, e in columns.items()])


def largest(columns: list[str]) -> str:
    return f"greatest({', '.join(columns)})" if len(columns) > 1 else columns[0]


def log_columns(rows: DataFrame, spec: FeatureSpec, entries: dict[str, str], mark: str, value: str) -> DataFrame:
    """Log votes as columns ``_l_<key>_<i>``, and the largest of each member's, ``_t_<key>``.

    ``entries`` has, per key, a member's entry (SQL text) in the value of ``models_value``.
    """
    n = len(spec.classes)
    inputs = {f"_x_{j}": f"cast({name(a)} AS DOUBLE)" for j, a in enumerate(spec.numeric)}
    for j, (a, values) in enumerate(spec.nominal.items()):
        inputs[f"_k_{j}"] = f"cast(array_position(array({', '.join(text(v) for v in values)}), {name(a)}) AS INT)"
    logs = {}
    for key, entry in entries.items():
        for i in range(n):
            c = f"get({entry}.classes, {i})"
            terms = [f"{c}.lp"]
            for j in range(len(spec.numeric)):
                terms.append(f"coalesce({c}.lt_{j} - power(_x_{j} - {c}.mu_{j}, 2D) * {c}.iv_{j}, 0D)")
            for j in range(len(spec.nominal)):
                terms.append(f"if(_k_{j} IS NULL, 0D, if(_k_{j} > 0, get({c}.nv_{j}, _k_{j} - 1), {c}.nd_{j}))")
            for j, a in enumerate(spec.open):
                terms.append(f"if({name(a)} IS NOT NULL, coalesce(get(_o_{j}, {entry}.member * {n} + {i}), 0D) - ln({c}.cw + _V_{j}), 0D)")
            logs[f"_l_{key}_{i}"] = " + ".join(terms)
    logged = apart(apart(rows, inputs, mark, value), logs, mark)
    return apart(logged, {f"_t_{key}": largest([f"_l_{key}_{i}" for i in range(n)]) for key in entries}, mark)


def row_votes(instances: DataFrame, stats: DataFrame, spec: FeatureSpec, ensemble: int) -> DataFrame:
    """Adds ``votes``: ``member`` and vote vector ``v`` of every trained member, in member order.

    A class never seen by a member gets 0.
    """
    kept = [name(c) for c in instances.columns]
    rows = with_open_terms(instances, stats, spec, ensemble)
    if ensemble * spec.model_cells * 24 > BROADCAST_BYTES:
        return _gathered_votes(rows, stats, spec, ensemble, instances.columns)
    scored = rows.withColumn("_models", models_value(stats, spec).scalar())
    n = len(spec.classes)
    if ensemble * n <= COLUMN_VOTES:
        voted = log_columns(scored, spec, {str(s): f"get(_models, {s})" for s in range(ensemble)}, "_n", "size(_models)")
        vectors = [", ".join(f"coalesce(exp(_l_{s}_{i} - _t_{s}), 0D)" for i in range(n)) for s in range(ensemble)]
        vote = "array(named_struct('member', get(_models, {}).member, 'v', array({})))".format
        own = ", ".join(f"if(_n > {s}, {vote(s, v)}, array())" for s, v in enumerate(vectors))
        return voted.selectExpr(*kept, f"concat({own}) AS votes")
    # Each step is used once, so all of them are one step, which holds the models as a constant.
    topped = f"transform({_logs(spec)}, z -> named_struct('member', z.member, 'l', z.l, 't', array_max(z.l)))"
    return scored.selectExpr(
        *kept, f"transform({topped}, z -> named_struct('member', z.member, 'v', transform(z.l, x -> coalesce(exp(x - z.t), 0D)))) AS votes"
    )


def _gathered_votes(rows: DataFrame, stats: DataFrame, spec: FeatureSpec, ensemble: int, columns: list[str]) -> DataFrame:
    """The same for models that are too large for one value: members become rows, and meet again by row."""
    n = len(spec.classes)
    numbered = add(rows, {"_row": "monotonically_increasing_id()"})
    votes = nb.member_votes(ensemble_fanout(numbered, ensemble), nb.nb_model(stats, spec), spec, ensemble, spread_by="_row")
    return gathered(votes, n, columns)


def gathered(votes: DataFrame, n_classes: int, columns: list[str]) -> DataFrame:
    """Members' vote rows of the same ``_row`` as one row with ``votes``, in member order."""
    packed = votes.select("_row", *[F.col(name(c)) for c in columns], F.struct("member", F.array(*vote_cols(n_classes)).alias("v")).alias("_vote"))
    # At most one vote per member.
    met = packed.groupBy("_row", *[name(c) for c in columns]).agg(F.expr("array_sort(collect_list(_vote), (a, b) -> a.member - b.member) AS _all"))
    return met.selectExpr(*[name(c) for c in columns], "_all AS votes")


# -- vote vectors in arrays --------------------------------------------------


def normalized(vectors: str) -> str:
    """Each vector (SQL text of an array of them) divided by its sum when that is positive."""
    summed = f"transform({vectors}, v -> named_struct('v', v, 's', aggregate(v, 0D, (a, x) -> a + x)))"
    return f"transform({summed}, s -> if(s.s > 0, transform(s.v, x -> x / s.s), s.v))"


def added(vectors: str, n_classes: int) -> str:
    return f"aggregate({vectors}, array_repeat(0D, {n_classes}), (a, v) -> zip_with(a, v, (x, y) -> x + y))"


def columns_of(vector: str, n_classes: int) -> list[str]:
    return [f"{vector}[{i}] AS {v}" for i, v in enumerate(vote_cols(n_classes))]


def normalized_columns(voted: DataFrame, n_classes: int, ensemble: int) -> DataFrame:
    """Normalised votes as columns ``_q_<s>_<i>`` (null where fewer members voted), and ``_n``, the number of voters."""
    vector = "get(votes, {}).v".format
    sums = {f"_s_{s}": f"0D + {' + '.join(f'get({vector(s)}, {i})' for i in range(n_classes))}" for s in range(ensemble)}
    summed = apart(voted, sums, "_n", "size(votes)")
    one = "if(_s_{s} > 0, get({v}, {i}) / _s_{s}, get({v}, {i}))".format
    return apart(summed, {f"_q_{s}_{i}": one(s=s, i=i, v=vector(s)) for s in range(ensemble) for i in range(n_classes)}, "_n")


def flat_rows(voted: DataFrame, n_classes: int, keep: list[str], keep_zero: bool = False, ensemble: int = 0) -> DataFrame:
    """The combined vote of all members on each row; rows with zero votes only go, unless ``keep_zero``.

    With the number of members, ``ensemble``, the work is done in columns.
    """
    if 0 < ensemble * n_classes <= COLUMN_VOTES:
        own = {f"_sum_{i}": "0D + " + " + ".join(f"if(_n > {s}, _q_{s}_{i}, 0D)" for s in range(ensemble)) for i in range(n_classes)}
        summed = apart(normalized_columns(voted, n_classes, ensemble), own, "_n")
        if keep_zero:
            return summed.selectExpr(*keep, *[f"_sum_{i} AS {v}" for i, v in enumerate(vote_cols(n_classes))])
        total = apart(summed, {"_total": f"0D + {' + '.join(own)}"}, "_n")
        vector = ", ".join(f"'{v}', _sum_{i} / _total" for i, v in enumerate(vote_cols(n_classes)))
        # Left out as an empty list, see below.
        return total.selectExpr(*keep, f"inline(if(_total > 0 AND _n >= 0, array(named_struct({vector})), array()))")
    summed = add(add(voted, {"_n": normalized("transform(votes, z -> z.v)")}), {"_sum": added("_n", n_classes)})
    if keep_zero:
        return summed.selectExpr(*keep, *columns_of("_sum", n_classes))
    total = add(summed, {"_total": "aggregate(_sum, 0D, (a, x) -> a + x)"})
    vector = ", ".join(f"'{v}', _sum[{i}] / _total" for i, v in enumerate(vote_cols(n_classes)))
    # Left out as an empty list: a filter would be pushed down, and all votes worked out twice.
    return total.selectExpr(*keep, f"inline(if(_total > 0, array(named_struct({vector})), array()))")


def part_vectors(voted: DataFrame, n_classes: int, ensemble: int, parts: int, weights: str | None = None) -> DataFrame:
    """Adds ``parts``: per part its number, the sum of its members' normalised votes, and how many voted.

    Parts follow ``routing.member_partition``; parts without a vote are left out.
    ``weights`` (SQL text of a map) scales members' votes; a member without a
    positive weight adds nothing, but counts.
    """
    size = max(ensemble // parts, 1)
    part = f"least(z.member div {size}, {parts - 1})" if parts <= ensemble else f"{parts - 1}"
    if ensemble * n_classes <= COLUMN_VOTES:
        return _part_columns(voted, n_classes, ensemble, parts, part, weights)
    weight = "1D" if weights is None else "greatest(coalesce(try_element_at(w, z.member), 0D), 0D)"
    summed = "transform(votes, z -> named_struct('member', z.member, 'v', z.v, 's', aggregate(z.v, 0D, (a, x) -> a + x)))"
    vector = "if(z.s > 0, transform(z.v, x -> x / z.s), z.v)"
    pairs = f"transform({summed}, z -> named_struct('member', z.member, 'weight', {weight}, 'v', {vector}))"
    if weights is not None:
        pairs = let("w", weights, pairs)
    vectors = "transform(s.own, z -> if(z.weight = 1D, z.v, transform(z.v, x -> x * z.weight)))"
    split = f"transform(sequence(0, {parts - 1}), p -> named_struct('part', p, 'own', filter(b, z -> {part} = p)))"
    summed = f"transform(filter({split}, s -> size(s.own) > 0), s -> named_struct('part', s.part, 'v', {added(vectors, n_classes)}, 'n', size(s.own)))"
    return add(voted, {"parts": let("b", pairs, summed)})


def _part_columns(voted: DataFrame, n_classes: int, ensemble: int, parts: int, part: str, weights: str | None) -> DataFrame:
    """The same worked out in columns; ``part`` is the part (SQL text) of a vote ``z``."""
    kept = [name(c) for c in voted.columns]
    steps = {}
    for s in range(ensemble):
        vote = f"get(votes, {s})"
        steps[f"_p_{s}"] = f"if(_n > {s}, {part.replace('z.', vote + '.')}, -1)"
        steps[f"_w_{s}"] = "1D" if weights is None else f"greatest(coalesce(try_element_at({weights}, {vote}.member), 0D), 0D)"
    placed = apart(normalized_columns(voted, n_classes, ensemble), steps, "_n")
    own = []
    for p in range(parts):
        count = " + ".join(f"if(_p_{s} = {p}, 1, 0)" for s in range(ensemble))
        vector = [" + ".join(["0D", *[f"if(_p_{s} = {p}, _q_{s}_{i} * _w_{s}, 0D)" for s in range(ensemble)]]) for i in range(n_classes)]
        own.append(f"if({count} > 0, array(named_struct('part', {p}, 'v', array({', '.join(vector)}), 'n', {count})), array())")
    return apart(placed, {"parts": f"concat({', '.join(own)})"}, "_n").selectExpr(*kept, "if(_n >= 0, parts, NULL) AS parts")


def part_rows(parted: DataFrame, n_classes: int, keep: list[str]) -> DataFrame:
    """One row per part: ``part, n_votes`` and the vector."""
    # The outer form: for the other one a filter on the parts is put before it, which works them out again.
    rows = parted.selectExpr(*keep, "explode_outer(parts) AS p").where("p IS NOT NULL")
    return rows.selectExpr(*keep, "cast(p.part AS INT) AS part", "p.n AS n_votes", *columns_of("p.v", n_classes))


def combined_rows(parted: DataFrame, n_classes: int, keep: list[str], mode: str = "flat", complete: int = 0) -> DataFrame:
    """All parts of a row added up (``hierarchical`` re-normalises each first) and normalised.

    Rows with fewer than ``complete`` votes are left out.
    """
    if mode not in ("flat", "hierarchical"):
        raise ValueError(f"unknown mode {mode!r}")
    vectors = "transform(parts, p -> p.v)"
    summed = add(
        parted,
        {
            "_sum": added(normalized(vectors) if mode == "hierarchical" else vectors, n_classes),
            "n_votes": "aggregate(parts, 0, (a, p) -> a + p.n)",
        },
    )
    one = add(summed, {"_one": normalized("array(_sum)")})
    vector = ", ".join(f"'{v}', _one[0][{i}]" for i, v in enumerate(vote_cols(n_classes)))
    return one.selectExpr(*keep, f"inline(if(n_votes >= {complete}, array(named_struct('n_votes', n_votes, {vector})), array()))")


def two_stage_rows(parted: DataFrame, n_classes: int, keep: list[str], parts_per_worker: int, complete: int = 0) -> DataFrame:
    """Parts → workers → one vector, each stage re-normalising what comes in."""
    grouped = (
        f"transform(sequence(0, cast(array_max(transform(parts, p -> p.part)) AS INT) div {parts_per_worker}), "
        f"w -> filter(parts, p -> p.part div {parts_per_worker} = w))"
    )
    staged = add(parted, {"_workers": f"filter({grouped}, g -> size(g) > 0)"})
    first = normalized("transform(g, p -> p.v)")
    parts = f"transform(_workers, g -> named_struct('part', 0, 'v', {added(first, n_classes)}, 'n', aggregate(g, 0, (a, p) -> a + p.n)))"
    staged = replace(staged, {"parts": parts}).drop("_workers")
    return combined_rows(staged, n_classes, keep, "hierarchical", complete)


def with_label(rows: DataFrame, spec: FeatureSpec, index: str, out: str = "pred") -> DataFrame:
    labels = ", ".join(text(c) for c in spec.classes)
    return add(rows, {out: f"element_at(array({labels}), {index} + 1)"}).drop(index)
