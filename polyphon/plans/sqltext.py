"""Building blocks of the check queries: SQL text for the second engine."""

from __future__ import annotations

from polyphon.functions import weights as wt

INST = """inst AS MATERIALIZED (
  SELECT event_id AS instance_id, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, CAST(1.0 AS DOUBLE) AS weight,
         round(value * 100) AS x_cents, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x_k,
         CAST(user_id % 5 AS VARCHAR) AS n_user, event_type AS label, user_id, CAST(user_id AS VARCHAR) AS o_user
  FROM events)"""


def cut(share: float = 0.8) -> str:
    return f"(SELECT CAST(floor(count(*) * {share}) AS BIGINT) FROM events)"


def members(n: int) -> str:
    return f"(SELECT CAST(unnest(range(0, {n})) AS INTEGER) AS member)"


def hash32(instance_id: str, member: str, seed: int) -> str:
    m = wt.MASK
    start = (seed * wt.SEED_STEP) & m
    key = f"(((CAST({member} AS BIGINT) + 1) * {wt.MEMBER_STEP} + {start}) & 2147483647)"
    h = f"({instance_id} & {m})"
    h = f"((xor({h}, ({h} >> 16)) * ({key} | 1) + (({key} * {wt.HIGH_STEP}) & {m})) & {m})"
    h = f"xor({h}, (({instance_id} >> 32) & {m}))"
    h = f"((xor({h}, ({h} >> 16)) * {wt.MIX_A}) & {m})"
    h = f"((xor({h}, ({h} >> 15)) * {wt.MIX_B}) & {m})"
    return f"xor({h}, ({h} >> 16))"


def poisson_case(h: str, lam: float = 1.0) -> str:
    steps = wt.poisson_thresholds(lam)
    arms = " ".join(f"WHEN {h} < {s} THEN {j}" for j, s in enumerate(steps))
    return f"CASE {arms} ELSE {len(steps)} END"


def bag(source: str, ensemble: int, seed: int, name: str = "bag") -> str:
    """Fan-out with Poisson(1) weights; rows that draw 0 are dropped."""
    first = wt.poisson_thresholds(1.0)[0]
    return f"""{name}_h AS MATERIALIZED (
  SELECT i.*, m.member, {hash32('i.instance_id', 'm.member', seed)} AS h FROM {source} i, {members(ensemble)} m),
{name} AS MATERIALIZED (
  SELECT *, {poisson_case('h')} AS k, weight * ({poisson_case('h')}) AS w FROM {name}_h WHERE h >= {first})"""


def nb_stats(source: str, name: str = "stats", key: str = "member", w: str = "w", numeric=("x_cents", "x_k"), nominal=("n_user",)) -> str:
    """Long-form statistics of a weighted source."""
    arms = [
        f"SELECT {key}, label, '#class' AS attr, CAST(NULL AS VARCHAR) AS value, sum({w}) AS w,"
        f" CAST(NULL AS DOUBLE) AS wx, CAST(NULL AS DOUBLE) AS wxx FROM {source} GROUP BY {key}, label"
    ]
    for a in numeric:
        arms.append(
            f"SELECT {key}, label, '{a}', NULL, sum({w}), sum({w} * {a}), sum({w} * {a} * {a}) FROM {source} GROUP BY {key}, label"
        )
    for a in nominal:
        arms.append(f"SELECT {key}, label, '{a}', {a}, sum({w}), NULL, NULL FROM {source} GROUP BY {key}, label, {a}")
    return f"{name} AS MATERIALIZED (\n  " + "\n  UNION ALL ".join(arms) + ")"


def nb_votes(rows: str, stats: str = "stats", name: str = "votes", numeric=("x_cents", "x_k"), nominal=("n_user",), carry: str = "", open_=()) -> str:
    """Vote of each member and class for each row: ``instance_id, member, label, vote``.

    The rows of ``rows`` are met with every member found in ``stats``.
    """
    p = name
    joins, terms = [], []
    for i, a in enumerate(numeric):
        joins.append(f"JOIN {p}_num n{i} ON n{i}.member = c.member AND n{i}.label = c.label AND n{i}.attr = '{a}'")
        terms.append(f"(-0.5 * ln(2 * pi() * n{i}.var) - (r.{a} - n{i}.mu) * (r.{a} - n{i}.mu) / (2 * n{i}.var))")
    for i, a in enumerate(nominal):
        joins.append(
            f"LEFT JOIN {stats} s{i} ON s{i}.member = c.member AND s{i}.label = c.label AND s{i}.attr = '{a}' AND s{i}.value = r.{a}"
        )
        terms.append(f"ln((coalesce(s{i}.w, 0) + 1) / (c.w + (SELECT count(DISTINCT {a}) FROM inst)))")
    for i, a in enumerate(open_):
        joins.append(
            f"LEFT JOIN {stats} o{i} ON o{i}.member = c.member AND o{i}.label = c.label AND o{i}.attr = '{a}' AND o{i}.value = r.{a}"
        )
        known = f"SELECT DISTINCT value FROM {stats} WHERE attr = '{a}'"
        terms.append(f"ln((coalesce(o{i}.w, 0) + 1) / (c.w + (SELECT count(*) FROM ({known})) + CASE WHEN r.{a} IN ({known}) THEN 0 ELSE 1 END))")
    return f"""{p}_cls AS MATERIALIZED (
  SELECT member, label, w, sum(w) OVER (PARTITION BY member) AS n FROM {stats} WHERE attr = '#class' AND w > 0),
{p}_num AS MATERIALIZED (
  SELECT member, label, attr, wx / w AS mu,
         CASE WHEN w > 1 THEN greatest((wxx - wx * wx / w) / (w - 1), 1e-9) ELSE 1e-9 END AS var
  FROM {stats} WHERE wxx IS NOT NULL AND w > 0),
{p}_log AS MATERIALIZED (
  SELECT r.instance_id, c.member, c.label{carry}, ln(c.w / c.n) + {' + '.join(terms)} AS lv
  FROM {rows} r CROSS JOIN {p}_cls c {' '.join(joins)}),
{p} AS MATERIALIZED (
  SELECT *, exp(lv - max(lv) OVER (PARTITION BY instance_id, member)) AS vote FROM {p}_log)"""


def running_votes(
    source: str, name: str, w: str = "weight", upto: str = "1 PRECEDING", numeric=("x_cents", "x_k"), nominal=("n_user",), open_=()
) -> tuple[str, ...]:
    """Votes ``seq, truth, label, vote`` of naive Bayes trained on the rows up to ``upto``: wide running sums per class.

    The number of values of an ``open_`` attribute is that of the values met so far, the row's own included.
    """
    mine = "CASE WHEN i.label = c.label THEN i.{} ELSE 0 END".format
    sums, terms = [f"sum({mine(w)}) OVER w AS n"], []
    for a in numeric:
        sums += [f"sum({mine(f'{w} * i.{a}')}) OVER w AS s_{a}", f"sum({mine(f'{w} * i.{a} * i.{a}')}) OVER w AS q_{a}"]
        d = f"(q_{a} - s_{a} * s_{a} / n)"
        var = f"(CASE WHEN n > 1 AND {d} > q_{a} * 1e-12 THEN greatest({d} / (n - 1), 1e-9) ELSE 1e-9 END)"
        terms.append(f"(-0.5 * ln(2 * pi() * {var}) - ({a} - s_{a} / n) * ({a} - s_{a} / n) / (2 * {var}))")
    windows = [f"w AS (PARTITION BY c.label ORDER BY i.seq ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})"]
    for a in (*nominal, *open_):
        sums.append(f"sum({mine(w)}) OVER u_{a} AS v_{a}")
        windows.append(f"u_{a} AS (PARTITION BY c.label, i.{a} ORDER BY i.seq ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})")
        values = f"(SELECT count(DISTINCT {a}) FROM inst)" if a in nominal else f"k_{a}"
        terms.append(f"ln((coalesce(v_{a}, 0) + 1) / (n + {values}))")
    met = [f"sum(CASE WHEN f_{a} = 1 THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS k_{a}" for a in open_]
    firsts = [f"row_number() OVER (PARTITION BY {a} ORDER BY seq) AS f_{a}" for a in open_]
    rows = f"(SELECT *{''.join(f', {m}' for m in met)} FROM (SELECT *{''.join(f', {f}' for f in firsts)} FROM {source}))"
    kept = ", ".join(f"i.{a}" for a in (*numeric, *(f"k_{a}" for a in open_)))
    return (
        f"""{name}_run AS MATERIALIZED (SELECT i.seq, i.label AS truth, {kept}, c.label, {', '.join(sums)}
      FROM {rows} i CROSS JOIN (SELECT DISTINCT label FROM inst) c
      WINDOW {', '.join(windows)})""",
        f"""{name}_lg AS MATERIALIZED (SELECT seq, truth, label, CASE WHEN n > 0 THEN ln(n / sum(n) OVER (PARTITION BY seq)) + {' + '.join(terms)} END AS lv
      FROM {name}_run)""",
        f"{name} AS MATERIALIZED (SELECT seq, truth, label, coalesce(exp(lv - max(lv) OVER (PARTITION BY seq)), 0) AS vote FROM {name}_lg)",
    )


def normalize(source: str, name: str, part: str, col: str = "vote", out: str = "vote", cols: str = "instance_id, member, label") -> str:
    total = f"sum({col}) OVER (PARTITION BY {part})"
    return f"{name} AS MATERIALIZED (SELECT {cols}, CASE WHEN {total} > 0 THEN {col} / {total} ELSE {col} END AS {out} FROM {source})"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def argmax(source: str, name: str, by: str = "instance_id", vote: str = "vote", carry: str = "") -> str:
    """Label with the largest rounded vote, first in class order on ties."""
    return (
        f"{name} AS MATERIALIZED (SELECT {by}{carry}, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY {by}"
        f" ORDER BY round({vote}, 12) DESC, label) AS rn FROM {source}) WHERE rn = 1)"
    )
