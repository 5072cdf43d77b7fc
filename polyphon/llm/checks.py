"""Check SQL (DuckDB) of the queries that SQL can express."""

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOWER = "'abcdefghijklmnopqrstuvwxyz'"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

NEIGHBOURS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda x, y: x + y)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""

CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS written,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS role_written
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN opens THEN length('<|im_start|>') + role_written + 1 + length('<|im_end|>') + 1 ELSE length('<|im_sep|>') END + written)::BIGINT
    AS formatted_chars
FROM marked GROUP BY conv_id
"""

DECONTAMINATION = rf"""
WITH
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
windows AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM iw WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l)),
hits AS (SELECT doc_id, grams.l AS l, i, item_id FROM grams JOIN windows ON grams.g = windows.g AND grams.l = windows.l),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _merkle(levels: int = 12) -> str:
    """The manifest by one pair of tables per level: nodes, and each node's siblings to the left and right."""
    step = "x"
    for _ in range(8):
        step = f"list_transform({step}, lambda x: xor(x >> 1, 3988292384 * (x & 1)))"
    step = step.replace("list_transform(x,", "list_transform(range(256),", 1)

    fields = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR")]
    leaf = f"sha256({' || '.join(fields)} || coalesce(strlen(text) || ':' || text, '-'))"
    told = f"sha256({' || '.join(fields)} || coalesce(strlen(stripped) || ':' || stripped, '-'))"
    crc = (
        "xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
    )
    sql = [
        f"crc AS MATERIALIZED (SELECT {step} AS t)",
        f"""docs AS MATERIALIZED (
  SELECT *, {leaf} AS leaf, {told} AS told FROM (
    SELECT *, CASE WHEN coalesce({crc} % 2 = 0, false) THEN replace(text, chr(10), '') ELSE text END AS stripped FROM documents, crc))""",
        "p0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM docs)",
    ]

    def tree(name: str, key: str) -> list[str]:
        out = []
        for i in range(levels):
            frame = f"OVER (PARTITION BY {key}, r // 3 ORDER BY r ROWS BETWEEN"
            out.append(f"""{name}s{i} AS MATERIALIZED (
  SELECT {key} AS k, r, n, coalesce(string_agg(node, '') {frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') {frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS q FROM {name}{i})""")
            out.append(f"""{name}{i + 1} AS MATERIALIZED (
  SELECT {key}, r // 3 AS r, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY r)) ELSE max(node) END AS node,
    (max(n) + 2) // 3 AS n FROM {name}{i} GROUP BY {key}, r // 3)""")
        return out

    def climb(name: str, key: str, first: str, prefix: str) -> list[str]:
        out = []
        for i in range(levels):
            out.append(f"""{prefix}{i + 1} AS MATERIALIZED (
  SELECT d.* EXCLUDE (r, proof, fold), d.r // 3 AS r, proof || l || q AS proof, CASE WHEN n > 1 THEN sha256(l || fold || q) ELSE fold END AS fold
  FROM {first if i == 0 else f'{prefix}{i}'} d JOIN {name}s{i} s ON s.k IS NOT DISTINCT FROM d.{key} AND s.r = d.r)""")
        return out

    sql.append("a0 AS MATERIALIZED (SELECT source, r, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM p0)")
    sql += tree("a", "source")
    sql.append("d0 AS (SELECT doc_id, source, leaf, told AS fold, '' AS proof, r FROM p0)")
    sql += climb("a", "source", "d0", "d")
    sql.append(f"b0 AS MATERIALIZED (SELECT 0 AS g, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, node, count(*) OVER () AS n FROM a{levels})")
    sql += tree("b", "g")
    sql.append(
        f"e0 AS (SELECT d.doc_id, d.leaf, d.fold, d.proof, b0.r, 0 AS g, b0.node AS subroot FROM d{levels} d JOIN b0 ON b0.source IS NOT DISTINCT FROM d.source)"
    )
    sql += climb("b", "g", "e0", "e")
    body = ",\n".join(sql)
    return f"""WITH {body}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = node AS verified
FROM e{levels}, b{levels}
"""


MANIFEST = _merkle()
