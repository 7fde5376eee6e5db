"""SQL of the typed tables of nested records: states from the leaves up, records and fields from the root down."""

from __future__ import annotations

from logmill.functions.jsontree import SCALAR_STATES
from logmill.operators.nested import ACCEPTED, SUBTYPES

#: Levels that the SQL can see; the tables of the checks have fewer.
LEVELS = 14
_LETTER = {k: v for k, v in SCALAR_STATES.items()} | {"array": "a", "object": "o"}


def _state(level: int) -> str:
    """States of one level from those of the level below."""
    below = f"LEFT JOIN s{level + 1} c ON c.seq = n.seq AND c.field = n.field AND c.up = n.path" if level < LEVELS else "LEFT JOIN (SELECT NULL AS key, NULL AS state) c ON false"
    return f"""s{level} AS (
  SELECT n.seq, n.field, n.path, n.up, n.key, ',' || coalesce(string_agg(c.key || '=' || left(c.state, 1), ',' ORDER BY c.key) || ',', '') AS layer,
    CASE n.jt WHEN 'OBJECT' THEN 'o' || substr(md5('{{' || coalesce(string_agg(CAST(to_json(c.key) AS VARCHAR) || ':' || c.state, ';' ORDER BY c.key), '') || '}}'), 1, 16)
      WHEN 'ARRAY' THEN 'a' || substr(md5('[' || coalesce(string_agg(DISTINCT c.state, '|' ORDER BY c.state), '') || ']'), 1, 16)
      WHEN 'NULL' THEN 'n' WHEN 'BOOLEAN' THEN 'b' WHEN 'VARCHAR' THEN 's' WHEN 'DOUBLE' THEN 'f' ELSE 'i' END AS state
  FROM nodes n {below} WHERE n.depth = {level} GROUP BY n.seq, n.field, n.path, n.up, n.key, n.jt)"""


def _fits(name: str) -> str:
    must, may = ACCEPTED[name]
    every = "|".join(f"{k}=[{_LETTER[t]}n]" for k, t in (must | may).items())
    there = " AND ".join(f"contains(layer, ',{k}=')" for k in must)
    return f"CASE WHEN {there} AND regexp_full_match(layer, ',(?:(?:{every}),)*') THEN '{name}' END"


def _plural(c: str) -> str:
    names = ", ".join(f"'{n}'" for n in SUBTYPES)
    return f"CASE WHEN {c} NOT IN ({names}) AND {c} || 's' IN ({names}) THEN {c} || 's' ELSE {c} END"


def records_sql(once: str, opened) -> str:
    """CTEs up to ``recs`` (a row a record, with its table) and ``fields`` (its values as text); ``once`` begins them."""
    subtypes = ", ".join(f"'{n}'" for n in SUBTYPES)
    return f"""{once},
nodes AS (
  SELECT seq, field, '$' AS path, CAST(NULL AS VARCHAR) AS up, CAST(NULL AS VARCHAR) AS key, 0 AS depth, '' AS name, false AS of_object, false AS element, field = 'evidence_json' AS outermost, v, json_type(v) AS jt
  FROM (SELECT seq, field, CASE WHEN field = 'evidence_json' AND json_type(v) = 'OBJECT' THEN CAST('[' || CAST(v AS VARCHAR) || ']' AS JSON) ELSE v END AS v FROM opened)
  UNION ALL
  SELECT seq, field, path, up, key, depth, name, of_object, json_type(v) = 'OBJECT' AND NOT of_object OR (was_outer AND NOT of_object AND json_type(v) <> 'NULL'), false, v, json_type(v)
  FROM (SELECT w.seq, w.field, w.path || CASE WHEN w.jt = 'OBJECT' THEN '.' || e.key ELSE '[' || e.key || ']' END AS path, w.path AS up, e.key, w.depth + 1 AS depth,
    CASE WHEN w.jt = 'OBJECT' THEN e.key ELSE w.name END AS name, w.jt = 'OBJECT' AS of_object, w.outermost AS was_outer, {opened('e.value')} AS v FROM nodes w, json_each(w.v) e WHERE w.jt IN ('OBJECT', 'ARRAY'))),
{", ".join(_state(k) for k in range(LEVELS, -1, -1))},
states AS ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(LEVELS + 1))}),
judged AS (SELECT *, list_filter([{", ".join(_fits(n) for n in ACCEPTED)}], lambda x: x IS NOT NULL) AS fits FROM states),
mixed AS (SELECT seq, field, up AS path, bool_or(jt IN ('OBJECT', 'ARRAY')) AS mixed FROM nodes GROUP BY ALL),
known AS (
  SELECT n.*, j.state, CASE WHEN left(j.state, 1) = 'o' AND len(j.fits) = 1 THEN j.fits[1] END AS sub, coalesce(m.mixed, false) AS mixed
  FROM nodes n JOIN judged j ON j.seq = n.seq AND j.field = n.field AND j.path = n.path LEFT JOIN mixed m ON m.seq = n.seq AND m.field = n.field AND m.path = n.path),
tree AS (
  SELECT seq, field, path, jt, v, state, sub, name, mixed, of_object, jt NOT IN ('NULL', 'ARRAY') AS rec, CAST(NULL AS VARCHAR) AS parent, '$' AS around, CASE WHEN jt NOT IN ('NULL', 'ARRAY') THEN '$' END AS holder, '' AS dotted FROM known WHERE depth = 0
  UNION ALL
  SELECT seq, field, path, jt, v, state, sub, name, mixed, of_object, rec, was, CASE WHEN rec THEN path ELSE was END,
    CASE WHEN rec THEN path WHEN of_object THEN was_holder END, CASE WHEN rec THEN '' WHEN of_object THEN CASE WHEN was_dotted = '' THEN key ELSE was_dotted || '.' || key END ELSE '' END
  FROM (SELECT k.*, t.around AS was, t.holder AS was_holder, t.dotted AS was_dotted,
      k.element OR (k.of_object AND k.jt = 'OBJECT' AND ({_plural('k.key')} IN ({subtypes}) OR k.sub IS NOT NULL))
      OR (NOT k.of_object AND k.jt NOT IN ('NULL', 'OBJECT', 'ARRAY') AND NOT (t.of_object AND NOT t.mixed)) AS rec
    FROM tree t JOIN known k ON k.seq = t.seq AND k.field = t.field AND k.up = t.path)),
named AS (SELECT *, CASE WHEN name <> '' THEN name WHEN field = 'evidence_json' THEN 'anchors' ELSE 'items' END AS said FROM tree WHERE rec),
recs AS (SELECT seq, field, path AS node_path, parent AS parent_path, CASE WHEN parent IS NULL AND field = 'data_json' THEN 'bodies' ELSE coalesce(sub, {_plural('said')}) END AS record_type, state AS shape FROM named),
fields AS (
  SELECT seq, field, holder, dotted, CASE jt WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN v ->> '$' ELSE CAST(json(v) AS VARCHAR) END AS text FROM tree
  WHERE holder IS NOT NULL AND (jt NOT IN ('OBJECT', 'ARRAY') OR (jt = 'ARRAY' AND of_object AND NOT mixed AND NOT rec)))
"""


def subtype_sql(name: str) -> str:
    """The rest of the statement for one typed table."""
    columns, parts, fitting = SUBTYPES[name], [], []
    for n, kind in columns.items():
        text = f"max(f.text) FILTER (f.dotted = '{n}')"
        alias = n.replace(".", "_")
        if kind.startswith("array"):
            parts.append(f"array_to_string(CASE WHEN json_valid({text}) THEN CASE WHEN json_type({text}) = 'ARRAY' THEN CAST(CAST({text} AS JSON) AS VARCHAR[]) END END, ',') AS \"{alias}\"")
            fitting.append(f"(f.dotted = '{n}' AND (f.text IS NULL OR coalesce(CASE WHEN json_valid(f.text) THEN json_type(f.text) = 'ARRAY' END, false)))")
        else:
            typed = {"string": "{}", "bigint": "CASE WHEN regexp_full_match({0}, '\\s*[-+]?[0-9]+\\s*') THEN try_cast({0} AS BIGINT) END", "boolean": "try_cast({} AS BOOLEAN)"}[kind]
            parts.append(f"{typed.format(text)} AS \"{alias}\"")
            fitting.append(f"(f.dotted = '{n}' AND (f.text IS NULL OR {typed.format('f.text')} IS NOT NULL))")
    more = f"string_agg(CAST(to_json(f.dotted) AS VARCHAR) || ':' || coalesce(CAST(to_json(f.text) AS VARCHAR), 'null'), ',' ORDER BY f.dotted) FILTER (f.dotted IS NOT NULL AND NOT ({' OR '.join(fitting)}))"
    return f"""SELECT r.seq, r.field, r.node_path, r.parent_path, r.shape, {", ".join(parts)}, '{{' || coalesce({more}, '') || '}}' AS more
FROM recs r LEFT JOIN fields f ON f.seq = r.seq AND f.field = r.field AND f.holder = r.node_path WHERE r.record_type = '{name}' GROUP BY r.seq, r.field, r.node_path, r.parent_path, r.shape"""
