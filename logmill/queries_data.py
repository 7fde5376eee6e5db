"""Queries of the core's training-data problems (2 to 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.operators import drift, hierarchy, nested, references
from logmill.plans.scratch import Scratch
from logmill.queries_nested import records_sql, subtype_sql
from logmill.sources.tables import table


def _tree(s: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestry(table(s, d, "participants"))


def _orphans(s: SparkSession, d: str) -> DataFrame:
    return references.find_orphans(table(s, d, "messages"), table(s, d, "participants"), table(s, d, "purges"))


def p2_found(s, d):
    return hierarchy.hierarchy(table(s, d, "participants"))


def p2_descendants(s, d):
    return hierarchy.descendants(_tree(s, d))


def p2_subtrees(s, d):
    return hierarchy.subtree_sizes(_tree(s, d))


def p2_cycles(s, d):
    return hierarchy.cyclic(_tree(s, d))


def p3_found(s, d):
    return _orphans(s, d).select("ref_table", "ref_field", "seq", "status")


def p3_maintained(s, d):
    """The orphans of a state that got the tables in two batches: what arrived in the first half of the time, then the rest."""
    tables = [table(s, d, n) for n in ("messages", "participants", "purges")]
    times = ["arrived_at", "arrived_at", "purged_at"]
    ends = tables[0].agg(F.min("arrived_at").alias("a"), F.max("arrived_at").alias("b")).first()
    middle = F.lit(ends["a"] + (ends["b"] - ends["a"]) / 2 if ends["a"] else None).cast("timestamp_ntz")
    scratch, state = Scratch(s, "references"), None
    for second in (False, True):
        part = [t.filter(F.coalesce(F.col(c) > middle, F.lit(False)) == second) for t, c in zip(tables, times)]
        state = references.store(references.advance(state, references.facts(*part)), scratch, f"batch-{int(second)}")
    return references.orphans(state).select("ref_table", "ref_field", "seq", "status")


def p3_report(s, d):
    return references.orphan_report(_orphans(s, d))


def p4_found(s, d):
    return nested.elements(nested.flatten(table(s, d, "messages"), values=False, elements=True))


def p4_shapes(s, d):
    return nested.shapes(nested.flatten(table(s, d, "messages"), values=False))


def _subtype(name: str):
    def query(s, d):
        typed = nested.subtype(nested.flatten(table(s, d, "messages")), name)
        lists = {c: F.array_join(c, ",") for c, t in nested.SUBTYPES[name].items() if t.startswith("array")}
        return typed.withColumns(lists | {"more": F.to_json(F.map_from_entries(F.array_sort(F.map_entries("more"))))})

    return query


def p4_others(s, d):
    fields = F.array_sort(F.map_entries("fields"))
    return nested.others(nested.flatten(table(s, d, "messages"))).drop("element", "element_parent").withColumn("fields", F.to_json(F.map_from_entries(fields)))


def p5_found(s, d):
    return drift.changes(table(s, d, "dump_rows")).select("feed", "file_name", "change", "field", "old_field")


def p5_fingerprints(s, d):
    rows = table(s, d, "dump_rows")
    return drift.versions(drift.fingerprints(rows), drift.numbered_files(rows)).withColumn("types", F.array_join("types", ","))


def _unified(record_type: str):
    def query(s, d):
        return drift.unify(table(s, d, "dump_rows"), record_type).withColumn("extra", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("extra")))))

    return query


def _steps(record_type: str):
    def query(s, d):
        return drift.migrations(table(s, d, "dump_rows"), record_type)

    return query


QUERIES = {
    "p2_found": p2_found,
    "p2_descendants": p2_descendants,
    "p2_subtrees": p2_subtrees,
    "p2_cycles": p2_cycles,
    "p3_found": p3_found,
    "p3_maintained": p3_maintained,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_shapes": p4_shapes,
    **{f"p4_{name}": _subtype(name) for name in nested.SUBTYPES},
    "p4_others": p4_others,
    "p5_found": p5_found,
    "p5_fingerprints": p5_fingerprints,
    **{f"p5_{t}": _unified(t) for t in ("participants", "messages")},
    **{f"p5_steps_{t}": _steps(t) for t in ("participants", "messages")},
}

#: The tree by SQL recursion; a parent chain that comes back to its start is a cycle.
TREE = """
WITH RECURSIVE ranked AS (
  SELECT lower(trim(agent_id)) AS agent_id, nullif(lower(trim(parent)), '') AS parent, coalesce(engagement, '') AS engagement,
         row_number() OVER (PARTITION BY lower(trim(agent_id)) ORDER BY seq, arrived_at) AS rn
  FROM participants WHERE trim(agent_id) <> ''),
agents AS (SELECT agent_id, parent, engagement FROM ranked WHERE rn = 1),
links AS (SELECT a.agent_id, b.agent_id AS parent FROM agents a LEFT JOIN agents b ON b.agent_id = a.parent AND b.engagement = a.engagement),
walk AS (
  SELECT agent_id, agent_id AS root_id, 0 AS depth, agent_id AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.agent_id, w.root_id, w.depth + 1, w.path || '/' || l.agent_id FROM walk w JOIN links l ON l.parent = w.agent_id),
tree AS (
  SELECT l.agent_id, coalesce(w.root_id, '') AS root_id, CAST(coalesce(w.depth, -1) AS BIGINT) AS depth, coalesce(w.path, '') AS path
  FROM links l LEFT JOIN walk w ON w.agent_id = l.agent_id),
closure AS (
  SELECT t.agent_id AS descendant_id, t.depth, list_extract(string_split(t.path, '/'), CAST(i AS INT)) AS agent_id, CAST(t.depth - i + 1 AS BIGINT) AS distance
  FROM tree t, range(1, 100000) r(i) WHERE t.depth > 0 AND r.i <= t.depth)
"""

ORPHANS = """
WITH m AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY arrived_at) AS rn FROM messages WHERE seq IS NOT NULL) WHERE rn = 1),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY arrived_at) AS rn FROM participants WHERE seq IS NOT NULL) WHERE rn = 1),
refs AS (
  SELECT 'messages' AS ref_table, 'reply_to' AS ref_field, seq, engagement, 'messages' AS target, CAST(reply_to AS VARCHAR) AS key, arrived_at, created_at FROM m WHERE reply_to IS NOT NULL
  UNION ALL
  SELECT 'messages', 'recipient', seq, engagement, 'participants', lower(trim(recipient)), arrived_at, created_at FROM m WHERE trim(recipient) <> '' AND trim(recipient) NOT LIKE '@%'
  UNION ALL
  SELECT 'participants', 'parent', seq, engagement, 'participants', lower(trim(parent)), arrived_at, created_at FROM p WHERE trim(parent) <> ''),
rows_of AS (
  SELECT engagement, 'messages' AS target, CAST(seq AS VARCHAR) AS key, min(arrived_at) AS first_row FROM messages GROUP BY 1, 3
  UNION ALL
  SELECT engagement, 'participants', lower(trim(agent_id)), min(arrived_at) FROM participants GROUP BY 1, 3),
noted AS (SELECT DISTINCT engagement, lower(trim(target)) AS target, lower(trim(target_key)) AS key FROM purges),
orphans AS (
  SELECT r.ref_table, r.ref_field, r.seq, r.key, r.created_at,
         CASE WHEN t.key IS NOT NULL THEN 'late' WHEN n.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS status
  FROM refs r LEFT JOIN rows_of t ON t.engagement = r.engagement AND t.target = r.target AND t.key = r.key
  LEFT JOIN noted n ON n.engagement = r.engagement AND n.target = r.target AND n.key = r.key
  WHERE t.key IS NULL OR t.first_row > r.arrived_at)
"""

def opened_sql(x: str) -> str:
    """SQL of ``jsontree.opened``: a JSON string that is the text of an object or array, as that."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches(({x}) ->> '$', '^\\s*[\\[{{]') AND json_valid(({x}) ->> '$') THEN CAST(({x}) ->> '$' AS JSON) ELSE {x} END"


#: Every value of the JSON columns of messages, by recursion: seq, field, v, path, parent, row (whether it is a record).
WALK = f"""
WITH RECURSIVE once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY arrived_at) AS rn FROM messages WHERE seq IS NOT NULL) WHERE rn = 1),
texts AS (SELECT seq, 'data_json' AS field, data_json AS t FROM once UNION ALL SELECT seq, 'evidence_json', evidence_json FROM once),
valid AS (SELECT seq, field, CAST(t AS JSON) AS j FROM texts WHERE json_valid(t)),
opened AS (SELECT seq, field, {opened_sql('j')} AS v FROM valid),
walk AS (
  SELECT seq, field, CASE WHEN field = 'evidence_json' AND json_type(v) = 'OBJECT' THEN CAST('[' || CAST(v AS VARCHAR) || ']' AS JSON) ELSE v END AS v,
    '$' AS path, '$' AS parent, false AS row, field = 'evidence_json' AS outermost FROM opened
  UNION ALL
  SELECT w.seq, w.field, {opened_sql('e.value')}, w.path || CASE WHEN json_type(w.v) = 'OBJECT' THEN '.' || e.key ELSE '[' || e.key || ']' END, CASE WHEN w.row THEN w.path ELSE w.parent END,
    json_type(w.v) = 'ARRAY' AND (json_type({opened_sql('e.value')}) = 'OBJECT' OR (w.outermost AND json_type(e.value) <> 'NULL')), false
  FROM walk w, json_each(w.v) e WHERE json_type(w.v) IN ('OBJECT', 'ARRAY'))
"""

#: Changes of files by plain joins. Renames are matched where each name is the other's best.
DRIFT = f"""
WITH files AS (
  SELECT coalesce(feed, '') AS feed, coalesce(file_name, '') AS file_name, row_number() OVER (PARTITION BY coalesce(feed, '') ORDER BY min(exported_at), coalesce(file_name, '')) AS version FROM dump_rows GROUP BY 1, 2),
lines AS (SELECT DISTINCT coalesce(feed, '') AS feed, coalesce(file_name, '') AS file_name, line_no, rec_key, body FROM dump_rows),
bodies AS (SELECT feed, file_name, line_no, rec_key, {opened_sql('j')} AS v FROM (SELECT * EXCLUDE (body), CAST(body AS JSON) AS j FROM lines WHERE json_valid(body))),
cells AS (
  SELECT b.feed, b.file_name, f.version, b.line_no, b.rec_key, e.key AS field, CAST({opened_sql('e.value')} AS VARCHAR) AS v,
    CASE json_type(e.value) WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS type
  FROM (SELECT * FROM bodies WHERE json_type(v) = 'OBJECT') b JOIN files f ON f.feed = b.feed AND f.file_name = b.file_name, json_each(b.v) e),
counted AS (SELECT feed, file_name, version, field, type, count(*) AS n FROM cells GROUP BY ALL),
seen AS (
  SELECT feed, file_name, version, field, coalesce(list(type ORDER BY type) FILTER (type IS NOT NULL AND n = top), []) AS types
  FROM (SELECT *, max(n) FILTER (type IS NOT NULL) OVER (PARTITION BY feed, version, field) AS top FROM counted) GROUP BY ALL),
steps AS (
  SELECT f.feed, f.file_name, f.version, coalesce(a.field, b.field) AS field, a.field IS NULL AS gone, b.field IS NULL AS new, a.types AS now_types, b.types AS before_types
  FROM seen a FULL JOIN (SELECT feed, version + 1 AS version, field, types FROM seen) b ON b.feed = a.feed AND b.version = a.version AND b.field = a.field
  JOIN files f ON f.feed = coalesce(a.feed, b.feed) AND f.version = coalesce(a.version, b.version) WHERE f.version > 1),
firsts AS (SELECT feed, version, rec_key, field, arg_min(v, line_no) AS v FROM cells WHERE type IS NOT NULL AND rec_key IS NOT NULL GROUP BY ALL),
scored AS (
  SELECT g.feed, g.version, g.field AS gone, n.field AS new, count(*) AS pairs, count(*) FILTER (a.v = b.v) AS equal
  FROM steps g JOIN steps n ON n.feed = g.feed AND n.version = g.version AND g.gone AND n.new
  JOIN firsts a ON a.feed = g.feed AND a.version = g.version - 1 AND a.field = g.field JOIN firsts b ON b.feed = n.feed AND b.version = n.version AND b.field = n.field AND b.rec_key = a.rec_key
  GROUP BY ALL HAVING count(*) >= 2 AND 2 * count(*) FILTER (a.v = b.v) > count(*)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY feed, version, gone ORDER BY equal / pairs DESC, equal DESC, gone, new) AS by_gone, row_number() OVER (PARTITION BY feed, version, new ORDER BY equal / pairs DESC, equal DESC, gone, new) AS by_new FROM scored),
renamed AS (SELECT * FROM ranked WHERE by_gone = 1 AND by_new = 1),
changes AS (
  SELECT r.feed, f.file_name, 'renamed' AS change, r.new AS field, r.gone AS old_field FROM renamed r JOIN files f ON f.feed = r.feed AND f.version = r.version
  UNION ALL
  SELECT feed, file_name, CASE WHEN new THEN 'added' WHEN gone THEN 'removed' ELSE 'retyped' END, field, '' FROM steps s
  WHERE CASE WHEN new THEN NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = s.feed AND r.version = s.version AND r.new = s.field)
    WHEN gone THEN NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = s.feed AND r.version = s.version AND r.gone = s.field)
    ELSE len(now_types) > 0 AND len(before_types) > 0 AND NOT list_has_any(now_types, before_types) END)
"""

RECORDS = records_sql(WALK[: WALK.index(",\nwalk AS")], opened_sql)

SQL = {
    "p4_shapes": RECORDS + "SELECT field, record_type, shape, count(*) AS n_records FROM recs GROUP BY ALL",
    **{f"p4_{name}": RECORDS + subtype_sql(name) for name in nested.SUBTYPES},
    "p4_others": RECORDS
    + f"""SELECT r.*, '{{' || coalesce(string_agg(CAST(to_json(f.dotted) AS VARCHAR) || ':' || coalesce(CAST(to_json(f.text) AS VARCHAR), 'null'), ',' ORDER BY f.dotted) FILTER (f.dotted IS NOT NULL), '') || '}}' AS fields
FROM recs r LEFT JOIN fields f ON f.seq = r.seq AND f.field = r.field AND f.holder = r.node_path WHERE r.record_type NOT IN ({", ".join(f"'{n}'" for n in nested.SUBTYPES)}) GROUP BY ALL""",
    "p5_found": DRIFT + "SELECT feed, file_name, change, field, old_field FROM changes",
    "p5_fingerprints": DRIFT + "SELECT feed, file_name, CAST(version AS INT) AS version, field, array_to_string(types, ',') AS types FROM seen",
    "p4_found": WALK + "SELECT seq, field, path AS node_path, parent AS parent_path FROM walk WHERE row",
    "p2_found": TREE + "SELECT agent_id, root_id, depth, path FROM tree",
    "p2_descendants": TREE + "SELECT agent_id, descendant_id, distance FROM closure",
    "p2_subtrees": TREE + "SELECT t.agent_id, count(c.agent_id) AS descendants, CAST(coalesce(max(c.distance), 0) AS BIGINT) AS height FROM tree t LEFT JOIN closure c ON c.agent_id = t.agent_id WHERE t.depth >= 0 GROUP BY t.agent_id",
    "p2_cycles": TREE + "SELECT agent_id FROM tree WHERE depth < 0",
    "p3_found": ORPHANS + "SELECT ref_table, ref_field, seq, status FROM orphans",
    "p3_maintained": ORPHANS + "SELECT ref_table, ref_field, seq, status FROM orphans",
    "p3_report": ORPHANS + "SELECT ref_table, ref_field, coalesce(strftime(try_cast(trim(created_at) AS TIMESTAMP), '%Y-%m'), '') AS month, status, count(*) AS n_refs, count(DISTINCT key) AS n_keys FROM orphans GROUP BY 1, 2, 3, 4",
}
