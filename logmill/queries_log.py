"""Queries of the log operators and their SQL.

Inputs are whole tables, or literal cases (CASES) where an operator's input occurs in no table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions import rules as R
from logmill.operators import audit, frames, inbox, ingest, migrate, reconcile, scope
from logmill.plans.skew import join_one
from logmill.sources.tables import table
from logmill.sources.views import SQL_VIEWS, exports, log, members

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True, name: str = ""):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = (SQL_VIEWS if views else "") + sql
        return f

    return add


def _log(s: SparkSession, d: str, *names: str) -> DataFrame:
    return log(table(s, d, "messages"), *names)


def _members(s: SparkSession, d: str, *names: str) -> DataFrame:
    return members(table(s, d, "participants"), *names)


_BODY = ("engagement", "sender", "recipient", "kind", "reply_to", "data_json", "evidence_json")
_ADDRESS = ("engagement", "recipient", "archived")
_THREAD = ("engagement", "reply_to", "sender", "recipient", "archived")
_AGENT = ("engagement", "role")


def _quote(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (int, float)):
        return str(v).lower() if isinstance(v, bool) else str(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_quote, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    """Literal rows as SQL."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows) + f") t({names})"


# --- ingest ---------------------------------------------------------------------------------------------------------

FIRSTS = """, firsts AS (
  SELECT *, min(seq) OVER (PARTITION BY engagement, sender, dedup_key) AS first_seq FROM log WHERE dedup_key IS NOT NULL AND sender IS NOT NULL)
"""


@query(FIRSTS + "SELECT seq, sender, recipient, kind, dedup_key FROM firsts WHERE seq = first_seq UNION ALL SELECT seq, sender, recipient, kind, dedup_key FROM log WHERE dedup_key IS NULL OR sender IS NULL")
def ingest_first_wins(s, d):
    return ingest.first_wins(_log(s, d, "engagement", "sender", "recipient", "kind", "dedup_key")).select("seq", "sender", "recipient", "kind", "dedup_key")


_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ingest.CONTENT)


@query(FIRSTS + f"SELECT a.seq, a.first_seq, ({_SAME}) AS duplicate, NOT ({_SAME}) AS conflict FROM firsts a JOIN log b ON b.seq = a.first_seq WHERE a.seq > a.first_seq")
def ingest_conflicts(s, d):
    return ingest.repeats(_log(s, d, *ingest.CONTENT, "engagement", "dedup_key"))


@query(
    """, j AS (
  SELECT *, CASE WHEN json_valid(data_json) THEN json_type(data_json) END AS dt, CASE WHEN json_valid(evidence_json) THEN json_type(evidence_json) END AS et FROM log)
SELECT seq, concat_ws(',',
  CASE WHEN kind IS NULL OR kind NOT IN ('ask', 'reply', 'close') THEN 'kind' END,
  CASE WHEN dt IS DISTINCT FROM 'OBJECT' THEN 'data' END,
  CASE WHEN strlen(data_json) > 2048 THEN 'data_bytes' END,
  CASE WHEN et IS DISTINCT FROM 'ARRAY' THEN 'evidence' END,
  CASE WHEN et = 'ARRAY' AND json_array_length(evidence_json) > 8 THEN 'evidence_refs' END,
  CASE WHEN dedup_key IS NOT NULL AND NOT (trim(dedup_key) <> '' AND strlen(dedup_key) <= 256 AND NOT regexp_matches(dedup_key, '[\\r\\n|]')) THEN 'key' END,
  CASE WHEN reply_to < 1 THEN 'reply_range' END,
  CASE WHEN kind = 'reply' AND reply_to IS NULL THEN 'reply_missing' END) AS violations FROM j"""
)
def message_violations(s, d):
    return ingest.violations(_log(s, d, "kind", "data_json", "evidence_json", "dedup_key", "reply_to"))


CURRENT = """, known AS (SELECT * FROM members WHERE role IN ('investigator', 'scout', 'analyst', 'main') AND regexp_matches(agent_id, '^a[0-9a-f]{1,16}$'))
"""
TOPICS = "('@investigator', '@scout', '@analyst', '@main')"


@query(
    CURRENT
    + f"""SELECT l.seq, CASE WHEN a.agent_id IS NULL THEN 'unknown_sender' WHEN a.model IS DISTINCT FROM l.model THEN 'model_differs'
  WHEN l.recipient NOT IN {TOPICS} AND b.agent_id IS NULL THEN 'unknown_recipient' ELSE 'ok' END AS verdict
FROM log l LEFT JOIN known a ON a.engagement = l.engagement AND a.agent_id = l.sender LEFT JOIN known b ON b.engagement = l.engagement AND b.agent_id = l.recipient"""
)
def send_authority(s, d):
    return ingest.authority(_log(s, d, "engagement", "sender", "recipient", "model"), _members(s, d, *_AGENT, "model"))


@query("SELECT a.seq, a.reply_to, b.sender AS original_sender, b.recipient AS original_recipient FROM log a JOIN log b ON b.engagement = a.engagement AND b.seq = a.reply_to")
def reply_threads(s, d):
    return ingest.threads(_log(s, d, *_THREAD)).filter("original_archived is not null").select("seq", "reply_to", "original_sender", "original_recipient")


@query(
    """SELECT a.seq, CASE WHEN b.seq IS NULL THEN 'no_original'
  WHEN b.archived <> 0 OR NOT coalesce(b.recipient = a.sender OR b.recipient = '@' || m.role, false) THEN 'not_addressed'
  WHEN b.sender <> a.recipient THEN 'wrong_recipient' ELSE 'ok' END AS verdict
FROM log a LEFT JOIN log b ON b.engagement = a.engagement AND b.seq = a.reply_to LEFT JOIN members m ON m.engagement = a.engagement AND m.agent_id = a.sender
WHERE a.reply_to IS NOT NULL"""
)
def reply_valid(s, d):
    return ingest.reply_verdicts(_log(s, d, *_THREAD), _members(s, d, *_AGENT))


@query(
    """SELECT agent_id AS sender, parent AS recipient, 'event' AS kind,
  CAST(json_object('agent', agent_id, 'event', 'agent.started', 'model', model, 'model_source', model_source, 'parent', parent, 'role', role) AS VARCHAR) AS data_json
FROM members WHERE parent IS NOT NULL"""
)
def register_events(s, d):
    return ingest.start_events(_members(s, d, "parent", "role", "model", "model_source"))


_IDENTITY = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("name", "role", "model", "parent", "model_source"))


@query(f", f AS (SELECT *, min(seq) OVER (PARTITION BY engagement, session_id) AS first_seq FROM exports WHERE session_id IS NOT NULL) SELECT a.seq, a.session_id, a.first_seq FROM f a JOIN exports b ON b.seq = a.first_seq WHERE a.seq > a.first_seq AND NOT ({_IDENTITY})")
def registration_conflicts(s, d):
    return ingest.refused_registrations(exports(table(s, d, "participants"), "engagement", "session_id", "name", "role", "model", "parent", "model_source"))


@query("SELECT l.sender, min(l.seq) AS seq, 'completion:' || l.sender AS dedup_key FROM log l JOIN members m ON m.engagement = l.engagement AND m.agent_id = l.sender AND m.parent = l.recipient WHERE l.kind = 'close' GROUP BY l.engagement, l.sender")
def completion_once(s, d):
    return ingest.completions(_log(s, d, "engagement", "sender", "recipient", "kind"), _members(s, d, "engagement", "parent"))


# --- routing --------------------------------------------------------------------------------------------------------

FANOUT = (
    CURRENT
    + """, fan AS (
  SELECT l.engagement, k.agent_id, l.seq FROM log l JOIN known k ON k.engagement = l.engagement AND (l.recipient = k.agent_id OR l.recipient = '@' || k.role) WHERE l.archived = 0)
"""
)


@query(FANOUT + "SELECT engagement, agent_id, seq FROM fan")
def inbox_fanout(s, d):
    return inbox.fanout(_log(s, d, *_ADDRESS), _members(s, d, *_AGENT))


@query(FANOUT + ", n AS (SELECT seq, count(*) AS n FROM fan GROUP BY seq) SELECT l.seq, coalesce(n.n, 0) AS receivers FROM log l LEFT JOIN n ON n.seq = l.seq")
def can_receive(s, d):
    return inbox.receivers(_log(s, d, *_ADDRESS), _members(s, d, *_AGENT))


ENVELOPE = """, refs AS (
  SELECT *, CASE WHEN json_valid(evidence_json) AND json_type(evidence_json) = 'ARRAY'
    THEN list_filter(list_transform(CAST(evidence_json AS JSON[]), lambda x: json_extract_string(x, '$.ref')), lambda r: r IS NOT NULL)
    WHEN json_valid(evidence_json) AND json_type(evidence_json) = 'OBJECT' THEN list_filter([json_extract_string(evidence_json, '$.ref')], lambda r: r IS NOT NULL) ELSE CAST([] AS VARCHAR[]) END AS r FROM log),
env AS (
  SELECT *, '{' || concat_ws(',', CASE WHEN json_valid(data_json) THEN '"data":' || data_json END, '"from":' || to_json(sender), '"kind":' || to_json(kind),
    CASE WHEN len(r) > 8 THEN '"more_refs":' || (len(r) - 8) END,
    CASE WHEN len(r) > 0 THEN '"refs":' || to_json(r[1:8]) END,
    CASE WHEN reply_to IS NOT NULL THEN '"reply":' || reply_to END, '"seq":' || seq, '"to":' || to_json(recipient)) || '}' AS envelope FROM refs),
sized AS (
  SELECT *, strlen(envelope) AS bytes, CASE WHEN strlen(envelope) > 4096
    THEN strlen('{' || concat_ws(',', '"data":{"archive":"agentschat.md","legacy_message":' || seq || '}', '"from":' || to_json(sender), '"kind":' || to_json(kind), '"seq":' || seq, '"to":' || to_json(recipient)) || '}')
    ELSE strlen(envelope) END AS delivered_bytes FROM env)
"""


@query(ENVELOPE + "SELECT seq, envelope, CAST(bytes AS INT) AS bytes, CAST(delivered_bytes AS INT) AS delivered_bytes FROM sized")
def envelope(s, d):
    return inbox.envelopes(_log(s, d, *_BODY))


PAGE = (
    FANOUT
    + ENVELOPE
    + """, few AS (
  SELECT f.*, z.delivered_bytes, row_number() OVER w AS position, 128 + sum(z.delivered_bytes + 1) OVER w AS total
  FROM fan f JOIN sized z ON z.seq = f.seq WINDOW w AS (PARTITION BY f.engagement, f.agent_id ORDER BY f.seq)),
page AS (SELECT *, total <= 8192 AND position <= 32 AS ok FROM few WHERE position <= 33)
"""
)


@query(PAGE + "SELECT engagement, agent_id, CAST(position AS INT) AS position, seq, CAST(delivered_bytes AS INT) AS delivered_bytes FROM page WHERE ok")
def inbox_page(s, d):
    return inbox.pages(_log(s, d, *_BODY, "archived"), _members(s, d, *_AGENT))


@query(
    PAGE
    + """, got AS (SELECT engagement, agent_id, count(*) AS fetched, count(*) FILTER (WHERE ok) AS delivered, max(seq) FILTER (WHERE ok) AS last FROM page GROUP BY 1, 2),
hw AS (SELECT engagement, max(seq) AS high_water FROM log GROUP BY 1)
SELECT k.engagement, k.agent_id, coalesce(g.delivered, 0) AS delivered, coalesce(g.fetched > g.delivered, false) AS more,
  CASE WHEN coalesce(g.fetched > g.delivered, false) THEN coalesce(g.last, 0) ELSE greatest(coalesce(g.last, 0), coalesce(hw.high_water, 0)) END AS cursor
FROM known k LEFT JOIN got g ON g.engagement = k.engagement AND g.agent_id = k.agent_id LEFT JOIN hw ON hw.engagement = k.engagement"""
)
def inbox_cursor(s, d):
    return inbox.cursors(_log(s, d, *_BODY, "archived"), _members(s, d, *_AGENT))


@query("SELECT engagement, max(seq) AS high_water FROM log GROUP BY engagement")
def high_water(s, d):
    return inbox.high_water(_log(s, d, "engagement"))


@query(
    """, back AS (SELECT *, row_number() OVER (PARTITION BY engagement ORDER BY seq DESC) AS back FROM members WHERE role IN ('investigator', 'scout', 'analyst', 'main'))
SELECT engagement, seq, agent_id AS id, name, role, model, model_source, parent, max(back) OVER (PARTITION BY engagement) > 32 AS more FROM back QUALIFY back <= 32"""
)
def roster_tail(s, d):
    return inbox.roster(_members(s, d, *_AGENT, "name", "model", "model_source", "parent"))


@query(
    """SELECT agent_id, CASE WHEN parent IS NULL THEN CAST(json_object('agent', agent_id, 'model', model, 'model_source', model_source, 'role', role) AS VARCHAR)
  ELSE CAST(json_object('agent', agent_id, 'model', model, 'model_source', model_source, 'parent', parent, 'role', role) AS VARCHAR) END AS info FROM members"""
)
def participant_info(s, d):
    return inbox.info(_members(s, d, "role", "model", "model_source", "parent"))


@query(CURRENT + "SELECT agent_id, engagement FROM known")
def known_agents(s, d):
    return inbox.known(_members(s, d, *_AGENT)).select("agent_id", "engagement")


@query("SELECT m.agent_id, m.parent FROM members m LEFT JOIN members p ON p.engagement = m.engagement AND p.agent_id = m.parent WHERE m.parent IS NOT NULL AND p.agent_id IS NULL")
def orphan_parents(s, d):
    m = _members(s, d, "engagement", "parent")
    known = m.select("engagement", F.col("agent_id").alias("parent"))
    return join_one(m.filter("parent is not null"), known, ["engagement", "parent"], "left_anti").select("agent_id", "parent")


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY engagement ORDER BY seq DESC) AS back FROM members WHERE role IN ('investigator', 'scout', 'analyst', 'main')),
g AS (SELECT engagement, string_agg(agent_id, ',' ORDER BY seq) FILTER (WHERE back <= 32) AS ids, max(back) > 32 AS more FROM r GROUP BY engagement)
SELECT e.engagement, e.program, e.mode, coalesce(g.ids, '') AS participants, coalesce(g.more, false) AS more FROM engagements e LEFT JOIN g ON g.engagement = e.engagement"""
)
def show_state(s, d):
    return inbox.snapshot(table(s, d, "engagements"), _members(s, d, *_AGENT, "name", "model", "model_source", "parent"))


_TABLE = ["agent_id", "name", "role", "model", "model_source", "parent"]
_PAD = ", ".join(f"greatest(max(length(coalesce({c}, '-'))), {len(c)}) AS w_{c}" for c in _TABLE)
_LINE = " || '  ' || ".join(f"rpad(coalesce({c}, '-'), CAST(w_{c} AS INT), ' ')" for c in _TABLE)


@query(f", w AS (SELECT {_PAD} FROM members) SELECT engagement, seq, rtrim({_LINE}) AS line FROM members, w")
def render_table(s, d):
    return inbox.render(_members(s, d, "engagement", *_TABLE[1:]), _TABLE)


# --- scalars and policy -----------------------------------------------------------------------------------------------

NAMES = [("plain",), (" padded ",), ("",), ("   ",), ("a|b",), ("line\nbreak",), ("é" * 128,), ("é" * 129,), (None,)]


@query(f", v AS (SELECT DISTINCT name AS value FROM exports UNION SELECT value FROM {_values(NAMES, 'value')}) SELECT value, coalesce(trim(value) <> '' AND strlen(value) <= 256 AND NOT regexp_matches(value, '[\\r\\n|]'), false) AS valid, trim(value) AS stripped FROM v")
def valid_identifier(s, d):
    values = exports(table(s, d, "participants"), "name").select(F.col("name").alias("value")).union(s.createDataFrame(NAMES, "value string")).distinct()
    return values.select("value", R.valid_identifier(F.col("value")).alias("valid"), R.strip(F.col("value")).alias("stripped"))


SELECTORS = [("",), ("model",), ("vendor/",), ("vendor//model",), ("vendor/model/",), ("vendor/model:low:high",), ("vendor/model\n",), (" vendor/model",), ("vendor/model;x",), ("vendor/mo del",), ("private-vendor/new-model:custom-effort",), ("a/b/c:max",), ("v/" + "m" * 254,), ("v/" + "m" * 255,), (None,)]
MODELS = f", v AS (SELECT DISTINCT model AS selector FROM exports UNION SELECT selector FROM {_values(SELECTORS, 'selector')})\n"
_SELECTOR = "[A-Za-z0-9][A-Za-z0-9._-]*"


def _models(s, d):
    return exports(table(s, d, "participants"), "model").select(F.col("model").alias("selector")).union(s.createDataFrame(SELECTORS, "selector string")).distinct()


@query(MODELS + f"SELECT selector, coalesce(regexp_full_match(selector, '{_SELECTOR}(?:/{_SELECTOR})+(?::{_SELECTOR})?') AND length(selector) <= 256, false) AS valid FROM v")
def selector_valid(s, d):
    return _models(s, d).select("selector", R.valid_selector(F.col("selector")).alias("valid"))


@query(MODELS + r"""SELECT selector, regexp_extract(selector, '^([^/]*)', 1) AS provider, regexp_extract(selector, '(?s)^[^/]*/([^:]*)', 1) AS name,
  nullif(regexp_extract(selector, '(?s)^[^/]*/[^:]*:(.*)$', 1), '') AS effort FROM v""")
def selector_parts(s, d):
    return _models(s, d).select("selector", R.selector_parts(F.col("selector")).alias("p")).select("selector", "p.*")


@query(MODELS + f"SELECT selector, regexp_replace(selector, ':({'|'.join(R.EFFORTS)})$', '') AS base FROM v")
def model_base(s, d):
    return _models(s, d).select("selector", R.model_base(F.col("selector")).alias("base"))


@query(MODELS + r""", p AS (SELECT selector, regexp_extract(selector, '^([^/]*)', 1) AS provider, regexp_extract(selector, '(?s)^[^/]*/([^:]*)', 1) AS name FROM v)
SELECT selector, CASE WHEN provider <> '' AND name <> '' THEN provider || '/' || name END AS observed FROM p""")
def observed_model(s, d):
    p = R.selector_parts(F.col("selector"))
    return _models(s, d).select("selector", R.observed_model(p["provider"], p["name"]).alias("observed"))


URLS = [
    ("https://h/api/v1",), ("https://H.Example/X",), ("http://h:80/",), ("http://h",), ("HTTP://h_1/x?q=1",), ("https://user@h/x",), ("https://u:p@h/",), ("https://h/x#part",), ("https://h/x#",), ("https://h/a/../b",), ("https://h/%2e%2e/b",),
    ("https://h/a%252fb",), ("https://h/a\\b",), ("ftp://h/x",), ("https:///x",), ("//h/x",), ("h/x",), ("",), ("  ",), (" https://h/x ",), ("https://h/a\tb",), ("https://[::1]:8080/x",), ("https://[::1/x",), ("https://h:99999/",), ("https://h:port/",), ("https://h:/x",), ("https://h?q=..",), (None,),
]
URL_PARTS = (
    f""", v AS (SELECT unnest(assets) AS url FROM engagements UNION SELECT url FROM {_values(URLS, 'url')}),
"""
    + r"""a AS (SELECT url, regexp_replace(url, '^\s+|\s+$', '', 'g') AS u FROM v),
b AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest FROM a),
c AS (SELECT *, regexp_extract(rest, '^//([^/?#]*)', 1) AS net, regexp_extract(rest, '^(?://[^/?#]*)?([^?#]*)', 1) AS p, regexp_extract(rest, '(?s)#(.*)$', 1) AS fragment FROM b),
e AS (SELECT *, CASE WHEN p = '' THEN '/' ELSE p END AS path, regexp_extract(net, '([^@]*)$', 1) AS net_at FROM c),
f AS (SELECT *, lower(CASE WHEN net_at LIKE '[%' THEN regexp_extract(net_at, '^\[([^\]]*)\]', 1) ELSE regexp_extract(net_at, '^([^:]*)', 1) END) AS host,
  CASE WHEN net_at LIKE '[%' THEN regexp_extract(net_at, '\]:(.*)$', 1) ELSE regexp_extract(net_at, '^[^:]*:(.*)$', 1) END AS port FROM e),
g AS (SELECT *, CASE WHEN u IS NULL OR u = '' THEN 'empty' WHEN regexp_matches(u, '[\x00-\x1f\x7f]') THEN 'control' WHEN contains(net, '[') <> contains(net, ']') THEN 'malformed'
  WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN contains(net, '@') THEN 'credentials' WHEN fragment <> '' THEN 'fragment' WHEN contains(path, '..') THEN 'traversal'
  WHEN regexp_matches(lower(path), '%(25)?(2e|2f|5c)|\\') THEN 'encoding'
  WHEN port <> '' AND NOT (regexp_matches(port, '^[0-9]{1,5}$') AND try_cast(port AS INT) <= 65535) THEN 'port' END AS reason FROM f)
"""
)


def _urls(s, d):
    return table(s, d, "engagements").select(F.explode("assets").alias("url")).union(s.createDataFrame(URLS, "url string")).distinct()


@query(URL_PARTS + "SELECT url, reason FROM g")
def url_reject_reason(s, d):
    return _urls(s, d).select("url", R.url(F.col("url"))["reason"].alias("reason"))


@query(URL_PARTS + "SELECT url, reason IS NULL AS valid FROM g")
def url_valid(s, d):
    return _urls(s, d).select("url", R.url(F.col("url"))["reason"].isNull().alias("valid"))


@query(URL_PARTS + "SELECT url, scheme, host, try_cast(port AS INT) AS port, path FROM g WHERE reason IS NULL")
def url_parts(s, d):
    return _urls(s, d).select("url", R.url(F.col("url")).alias("p")).filter("p.reason is null").select("url", "p.scheme", "p.host", "p.port", "p.path")


_A = """, x AS (SELECT engagement, mode, unnest(assets) AS asset, unnest(range(len(assets))) AS position FROM engagements)
"""


@query(_A + r"SELECT engagement, CAST(position AS INT) AS position, asset, CASE WHEN trim(asset) = '' THEN NULL WHEN regexp_matches(trim(asset), '(?i)^https?://') THEN 'url' ELSE 'dir' END AS class FROM x")
def asset_class(s, d):
    return scope.assets(table(s, d, "engagements")).select("engagement", "position", "asset", "class")


CASES = [("https://h/x", "blackbox"), ("/srv/src", "blackbox"), ("https://h/x", "source"), ("/srv/src", "source"), ("srv/src", "audit"), ("", "audit"), ("https://h/x#f", "patch"), ("HTTPS://H", "development")]


@query(
    URL_PARTS.replace(f"UNION SELECT url FROM {_values(URLS, 'url')}", f"UNION SELECT asset FROM {_values(CASES, 'asset, mode')}")
    + f""", am AS (SELECT DISTINCT unnest(assets) AS asset, mode FROM engagements UNION SELECT asset, mode FROM {_values(CASES, 'asset, mode')}),
k AS (SELECT am.*, regexp_matches(trim(asset), '(?i)^https?://') AS is_url, g.reason FROM am JOIN g ON g.url = am.asset)
SELECT asset, mode, CASE WHEN trim(asset) = '' THEN 'blank' WHEN mode = 'blackbox' AND NOT is_url THEN 'needs_url' WHEN mode = 'source' AND is_url THEN 'needs_dir'
  WHEN is_url THEN coalesce(reason, '') WHEN NOT starts_with(trim(asset), '/') THEN 'relative' ELSE '' END AS problem FROM k"""
)
def asset_mode_check(s, d):
    """Every asset with the mode of its engagement, and cases that the tables lack."""
    own = table(s, d, "engagements").select(F.explode("assets").alias("asset"), "mode")
    return own.union(s.createDataFrame(CASES, "asset string, mode string")).distinct().select("asset", "mode", F.coalesce(R.asset_problem(F.col("asset"), F.col("mode")), F.lit("")).alias("problem"))


@query(
    URL_PARTS
    + """, bad AS (SELECT DISTINCT url FROM g WHERE reason IS NOT NULL)
SELECT engagement, concat_ws(',', CASE WHEN coalesce(trim(program), '') = '' THEN 'program' END, CASE WHEN coalesce(trim(authorization_basis), '') = '' THEN 'authorization_basis' END,
    CASE WHEN mode IS NULL OR mode NOT IN ('blackbox', 'source', 'audit', 'patch', 'development') THEN 'mode' END,
    CASE WHEN coalesce(len(assets), 0) = 0 OR EXISTS (SELECT 1 FROM x_assets q WHERE q.engagement = e.engagement AND (trim(q.asset) = '' OR (e.mode = 'blackbox' AND NOT q.is_url) OR (e.mode = 'source' AND q.is_url)
      OR (q.is_url AND q.asset IN (SELECT url FROM bad)) OR (NOT q.is_url AND trim(q.asset) NOT LIKE '/%'))) THEN 'assets' END,
    CASE WHEN coalesce(len(allowed_methods), 0) = 0 OR len(list_filter(allowed_methods, lambda m: coalesce(trim(m), '') = '')) > 0 THEN 'allowed_methods' END,
    CASE WHEN max_requests < 0 THEN 'max_requests' END, CASE WHEN interval_seconds < 0 OR isnan(interval_seconds) OR isinf(interval_seconds) THEN 'interval_seconds' END,
    CASE WHEN coalesce(trim(created_at), '') = '' THEN 'created_at' END) AS problems,
  coalesce(array_to_string(list_transform(allowed_methods, lambda m: upper(trim(m))), ','), '') AS methods,
  coalesce(array_to_string(list_filter(list_transform(assets, lambda a: trim(a)), lambda a: regexp_matches(a, '(?i)^https?://')), ' '), '') AS url_assets,
  coalesce(array_to_string(list_filter(list_transform(assets, lambda a: trim(a)), lambda a: a <> '' AND NOT regexp_matches(a, '(?i)^https?://')), ' '), '') AS source_roots,
  coalesce(max_requests, 0) AS max_requests, coalesce(interval_seconds, 1.0) AS interval_seconds FROM engagements e""".replace(
        ", bad AS", ", x_assets AS (SELECT engagement, unnest(assets) AS asset, regexp_matches(trim(unnest(assets)), '(?i)^https?://') AS is_url FROM engagements), bad AS"
    )
)
def scope_normalize(s, d):
    return scope.normalize(table(s, d, "engagements")).select("engagement", "problems", F.array_join("methods", ",").alias("methods"), F.array_join("url_assets", " ").alias("url_assets"), F.array_join("source_roots", " ").alias("source_roots"), "max_requests", "interval_seconds")


TARGETS = """, targets AS (
  SELECT engagement, seq, unnest(a) AS url, unnest(range(len(a))) AS position FROM (
    SELECT engagement, seq, list_transform(CAST(json_extract(data_json, '$.task.targets') AS JSON[]), lambda x: json_extract_string(x, '$.asset')) AS a FROM log
    WHERE json_valid(data_json) AND json_type(json_extract(data_json, '$.task.targets')) = 'ARRAY')),
"""
URL_TARGETS = TARGETS + URL_PARTS.lstrip(", ").replace(f"UNION SELECT url FROM {_values(URLS, 'url')}", "UNION SELECT url FROM targets WHERE url IS NOT NULL")


@query(
    URL_TARGETS
    + r""", own AS (SELECT e.engagement, g.* FROM (SELECT engagement, unnest(assets) AS asset FROM engagements) e JOIN g ON g.url = e.asset WHERE g.reason IS NULL)
SELECT t.engagement, t.seq, CAST(t.position AS INT) AS position, t.url, coalesce(bool_or(o.url IS NOT NULL AND (rtrim(o.path, '/') = '' OR q.path = rtrim(o.path, '/') OR starts_with(q.path, rtrim(o.path, '/') || '/'))), false) AS allowed
FROM targets t JOIN g q ON q.url = t.url LEFT JOIN own o ON o.engagement = t.engagement AND q.reason IS NULL AND o.scheme = q.scheme AND o.host = q.host AND o.port = q.port
WHERE t.url IS NOT NULL GROUP BY ALL"""
)
def url_allowed(s, d):
    return scope.allowed(table(s, d, "engagements"), scope.target_urls(_log(s, d, "engagement", "data_json")))


@query(URL_TARGETS + "SELECT q.scheme, q.host, coalesce(try_cast(q.port AS INT), -1) AS port, count(*) AS urls FROM targets t JOIN g q ON q.url = t.url WHERE q.reason IS NULL GROUP BY ALL")
def origin_counts(s, d):
    return scope.origins(scope.target_urls(_log(s, d, "engagement", "data_json")))


REFS = [("notes/a.txt", True), ("a/../b", True), ("../x", False), ("a/../../x", False), ("/etc/x", False), ("", False), ("a|b", False), ("./a/./b", True), ("a//b", True), ("x" * 513, False), (None, False)]


@query(
    ENVELOPE
    + f""", v AS (SELECT DISTINCT unnest(r) AS ref FROM refs UNION SELECT ref FROM {_values([r[:1] for r in REFS], 'ref')}),
p AS (SELECT ref, list_filter(string_split(ref, '/'), lambda x: x NOT IN ('', '.')) AS steps FROM v)
SELECT ref, coalesce(trim(ref) <> '' AND strlen(ref) <= 512 AND NOT regexp_matches(ref, '[\\r\\n|]') AND NOT starts_with(ref, '/') AND
  coalesce(list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(list_transform(steps[1:i], lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END)))), 0) >= 0, false) AS safe FROM p"""
)
def ref_safe(s, d):
    """Every ref of the log's evidence, and cases that it lacks."""
    own = _log(s, d, "evidence_json").select(F.explode(inbox.refs(F.col("evidence_json"))).alias("ref"))
    return own.union(s.createDataFrame([r[:1] for r in REFS], "ref string")).distinct().select("ref", R.safe_ref(F.col("ref")).alias("safe"))


PATHS = [("/srv/src", "/srv/src", True), ("/srv/src", "/srv/src/a/b", True), ("/srv/src", "/srv/srcs", False), ("/srv/src", "/srv/src/../x", False), ("/srv/./src/", "/srv//src/a", True), ("/", "/x", True), ("/srv", "srv/x", False), ("/srv", "/../srv/x", True), ("/srv", None, False)]


@query("SELECT root, path, allowed FROM " + _values(PATHS, "root, path, allowed"), views=False)
def path_allowed(s, d):
    return s.createDataFrame([p[:2] for p in PATHS], "root string, path string").select("root", "path", R.path_allowed(F.col("root"), F.col("path")).alias("allowed"))


@query("SELECT seq, 'a' || substr(sha256(engagement || '/' || session_id), 1, 16) AS agent_id FROM exports WHERE session_id IS NOT NULL")
def session_ids(s, d):
    return exports(table(s, d, "participants"), "engagement", "session_id").filter("session_id is not null").select("seq", R.session_agent_id(F.col("engagement"), F.col("session_id")).alias("agent_id"))


@query("SELECT purge_id, strftime(purged_at, '%Y%m%dT%H%M%S%fZ') AS stamp FROM purges", views=False)
def utc_stamps(s, d):
    return table(s, d, "purges").select("purge_id", R.stamp(F.col("purged_at")).alias("stamp"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL", views=False)
def artifact_digest(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


DEFAULTS = {"investigator": "vendor-a/deep-1:xhigh", "scout": "vendor-b/quick-2:high", "analyst": "vendor-b/quick-2:high"}
CONFIGURED = [("investigator", "vendor-a/deep-1:xhigh"), ("scout", "vendor-c/other:low"), ("analyst", "vendor-b/quick-2:high")]


@query("SELECT role, c.model AS model, d.model AS default_model, c.model <> d.model AS changed, count(*) FILTER (WHERE c.model <> d.model) OVER () AS n_changed FROM " + _values(CONFIGURED, "role, model").replace(" t(", " c(") + " JOIN " + _values(list(DEFAULTS.items()), "role, model").replace(" t(", " d(") + " USING (role)", views=False)
def roles_changed(s, d):
    now, base = s.createDataFrame(CONFIGURED, "role string, model string"), s.createDataFrame(list(DEFAULTS.items()), "role string, default_model string")
    both = now.join(base, "role").select("role", "model", "default_model", (F.col("model") != F.col("default_model")).alias("changed"))
    return both.join(both.agg(F.count_if("changed").alias("n_changed")), how="cross")  # one row


@query("SELECT m.agent_id, c.model AS selector FROM members m JOIN " + _values(CONFIGURED, "role, model").replace(" t(", " c(") + " ON c.role = m.role")
def dispatch_lookup(s, d):
    models = F.create_map(*[F.lit(x) for r in CONFIGURED for x in r])
    return _members(s, d, "role").select("agent_id", F.element_at(models, F.col("role")).alias("selector")).filter("selector is not null")


CATALOGS = [(1, 4, ["investigator", "scout", "analyst"], ["a/b", "a/c:low", "a/d"], True), (2, 3, ["investigator", "scout", "analyst"], ["a/b", "a/c", "a/d"], False), (3, 4, ["scout", "analyst"], ["a/b", "a/c"], False), (4, 4, ["investigator", "scout", "analyst"], ["a/b", "bad", "a/d"], False), (5, None, [], [], False)]


@query("SELECT id, valid FROM " + _values([(c[0], c[4]) for c in CATALOGS], "id, valid"), views=False)
def catalog_valid(s, d):
    rows = [(c[0], c[1], dict(zip(c[2], c[3]))) for c in CATALOGS]
    return frames.valid_catalog(s.createDataFrame(rows, "id int, schema_version int, models map<string,string>")).select("id", "valid")


OLD = [("investigator", '"a/b:low"'), ("scout", '{"models":["c/d","e/f"]}'), ("plan", '"x/y"')]


@query("SELECT role, selector FROM " + _values([("investigator", "a/b:low"), ("scout", "c/d"), ("analyst", DEFAULTS["analyst"])], "role, selector"), views=False)
def legacy_catalog(s, d):
    return migrate.legacy_catalog(s.createDataFrame(OLD, "role string, entry string"), DEFAULTS)


@query("SELECT DISTINCT engagement, topic FROM engagements, unnest(['@investigator', '@scout', '@analyst', '@main']) t(topic) WHERE topic NOT IN (SELECT recipient FROM log l WHERE l.engagement = engagements.engagement)")
def missing_required(s, d):
    used = _log(s, d, "engagement", "recipient").filter(F.col("recipient").startswith("@")).groupBy("engagement").agg(F.collect_set("recipient").alias("used"))
    topics = F.array(*[F.lit(f"@{r}") for r in ("investigator", "scout", "analyst", "main")])
    both = table(s, d, "engagements").select("engagement").distinct().join(used, "engagement", "left")
    return both.select("engagement", F.explode(frames.missing(topics, F.coalesce("used", F.array().cast("array<string>")))).alias("topic"))


# --- frames and sessions ------------------------------------------------------------------------------------------------

FRAMES = [
    ('{"id":1,"args":["inbox","--agent","a1"]}', None), ('{"id":"1","args":["inbox"]}', "no_id"), ('{"id":true,"args":["inbox"]}', "no_id"), ("not json", "no_json"), ('{"id":2,"args":[]}', "no_args"), ('{"id":2,"args":["inbox",3]}', "no_args"), ('{"id":2}', "no_args"),
    ('{"id":3,"args":["install"]}', "command"), ('{"id":4,"args":["message","--engagement=x"]}', "bound"), ('{"id":5,"args":["peers","-h"]}', "bound"), ("[1]", "no_id"), (None, "no_json"),
]


@query("SELECT frame, problem FROM " + _values(FRAMES, "frame, problem"), views=False)
def rpc_valid(s, d):
    return frames.requests(s.createDataFrame([f[:1] for f in FRAMES], "frame string")).select("frame", "problem")


@query("SELECT seq AS id, 'message' AS command FROM log WHERE sender IS NOT NULL AND recipient IS NOT NULL AND kind IS NOT NULL")
def rpc_frames(s, d):
    made = _log(s, d, "sender", "recipient", "kind").filter("sender is not null and recipient is not null and kind is not null").select(F.to_json(F.struct(F.col("seq").alias("id"), F.array(F.lit("message"), F.lit("--sender"), "sender", F.lit("--to"), "recipient", F.lit("--kind"), "kind").alias("args"))).alias("frame"))
    return frames.requests(made).filter("problem is null").select("id", "command")


REPLIES = [
    ('{"id":1,"ok":true,"data":{"seq":1}}', None), ('{"id":1,"ok":true,"data":[]}', "shape"), ('{"id":1,"ok":false,"error":"x"}', None), ('{"id":1,"ok":false}', "shape"), ('{"id":1}', "shape"), ("{", "no_json"),
    ('{"id":1,"ok":true,"data":{"_messages":[{"seq":1,"from":"a1","to":"@scout","kind":"ask","data":{}}]}}', None), ('{"id":1,"ok":true,"data":{"_messages":[{"seq":0,"from":"a1","to":"@scout","kind":"ask","data":{}}]}}', "notes"),
    ('{"id":1,"ok":true,"data":{"_messages":[{"seq":1,"from":"a1","to":"@scout","kind":"other","data":{}}]}}', "notes"), ('{"id":1,"ok":true,"data":{"_messages":3}}', "notes"),
]


@query("SELECT frame, problem FROM " + _values(REPLIES, "frame, problem"), views=False)
def rpc_reply_valid(s, d):
    return frames.replies(s.createDataFrame([f[:1] for f in REPLIES], "frame string")).select("frame", "problem")


@query(
    PAGE
    + """, got AS (SELECT engagement, agent_id, list(seq) AS seqs FROM page WHERE ok GROUP BY ALL),
asked AS (SELECT *, unnest([0, list_min(seqs), list_max(seqs) - 1]) AS after, unnest(['whole', 'late', 'short']) AS named FROM got),
read AS (SELECT *, CASE named WHEN 'short' THEN list_max(seqs) - 1 ELSE list_max(seqs) END AS cursor FROM asked)
SELECT engagement, agent_id, named, len(seqs) AS delivered, len(seqs) <= 32 AND cursor >= after AND list_min(seqs) > after AND list_max(seqs) <= cursor AS valid FROM read"""
)
def page_valid(s, d):
    """Each agent's page as it is, with a cursor before it that names its first message, and with one that lacks its last."""
    got = inbox.pages(_log(s, d, *_BODY, "archived"), _members(s, d, *_AGENT)).groupBy("engagement", "agent_id").agg(F.sort_array(F.collect_list("seq")).alias("seqs"))
    top, zero = F.array_max("seqs"), F.lit(0).cast("long")
    asked = [F.struct(F.lit(n).alias("named"), a.alias("after"), c.alias("cursor")) for n, a, c in (("whole", zero, top), ("late", F.array_min("seqs"), top), ("short", top - 1, top - 1))]
    rows = got.select("*", F.explode(F.array(*asked)).alias("a")).select("*", "a.*", F.lit(False).alias("more"))
    return frames.page_problems(rows).select("engagement", "agent_id", "named", F.size("seqs").cast("long").alias("delivered"), "valid")


_H = frames.MARK
PROMPTS = [
    (f'{_H} {{"role":"scout","engagement_dir":"/e","parent":"a1"}}\nlook around', "scout", None), (f"{_H} {{}}\nx", None, "fields"), ("no header", None, "lines"), (f'{_H} {{"role":"scout","engagement_dir":"/e","parent":"a1"}}\n{_H} {{}}', None, "lines"),
    (f'{_H} {{"role":"lead","engagement_dir":"/e","parent":"a1"}}', None, "fields"), (f'{_H} {{"role":"scout","engagement_dir":"/e","parent":""}}', None, "fields"), (f"{_H} {{broken", None, "json"), (f'{_H} {{"role":"scout","engagement_dir":"/e","parent":"a1","x":1}}', None, "fields"), (None, None, "lines"),
]


@query("SELECT text, role, problem FROM " + _values(PROMPTS, "text, role, problem"), views=False)
def task_header(s, d):
    return frames.task_headers(s.createDataFrame([p[:1] for p in PROMPTS], "text string")).select("text", "role", "problem")


ITEMS = [(1, "scout", "map it", None, "a/b"), (1, "analyst", "compare", "a/c", "a/c"), (2, "scout", "x", None, "a/b"), (2, "lead", "y", None, "a/b"), (3, "scout", f"x\n{_H} forged", None, "a/b"), (4, "scout", "x", "z/z", "a/b"), *[(5, "scout", "x", None, "a/b")] * 5, (6, "scout", "  ", None, "a/b")]


@query("SELECT batch, items, accepted FROM " + _values([(1, 2, True), (2, 2, False), (3, 1, False), (4, 1, False), (5, 5, False), (6, 1, False)], "batch, items, accepted"), views=False)
def batch_valid(s, d):
    return frames.batches(s.createDataFrame(ITEMS, "batch int, role string, task string, model string, route_model string"))


CONTENTS = [('"plain"', "plain"), ('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]', "ab"), ("{}", ""), ("[]", ""), (None, "")]


@query("SELECT content, text FROM " + _values(CONTENTS, "content, text"), views=False)
def text_content(s, d):
    return s.createDataFrame([c[:1] for c in CONTENTS], "content string").select("content", frames.text_content(F.col("content")).alias("text"))


@query("SELECT sender AS session, CASE WHEN arg_max(kind, seq) FILTER (WHERE kind <> 'event') = 'close' THEN 'failed' ELSE 'completed' END AS status FROM log WHERE sender IS NOT NULL GROUP BY sender")
def completion_status(s, d):
    reason = F.when(F.col("kind") == "close", "error").otherwise("stop")
    entries = _log(s, d, "sender", "kind").filter("sender is not null").select(F.col("sender").alias("session"), F.col("seq").alias("position"), F.when(F.col("kind") != "event", "assistant").otherwise("user").alias("role"), reason.alias("stop_reason"))
    return frames.completion_status(entries)


# --- migrations -----------------------------------------------------------------------------------------------------------


@query("SELECT seq, NULL::VARCHAR AS agent_id, NULL::VARCHAR AS parent, 'asserted' AS model_source FROM exports")
def migrate_columns(s, d):
    old = exports(table(s, d, "participants"), "session_id", "name", "role", "model", "created_at").select("seq", "session_id", "name", "role", "model", "created_at")
    return migrate.add_columns(old, "participants").select("seq", "agent_id", "parent", "model_source")


@query("SELECT seq, 'a' || printf('%x', seq) AS agent_id FROM exports")
def migrate_ids(s, d):
    return migrate.fill_ids(migrate.add_columns(exports(table(s, d, "participants"), "session_id"), "participants")).select("seq", "agent_id")


_OLD_ROLE = "CASE role WHEN 'scout' THEN 'recon' WHEN 'analyst' THEN 'verdict' WHEN 'investigator' THEN 'discover' ELSE role END"
_NEW_ROLE = "CASE role WHEN 'scout' THEN 'scout' WHEN 'analyst' THEN 'skeptic' WHEN 'investigator' THEN 'finder' ELSE role END"


@query(f"SELECT seq, {_NEW_ROLE} AS role, CASE recipient WHEN '@analyst' THEN '@skeptic' WHEN '@investigator' THEN '@finder' ELSE recipient END AS recipient FROM log")
def migrate_roles(s, d):
    older = {"scout": "recon", "analyst": "verdict", "investigator": "discover"}
    names = {**older, **{f"@{a}": f"@{b}" for a, b in older.items()}}
    m = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    old = _log(s, d, "role", "recipient").select("seq", F.coalesce(m[F.col("role")], "role").alias("role"), F.coalesce(m[F.col("recipient")], "recipient").alias("recipient"))
    return migrate.rename_roles(old)


_REMOVED = ", ".join(_quote(t) for t in migrate.REMOVED_TOPICS)


@query(f"SELECT seq, CASE WHEN kind = 'event' OR recipient IN ({_REMOVED}) THEN 1 ELSE archived END AS archived FROM log")
def migrate_archive(s, d):
    return migrate.archive(_log(s, d, "kind", "recipient", "archived")).select("seq", "archived")


@query(
    """SELECT event_id + 1 AS seq, event_type AS sender, '@archive' AS recipient, CASE WHEN event_type IN ('view', 'click') THEN 'ask' ELSE 'close' END AS kind,
  CASE WHEN event_type IN ('view', 'click') THEN CAST(json_object('ask', event_type, 'summary', props) AS VARCHAR) ELSE CAST(json_object('close', event_type, 'summary', props) AS VARCHAR) END AS data_json, 1 AS archived
FROM events WHERE event_id + 1 NOT IN (SELECT seq FROM log)"""
)
def migrate_v1(s, d):
    asked = F.col("event_type").isin("view", "click")
    e = table(s, d, "events")
    old = e.select((F.col("event_id") + 1).alias("seq"), F.col("event_type").alias("role"), F.lit("m").alias("model"), F.col("props").alias("summary"), F.when(asked, F.col("event_type")).alias("ask"), F.when(~asked, F.col("event_type")).alias("close"), F.lit("[]").alias("evidence_json"), F.col("ts").cast("string").alias("created_at"))
    return migrate.from_events(old, _log(s, d, "engagement")).select("seq", "sender", "recipient", "kind", "data_json", "archived")


# --- reconciliation: files that asks and replies name as evidence ------------------------------------------------------------

STATES = """, files AS (
  SELECT l.kind, l.seq, l.engagement || '/' || json_extract_string(x, '$.ref') AS path, json_extract_string(x, '$.sha256') AS digest
  FROM (SELECT *, unnest(CAST(CASE WHEN json_type(evidence_json) = 'ARRAY' THEN evidence_json ELSE '[' || evidence_json || ']' END AS JSON[])) AS x FROM log WHERE json_valid(evidence_json) AND json_type(evidence_json) IN ('ARRAY', 'OBJECT')) l
  WHERE json_extract_string(x, '$.ref') IS NOT NULL),
have AS (SELECT path, max(digest) AS digest FROM files WHERE kind = 'ask' AND digest IS NOT NULL GROUP BY path),
want AS (SELECT path, max(digest) AS digest FROM files WHERE kind = 'reply' GROUP BY path),
diff AS (
  SELECT path, w.digest AS want, h.digest AS have, CASE WHEN w.path IS NULL THEN 'keep' WHEN w.digest IS NULL THEN CASE WHEN h.path IS NULL THEN 'unchanged' ELSE 'delete' END
    WHEN h.path IS NULL THEN 'install' WHEN w.digest = h.digest THEN 'unchanged' ELSE 'update' END AS action
  FROM want w FULL OUTER JOIN have h USING (path))
"""


def _refs(s, d):
    v = F.try_parse_json("evidence_json")
    listed = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)).otherwise(F.try_variant_get(v, "$", "array<variant>"))
    refs = _log(s, d, "kind", "engagement", "evidence_json").select("kind", "engagement", F.explode(listed).alias("x"))
    ref = F.try_variant_get("x", "$.ref", "string")
    return refs.filter(ref.isNotNull()).select("kind", F.concat_ws("/", "engagement", ref).alias("path"), F.try_variant_get("x", "$.sha256", "string").alias("digest"))


def _saved(s, d):
    return _refs(s, d).filter("kind = 'ask'").groupBy("path").agg(F.min("digest").alias("digest")).filter("digest is not null")


def _states(s, d):
    per = _refs(s, d).groupBy("path").agg(*[F.max(F.when(F.col("kind") == k, F.col("digest"))).alias(k) for k in ("ask", "reply")], F.bool_or(F.col("kind") == "reply").alias("planned"))
    return per.filter("planned").select("path", F.col("reply").alias("digest")), per.filter("ask is not null").select("path", F.col("ask").alias("digest"))


@query(STATES + "SELECT path, action, action IN ('update', 'delete') AS conflict FROM diff", name="reconcile")
def reconcile_plan(s, d):
    return reconcile.diff(*_states(s, d)).select("path", "action", "conflict")


@query(STATES + "SELECT action, count(*) AS paths FROM diff GROUP BY action")
def reconcile_counts(s, d):
    return reconcile.summary(reconcile.diff(*_states(s, d)))


@query(STATES + "SELECT path, have AS original_sha256, want AS installed_sha256 FROM diff WHERE action IN ('install', 'update', 'delete')")
def reconcile_manifest(s, d):
    return reconcile.manifest(reconcile.diff(*_states(s, d)))


@query(STATES + ", saved AS (SELECT path, min(digest) AS digest FROM files WHERE kind = 'ask' AND digest IS NOT NULL GROUP BY path), m AS (SELECT d.want IS NOT DISTINCT FROM h.digest AND (d.have IS NULL OR d.have IS NOT DISTINCT FROM b.digest) AS same FROM diff d LEFT JOIN have h USING (path) LEFT JOIN saved b USING (path) WHERE action IN ('install', 'update', 'delete')) SELECT count(*) AS records, count(*) FILTER (WHERE same) AS matching, coalesce(bool_and(same), true) AS allowed FROM m")
def rollback_gate(s, d):
    """What asks name is current; the least digest that they name stands for the backup."""
    want, have = _states(s, d)
    return reconcile.rollback_gate(reconcile.manifest(reconcile.diff(want, have)), have, _saved(s, d))


# --- audit ------------------------------------------------------------------------------------------------------------------

BLOCK = (
    ENVELOPE
    + """, blocks AS (SELECT engagement, seq, chr(10) || '### ' || concat_ws(' | ', replace(created_at, '+00:00', 'Z'), role, model, engagement, 'seq=' || seq) || chr(10) || 'JSON: ' || envelope || chr(10) ||
  CASE WHEN kind IN ('reply', 'close') THEN 'CLOSE' ELSE 'ASK' END || ': ' || recipient || chr(10) || chr(10) AS block FROM env)
"""
)


@query(BLOCK + "SELECT engagement, seq, block FROM blocks")
def audit_block(s, d):
    return audit.blocks(_log(s, d, *_BODY, "created_at", "role", "model"))


@query(", m AS (SELECT max(seq) AS top FROM log) SELECT seq, engagement FROM log, m WHERE seq > top // 4 AND seq <= top * 3 // 4")
def audit_range(s, d):
    """The middle half of the range of seq."""
    top = table(s, d, "messages").agg(F.max("seq")).first()[0] or 0
    return audit.between(_log(s, d, "engagement"), top // 4, top * 3 // 4).select("seq", "engagement")


@query("SELECT engagement, count(*) AS projected, max(seq) AS cursor FROM log GROUP BY engagement")
def audit_summary(s, d):
    return audit.progress(_log(s, d, "engagement"))


@query(BLOCK + "SELECT engagement AS source, coalesce(max(seq) FILTER (WHERE NOT open), 0) AS cursor FROM (SELECT engagement, seq, seq = max(seq) OVER (PARTITION BY engagement) AS open FROM blocks) GROUP BY engagement")
def audit_recover(s, d):
    """The audit texts with each engagement's last block cut off before its terminator."""
    blocks = audit.blocks(_log(s, d, *_BODY, "created_at", "role", "model"))
    last = blocks.groupBy("engagement").agg(F.max("seq").alias("last"))
    parts = blocks.join(last, "engagement").select("engagement", "seq", F.posexplode(F.split(F.when(F.col("seq") == F.col("last"), F.regexp_replace("block", r"(?s)\n(?:ASK|CLOSE): [^\n]*\n\n$", "\n")).otherwise(F.col("block")), "\n")).alias("n", "line"))
    lines = parts.select(F.col("engagement").alias("source"), (F.col("seq") * 1000 + F.col("n")).alias("line_no"), "line", F.lit(True).alias("ended"))
    return audit.recover(lines)


def _entries(s, d):
    """The log as session entries: replies and closes are checkpoints from what they answer to themselves; closes name
    the other end as their agent and events are no custom entries, so neither counts."""
    rows = _log(s, d, "engagement", "sender", "recipient", "kind", "reply_to").filter("sender is not null")
    kind = F.coalesce("kind", F.lit(""))
    return rows.select(
        F.col("sender").alias("agent_id"),
        "engagement",
        F.col("seq").alias("position"),
        F.when(kind == "event", "message").otherwise("custom").alias("type"),
        F.when(kind.isin("reply", "close"), audit.CHECKPOINT).otherwise("completion").alias("name"),
        F.when(kind == "close", F.col("recipient")).otherwise(F.col("sender")).alias("agent"),
        F.col("engagement").alias("of"),
        F.when(F.col("reply_to") > F.col("seq"), F.lit(-1)).otherwise(0).cast("long").alias("after"),
        F.col("seq").alias("cursor"),
        F.array("reply_to").alias("seqs"),
    )


@query(
    """, c AS (SELECT sender AS agent_id, seq, reply_to, CASE WHEN reply_to > seq THEN -1 ELSE 0 END AS after FROM log WHERE sender IS NOT NULL AND (kind = 'reply' OR (kind = 'close' AND recipient = sender))),
good AS (SELECT * FROM c WHERE after >= 0 AND EXISTS (SELECT 1 FROM log l WHERE l.recipient = c.agent_id AND l.seq = c.reply_to AND l.archived = 0))
SELECT c.agent_id, coalesce(max(g.seq), 0) AS cursor FROM c LEFT JOIN good g ON g.agent_id = c.agent_id AND g.seq = c.seq GROUP BY c.agent_id"""
)
def cursor_recovery(s, d):
    """Delivered is what was sent to the agent itself, so checkpoints that answer a topic or a stray seq are rejected."""
    own = _log(s, d, *_ADDRESS).filter("archived = 0 and recipient is not null").select(F.col("recipient").alias("agent_id"), "seq")
    return audit.recovered_cursors(audit.session_checkpoints(_entries(s, d)), own)


@query("SELECT engagement, name FROM members WHERE name IS NOT NULL GROUP BY engagement, name HAVING count(*) > 1")
def duplicate_names(s, d):
    return frames.named_twice(_members(s, d, "engagement", "name"), "engagement")


@query(FANOUT + "SELECT agent_id, count(DISTINCT seq) AS delivered FROM fan GROUP BY agent_id")
def delivered_set(s, d):
    return inbox.delivered(_log(s, d, *_ADDRESS), _members(s, d, *_AGENT))
