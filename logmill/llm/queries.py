"""Queries of the training-text problems and their SQL."""

from __future__ import annotations

from logmill.llm import contamination as L
from logmill.llm import conversations as C
from logmill.llm import mixture as M
from logmill.llm import spam as S
from logmill.queries_data import WALK
from logmill.sources.tables import table


def p1_found(s, d):
    return C.conversations(table(s, d, "messages")).select("root_seq", "turn", "seq")


def p1_dialogues(s, d):
    m = table(s, d, "messages")
    return C.dialogues(m, C.conversations(m))


def p1_threads(s, d):
    return C.threads(table(s, d, "messages"))


def p1_dropped(s, d):
    return C.dropped(table(s, d, "messages"))


def _matches(s, d, least=0.0):
    return L.matches(table(s, d, "documents"), table(s, d, "eval_items"), least=least)


def p6_found(s, d):
    return L.leaks(_matches(s, d, 0.5)).select("doc_id", "item_id")


def p6_matches(s, d):
    return _matches(s, d)


def p6_clean(s, d):
    return L.clean(table(s, d, "documents"), _matches(s, d, 0.5)).select("doc_id", "source", "engagement")


def p6_report(s, d):
    return L.leak_report(table(s, d, "eval_items"), _matches(s, d, 0.5))


def p7_mixture(s, d):
    return M.mixture(table(s, d, "documents"), table(s, d, "mix_targets"))[0]


def p7_shares(s, d):
    return M.mixture(table(s, d, "documents"), table(s, d, "mix_targets"))[1]


def p8_found(s, d):
    return S.spam_pages(S.score(table(s, d, "documents"))).select("doc_id")


def p8_scores(s, d):
    return S.score(table(s, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_dialogues": p1_dialogues, "p1_threads": p1_threads, "p1_dropped": p1_dropped, "p6_found": p6_found, "p6_matches": p6_matches, "p6_clean": p6_clean, "p6_report": p6_report, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores}
TURNS = (
    WALK
    + """, full_bodies AS (SELECT DISTINCT seq FROM walk WHERE field = 'data_json' AND json_type(v) NOT IN ('NULL', 'OBJECT', 'ARRAY') AND NOT (json_type(v) = 'VARCHAR' AND trim(v ->> '$', chr(32) || chr(9) || chr(10) || chr(13)) = '')),
m AS (
  SELECT seq, lower(trim(sender)) AS sender, lower(trim(recipient)) AS recipient, lower(trim(kind)) AS kind, reply_to, lower(trim(role)) AS role, dedup_key, engagement,
    CASE WHEN dedup_key IS NOT NULL AND sender IS NOT NULL THEN min(seq) OVER (PARTITION BY lower(trim(sender)), dedup_key) ELSE seq END AS canon FROM once),
take AS (
  SELECT m.* EXCLUDE (reply_to), coalesce(a.canon, m.reply_to) AS reply_to FROM m LEFT JOIN m a ON a.seq = m.reply_to
  WHERE m.canon = m.seq AND m.kind IN ('ask', 'reply', 'close')),
linked AS (
  SELECT t.*, p.seq AS parent, (t.reply_to IS NULL AND t.kind <> 'ask') AS no_parent, (t.reply_to IS NOT NULL AND (p.seq IS NULL OR p.seq >= t.seq)) AS bad_parent,
    (p.seq IS NOT NULL AND NOT coalesce(p.recipient = t.sender OR p.recipient = '@' || coalesce(t.role, ''), false)) AS not_its_recipient,
    (p.seq IS NOT NULL AND NOT coalesce(t.recipient = p.sender, false)) AS wrong_addressee,
    (t.kind = 'ask' AND NOT EXISTS (SELECT 1 FROM take c WHERE c.kind = 'reply' AND c.reply_to = t.seq AND c.engagement IS NOT DISTINCT FROM t.engagement)) AS unanswered,
    t.seq NOT IN (SELECT seq FROM full_bodies) AS empty
  FROM take t LEFT JOIN take p ON p.seq = t.reply_to AND p.engagement IS NOT DISTINCT FROM t.engagement),
rooted AS (
  SELECT seq, seq AS root FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.seq, r.root FROM rooted r JOIN linked l ON l.parent = r.seq),
verdict AS (SELECT r.root FROM rooted r JOIN linked l ON l.seq = r.seq GROUP BY r.root HAVING NOT bool_or(no_parent OR bad_parent OR not_its_recipient OR wrong_addressee OR unanswered OR empty)),
kept AS (SELECT r.root AS root_seq, row_number() OVER (PARTITION BY r.root ORDER BY r.seq) AS turn, r.seq FROM rooted r JOIN verdict v ON v.root = r.root)
"""
)

_FAULTS = ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in C.FAULTS)

#: The other queries depend on tokenizers, on normalised texts or on trained trees; they are tested by brute force.
SQL: dict[str, str] = {
    "p1_found": TURNS + "SELECT root_seq, turn, seq FROM kept",
    "p1_dialogues": TURNS + "SELECT k.root_seq, k.turn, k.seq, m.sender AS speaker, m.role, o.data_json AS text FROM kept k JOIN m ON m.seq = k.seq JOIN once o ON o.seq = k.seq",
    "p1_dropped": TURNS
    + f""", faults AS (
  SELECT coalesce(engagement, '') AS engagement, unnest([{_FAULTS}]) AS fault FROM linked
  UNION ALL SELECT coalesce(engagement, ''), 'cycle' FROM linked WHERE seq NOT IN (SELECT seq FROM rooted))
SELECT engagement, fault, count(*) AS messages FROM faults WHERE fault IS NOT NULL GROUP BY 1, 2""",
    "p1_threads": TURNS
    + """, paths AS (
  SELECT k.root_seq, k.seq, 1 AS turns, CAST(k.seq AS VARCHAR) AS path FROM kept k JOIN linked l ON l.seq = k.seq WHERE l.parent IS NULL
  UNION ALL
  SELECT p.root_seq, l.seq, p.turns + 1, p.path || '/' || l.seq FROM paths p JOIN linked l ON l.parent = p.seq)
SELECT root_seq, seq AS leaf_seq, CAST(turns AS BIGINT) AS turns, path FROM paths WHERE seq NOT IN (SELECT parent FROM linked WHERE parent IS NOT NULL)""",
}
