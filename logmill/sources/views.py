"""The log and the roster as the operators see them, in Spark and, for the checks, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.plans.skew import first_by, text_key

LOG = ["sender", "recipient", "kind", "reply_to", "data_json", "evidence_json", "role", "model", "created_at", "dedup_key", "archived", "engagement"]
MEMBER = ["seq", "session_id", "name", "role", "model", "created_at", "parent", "model_source", "engagement"]
# The roles of agents that work, the label of the main session, and roles of older versions.
ROLES = ["investigator", "scout", "analyst"]
MAIN = "main"
REMOVED_ROLES = ["planner", "finder", "verifier", "exploiter", "skeptic", "reviewer", "tester"]


def log(messages: DataFrame, *names: str) -> DataFrame:
    """One row a seq, the earliest to arrive: ids and kinds folded, archived 0 or 1, null engagement ''.

    ``names``: the columns wanted, all without any; only they are read and shuffled, so an operator that needs no
    body moves none. Of exports that arrived at the same time the least by the wanted columns stays. Rows without
    seq are left out; null values stay null; further columns are ignored.
    """
    made = {c: text_key(c) for c in ("sender", "recipient", "kind")} | {"archived": F.coalesce("archived", F.lit(0)), "engagement": F.coalesce("engagement", F.lit(""))}
    wanted = list(names or LOG)
    rows = messages.filter("seq is not null").select("seq", "arrived_at", *[made.get(c, F.col(c)).alias(c) for c in wanted])
    return first_by(rows, ["seq"], ["arrived_at"], wanted)


def exports(participants: DataFrame, *names: str) -> DataFrame:
    """One row a seq, the earliest to arrive: every registration, refused ones too; ``names`` as in ``log``.

    A blank parent is null, a blank model_source ``asserted``.
    """
    parent, source = text_key("parent"), text_key("model_source")
    made = {
        "agent_id": text_key("agent_id"),
        "parent": F.when(parent != "", parent),
        "model_source": F.coalesce(F.when(source != "", source), F.lit("asserted")),
        "engagement": F.coalesce("engagement", F.lit("")),
    }
    wanted = list(names or ["agent_id", *MEMBER[1:]])
    rows = participants.filter("seq is not null").select("seq", "arrived_at", *[made.get(c, F.col(c)).alias(c) for c in wanted])
    return first_by(rows, ["seq"], ["arrived_at"], wanted)


def members(participants: DataFrame, *names: str) -> DataFrame:
    """One row an agent: its first registration (FLT2, IDM4). ``names``: the columns wanted beside agent_id and seq."""
    wanted = list(names or MEMBER[1:])
    return first_by(exports(participants, "agent_id", *wanted).filter("agent_id <> ''"), ["agent_id"], ["seq"], ["seq", *wanted])


SQL_VIEWS = """
WITH log AS (
  SELECT seq, lower(trim(sender)) AS sender, lower(trim(recipient)) AS recipient, lower(trim(kind)) AS kind, reply_to, data_json, evidence_json,
         role, model, created_at, dedup_key, coalesce(archived, 0) AS archived, coalesce(engagement, '') AS engagement
  FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY arrived_at) AS rn FROM messages WHERE seq IS NOT NULL) WHERE rn = 1),
exports AS (
  SELECT seq, session_id, name, role, model, created_at, lower(trim(agent_id)) AS agent_id, nullif(lower(trim(parent)), '') AS parent,
         coalesce(nullif(lower(trim(model_source)), ''), 'asserted') AS model_source, coalesce(engagement, '') AS engagement
  FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY arrived_at) AS rn FROM participants WHERE seq IS NOT NULL) WHERE rn = 1),
members AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY seq) AS rn FROM exports WHERE agent_id <> '') WHERE rn = 1)
"""
