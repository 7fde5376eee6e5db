"""Versioned migrations of the log and of catalogs (MIG)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.errors import LogError
from logmill.functions.rules import SELECTOR, SELECTOR_CHARS
from logmill.plans.skew import join_one
from logmill.sources.views import REMOVED_ROLES, ROLES

VERSION = 4
VERSIONS = {None, "1", "2", "3"}
# Role names of versions 1 and 2, and what they became.
RENAMED_ROLES = {"plan": "planner", "recon": "scout", "discover": "finder", "gate": "verifier", "proof": "exploiter", "verdict": "skeptic", "review": "reviewer", "patch": "tester"}
# Topics of older versions that nobody reads.
REMOVED_TOPICS = ["@learning", "@archive", *[f"@{r}" for r in REMOVED_ROLES]]
#: Columns that older versions lack, with type and default.
ADDED = {"participants": {"agent_id": ("string", None), "parent": ("string", None), "model_source": ("string", "asserted")}, "messages": {"archived": ("int", 0)}}


def needs_migration(version: str | None) -> bool:
    """MIG6: False for the current version; refuses an unknown one."""
    if version == str(VERSION):
        return False
    if version not in VERSIONS:
        raise LogError(f"unsupported version: {version}")
    return True


def add_columns(df: DataFrame, table: str) -> DataFrame:
    """MIG1: the columns that the table lacks, with their defaults; others stay as they are."""
    for name, (kind, default) in ADDED[table].items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


def fill_ids(participants: DataFrame) -> DataFrame:
    """MIG2, FN6: a missing agent_id becomes ``a`` and seq in hexadecimal."""
    return participants.withColumn("agent_id", F.coalesce("agent_id", F.concat(F.lit("a"), F.lower(F.hex("seq")))))


def _renamed(column: str, mark: str = ""):
    names = F.create_map(*[F.lit(f"{mark}{x}") for pair in RENAMED_ROLES.items() for x in pair])
    return F.coalesce(names[F.col(column)], F.col(column))


def rename_roles(df: DataFrame) -> DataFrame:
    """MIG4: old role names in ``role`` and, as topics, in ``recipient``. No new name is an old one: one pass does."""
    df = df.withColumn("role", _renamed("role"))
    return df.withColumn("recipient", _renamed("recipient", "@")) if "recipient" in df.columns else df


def archive(messages: DataFrame) -> DataFrame:
    """MIG5: every event and every message to a removed topic is archived."""
    gone = (F.col("kind") == "event") | F.col("recipient").isin(*REMOVED_TOPICS)
    return messages.withColumn("archived", F.when(F.coalesce(gone, F.lit(False)), 1).otherwise(F.coalesce("archived", F.lit(0))))


def from_events(events: DataFrame, messages: DataFrame) -> DataFrame:
    """MIG3: version-1 events as archived messages, unless a message has their seq.

    ``events``: seq, role, model, summary, ask, close, evidence_json, created_at. An event with a non-null ask is an
    ask, any other a close.
    """
    ask = F.col("ask").isNotNull()
    data = F.when(ask, F.to_json(F.struct("ask", "summary"))).otherwise(F.to_json(F.struct("close", "summary"), {"ignoreNullFields": "false"}))
    made = events.select("seq", F.col("role").alias("sender"), F.lit("@archive").alias("recipient"), F.when(ask, "ask").otherwise("close").alias("kind"), data.alias("data_json"), "evidence_json", "role", "model", "created_at", F.lit(1).alias("archived"))
    return join_one(made, messages.select("seq").distinct(), ["seq"], "left_anti")


def old_catalog(catalog: dict, defaults: dict[str, str]) -> dict:
    """MIG7: a version-3 catalog becomes the defaults of this version, if it has exactly the eight old roles and
    good selectors; anything else is refused. A catalog is one small document of the driver."""
    models = catalog.get("models")
    good = catalog.get("schema_version") == 3 and isinstance(models, dict) and set(models) == {*REMOVED_ROLES, "scout"}
    if not good or not all(isinstance(m, str) and len(m) <= SELECTOR_CHARS and re.fullmatch(SELECTOR[2:-2], m) for m in models.values()):
        raise LogError("the version 3 catalog is not valid")
    return {"schema_version": VERSION, "models": dict(defaults)}


def legacy_catalog(entries: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """MIG8: (role, selector) of an older catalog: a string, or the first of its ``models``, or the default.

    ``entries``: role, entry (JSON text). Roles of this version only.
    """
    rows = [(r, defaults.get(r)) for r in ROLES]
    base = entries.sparkSession.createDataFrame(rows, "role string, fallback string")
    value = F.try_parse_json("entry")
    text = F.try_variant_get(value, "$", "string")
    listed = F.try_variant_get(value, "$.models[0]", "string")
    given = entries.select("role", F.when(F.schema_of_variant(value) == "STRING", text).otherwise(listed).alias("selector"))
    return base.join(given, "role", "left").select("role", F.coalesce("selector", "fallback").alias("selector"))
