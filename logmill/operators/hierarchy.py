"""Parent links to full hierarchies (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.plans.pointers import jump
from logmill.plans.scratch import Scratch
from logmill.plans.skew import first_by, join_one, text_key


def registrations(participants: DataFrame) -> DataFrame:
    """(agent_id, parent, engagement): one row an agent, from its row with the lowest seq.

    Rows with the same seq are one row, the earliest to arrive. Rows without agent_id give none; a row without
    seq counts as the latest. Ids are trimmed and in lower case, a blank parent is null.
    """
    parent = text_key("parent")
    rows = participants.select(
        F.coalesce("seq", F.lit(2**63 - 1)).alias("seq"),
        "arrived_at",
        text_key("agent_id").alias("agent_id"),
        F.when(parent != "", parent).alias("parent"),
        F.coalesce("engagement", F.lit("")).alias("engagement"),
    ).filter("agent_id <> ''")
    return first_by(rows, ["agent_id"], ["seq", "arrived_at"], ["parent", "engagement"])


def ancestry(participants: DataFrame) -> DataFrame:
    """(agent_id, root_id, depth, steps) of every agent; steps are the agent ids from the root to the agent.

    A parent that is no agent of the same engagement counts as none (null engagements count as one). Agents in a
    cycle, a self-reference included, or below one have root_id '', depth -1 and no steps. Repeated rows change
    nothing; an empty table gives no rows; further columns are ignored. Ids may hold any character.
    """
    scratch = Scratch(participants.sparkSession, "hierarchy")
    agents = scratch.write(registrations(participants), "agents")
    known = agents.select(F.col("agent_id").alias("parent"), "engagement", F.lit(True).alias("known"))
    child = agents.filter("parent is not null")
    linked = join_one(child, known, ["engagement", "parent"], "left").select(F.col("agent_id").alias("node"), F.when(F.col("known"), F.col("parent")).alias("parent"))
    links = linked.unionByName(agents.filter("parent is null").select(F.col("agent_id").alias("node"), "parent"))
    return jump(links, scratch, paths=True).select(
        F.col("node").alias("agent_id"),
        F.coalesce("root", F.lit("")).alias("root_id"),
        "depth",
        F.coalesce("path", F.array().cast("array<string>")).alias("steps"),
    )


def hierarchy(participants: DataFrame) -> DataFrame:
    """(agent_id, root_id, depth, path) of every agent: ``ancestry`` with the steps joined by ``/``."""
    return ancestry(participants).select("agent_id", "root_id", "depth", F.array_join("steps", "/").alias("path"))


def descendants(tree: DataFrame) -> DataFrame:
    """(agent_id, descendant_id, distance): every agent below every agent, from the steps of ``ancestry``.

    As large as the sum of the depths, which is the closure itself; no join and no shuffle. Agents of cycles have
    no steps and give no rows.
    """
    steps = F.posexplode(F.slice("steps", F.lit(1), F.col("depth").cast("int")))
    return tree.filter("depth > 0").select(F.col("agent_id").alias("descendant_id"), "depth", steps.alias("at", "agent_id")).select("agent_id", "descendant_id", (F.col("depth") - F.col("at")).cast("long").alias("distance"))


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(agent_id, descendants, height) of every agent on no cycle."""
    below = descendants(tree).groupBy("agent_id").agg(F.count(F.lit(1)).alias("descendants"), F.max("distance").alias("height"))
    own = tree.filter("depth >= 0").select("agent_id", F.lit(0).cast("long").alias("descendants"), F.lit(0).cast("long").alias("height"))
    return below.unionByName(own).groupBy("agent_id").agg(F.max("descendants").alias("descendants"), F.max("height").alias("height"))


def cyclic(tree: DataFrame) -> DataFrame:
    """(agent_id): the agents caught in a cycle or below one."""
    return tree.filter("depth < 0").select("agent_id")
