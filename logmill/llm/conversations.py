"""Rebuilding conversations from message rows (problem 1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from logmill.functions import jsontree as J
from logmill.plans.pointers import jump
from logmill.plans.scratch import Scratch
from logmill.plans.skew import first_by, join_one, rank_in_group, text_key

#: The kinds that take part.
KINDS = ["ask", "reply", "close"]
#: Why a message breaks its conversation.
FAULTS = ["no_parent", "bad_parent", "not_its_recipient", "wrong_addressee", "unanswered", "empty"]


@F.pandas_udf(BooleanType())
def _blank(text: pd.Series) -> pd.Series:
    return text.map(lambda t: J.is_blank(J.read(t)))


def _messages(messages: DataFrame) -> DataFrame:
    """One narrow row a seq, the earliest to arrive; bodies are judged before the shuffle, so none is moved."""
    kind = text_key("kind")
    body = F.when(kind.isin(KINDS), F.col("data_json"))
    rows = messages.filter("seq is not null").select(
        "seq",
        "arrived_at",
        text_key("sender").alias("sender"),
        text_key("recipient").alias("recipient"),
        kind.alias("kind"),
        "reply_to",
        text_key("role").alias("role"),
        "dedup_key",
        F.coalesce("engagement", F.lit("")).alias("engagement"),
        _blank(body).alias("empty"),
    )
    return first_by(rows, ["seq"], ["arrived_at"], ["sender", "recipient", "kind", "reply_to", "role", "dedup_key", "engagement", "empty"])


def _aliases(rows: DataFrame) -> DataFrame:
    """(seq, canon) of messages sent again: same sender and same non-null dedup_key as one with a lower seq.

    Only keys that occur twice reach the join, and the count of a key is aggregated before the shuffle.
    """
    keyed = rows.filter("dedup_key is not null and sender is not null").select("seq", "sender", "dedup_key")
    again = keyed.groupBy("sender", "dedup_key").agg(F.min("seq").alias("canon"), F.max("seq").alias("last")).filter("last > canon").drop("last")
    return join_one(keyed, again, ["sender", "dedup_key"]).filter("seq > canon").select("seq", "canon")


def turns(messages: DataFrame) -> tuple[DataFrame, Scratch]:
    """Every message that takes part, with its parent, its faults and the root of its conversation.

    (seq, engagement, sender, recipient, kind, role, parent, faults, root, depth). ``parent`` is null if reply_to
    names no ask, reply or close of the same engagement. ``root`` is null for messages of a cycle or below one.
    """
    scratch = Scratch(messages.sparkSession, "conversations")
    rows = scratch.write(_messages(messages), "rows")
    alias = scratch.write(_aliases(rows), "alias")
    first = rows.filter(F.col("kind").isin(KINDS)).drop("dedup_key").join(alias, "seq", "left_anti")
    named = alias.select(F.col("seq").alias("reply_to"), "canon")
    take = scratch.write(
        join_one(first.filter("reply_to is not null"), named, ["reply_to"], "left")
        .withColumn("reply_to", F.coalesce("canon", "reply_to"))
        .drop("canon")
        .unionByName(first.filter("reply_to is null")),
        "take",
    )
    scratch.drop("rows", "alias")
    target = take.select("engagement", F.col("seq").alias("reply_to"), F.col("sender").alias("p_sender"), F.col("recipient").alias("p_recipient"), F.lit(True).alias("known"))
    edged = join_one(take.filter("reply_to is not null"), target, ["engagement", "reply_to"], "left").unionByName(take.filter("reply_to is null"), allowMissingColumns=True)
    answers = take.filter("kind = 'reply' and reply_to is not null").groupBy("engagement", F.col("reply_to").alias("seq")).agg(F.lit(True).alias("answered"))
    full = edged.join(answers, ["engagement", "seq"], "left")

    def fault(name: str, when: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(True)), F.lit(name))

    known, has = F.coalesce("known", F.lit(False)), F.col("reply_to").isNotNull()
    own = (F.col("p_recipient") == F.col("sender")) | (F.col("p_recipient") == F.concat(F.lit("@"), F.coalesce("role", F.lit(""))))
    faults = F.array_compact(
        F.array(
            fault("no_parent", ~has & (F.col("kind") != "ask")),
            fault("bad_parent", has & (~known | (F.col("reply_to") >= F.col("seq")))),
            F.when(known, fault("not_its_recipient", ~F.coalesce(own, F.lit(False)))),
            F.when(known, fault("wrong_addressee", ~F.coalesce(F.col("recipient") == F.col("p_sender"), F.lit(False)))),
            fault("unanswered", (F.col("kind") == "ask") & F.col("answered").isNull()),
            fault("empty", F.col("empty")),
        )
    )
    flagged = scratch.write(full.select("seq", "engagement", "sender", "recipient", "kind", "role", F.when(known, F.col("reply_to")).alias("parent"), faults.alias("faults")), "flagged")
    scratch.drop("take")
    roots = jump(flagged.select(F.col("seq").alias("node"), "parent"), scratch).withColumnRenamed("node", "seq")
    return flagged.join(roots, "seq"), scratch


def conversations(messages: DataFrame) -> DataFrame:
    """The turns of the conversations that are kept: (root_seq, turn, seq, parent, sender, recipient, role, kind).

    A conversation is dropped whole if a message of it has a fault (see FAULTS) or lies on or below a cycle. turn
    counts from 1 in the order of seq; root_seq is the seq of turn 1, as parents have lower seqs. A null sender,
    recipient or role matches nothing; null engagements are one engagement; a row without seq takes no part; rows
    with the same seq are one. Empty tables give no rows.

    A conversation may hold any share of all rows: roots are found by pointer jumping, verdicts are aggregated
    before the shuffle, and turns are counted block by block.
    """
    every, scratch = turns(messages)
    rooted = scratch.write(every, "rooted")
    good = rooted.filter("root is not null").groupBy("root").agg(F.max(F.size("faults")).alias("worst")).filter("worst = 0").select("root")
    kept = scratch.write(join_one(rooted.filter("root is not null").drop("faults", "depth"), good, ["root"], "left_semi"), "kept")
    return rank_in_group(kept, "root", "seq", "turn").select(F.col("root").alias("root_seq"), "turn", "seq", "parent", "sender", "recipient", "role", "kind")


def dropped(messages: DataFrame) -> DataFrame:
    """(engagement, fault, messages): how many messages have each fault; 'cycle' for those without a root."""
    every, _ = turns(messages)
    faults = F.when(F.col("root").isNull(), F.array_append("faults", F.lit("cycle"))).otherwise(F.col("faults"))
    return every.select("engagement", F.explode(faults).alias("fault")).groupBy("engagement", "fault").agg(F.count(F.lit(1)).alias("messages"))


def threads(messages: DataFrame) -> DataFrame:
    """(root_seq, leaf_seq, turns, path): each root-to-leaf path of the kept conversations, seqs joined by '/'.

    One row a message that nothing answers; the paths come from the same doubling of pointers.
    """
    kept = conversations(messages)
    scratch = Scratch(messages.sparkSession, "threads")
    held = scratch.write(kept.select("seq", "parent"), "held")
    tree = jump(held.select(F.col("seq").alias("node"), "parent"), scratch, paths=True)
    leaves = tree.join(held.select(F.col("parent").alias("node")).filter("node is not null").distinct(), "node", "left_anti")
    return leaves.select(F.col("root").alias("root_seq"), F.col("node").alias("leaf_seq"), (F.col("depth") + 1).alias("turns"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def dialogues(messages: DataFrame, kept: DataFrame) -> DataFrame:
    """(root_seq, turn, seq, speaker, role, text): the turns with who speaks and the message's body.

    Bodies of other kinds are not moved, and those of dropped conversations no further than to the join with the kept.
    """
    taking = messages.filter(F.col("seq").isNotNull() & text_key("kind").isin(KINDS)).select("seq", "arrived_at", "data_json")
    bodies = first_by(taking.join(kept.select("seq"), "seq", "left_semi"), ["seq"], ["arrived_at"], ["data_json"])
    return kept.join(bodies, "seq").select("root_seq", "turn", "seq", F.col("sender").alias("speaker"), "role", F.col("data_json").alias("text"))
