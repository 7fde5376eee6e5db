"""Idempotent ingest, message rules and replies (IDM, FLT, JON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions import rules as R
from logmill.plans.skew import first_by, join_one
from logmill.sources.views import MAIN, ROLES

#: What a key belongs to: each engagement is a log of its own.
KEY = ["engagement", "sender", "dedup_key"]
#: The fields that make two messages with one key the same message (IDM2, IDM3).
CONTENT = ["sender", "recipient", "kind", "reply_to", "data_json", "evidence_json", "role", "model"]


def first_wins(log: DataFrame) -> DataFrame:
    """IDM1: the first message of each (engagement, sender, dedup_key), and every message without a key.

    Null keys are no equals, so they are kept apart instead of meeting in one group.
    """
    keyed = log.filter("dedup_key is not null and sender is not null")
    rest = [c for c in log.columns if c not in KEY]
    return first_by(keyed, KEY, ["seq"], rest).unionByName(log.filter("dedup_key is null or sender is null").select(*KEY, *rest))


def repeats(log: DataFrame) -> DataFrame:
    """IDM1, IDM2: (seq, first_seq, duplicate, conflict) of every message whose key was there before.

    duplicate: the same content as the first; conflict: other content, which is refused.
    """
    keyed = log.filter("dedup_key is not null and sender is not null")
    content = F.struct(*[F.col(c) for c in CONTENT])
    first = keyed.groupBy(*KEY).agg(F.min(F.struct("seq", content.alias("content"))).alias("f"))
    both = join_one(keyed.select("seq", *KEY, content.alias("content")), first, KEY).filter("seq > f.seq")
    same = F.col("content").eqNullSafe(F.col("f.content"))
    return both.select("seq", F.col("f.seq").alias("first_seq"), same.alias("duplicate"), (~same).alias("conflict"))


def _json_kind(text: Column) -> Column:
    """object, array, another type's name, or null for what is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(F.lower(kind))


def violations(log: DataFrame) -> DataFrame:
    """FLT4: (seq, violations) with the codes of every rule a message breaks, in order, joined by commas."""
    data, evidence = _json_kind(F.col("data_json")), _json_kind(F.col("evidence_json"))
    rules = [
        ("kind", ~F.coalesce(F.col("kind").isin("ask", "reply", "close"), F.lit(False))),
        ("data", ~F.coalesce(data == "object", F.lit(False))),
        ("data_bytes", F.octet_length("data_json") > R.DATA_BYTES),
        ("evidence", ~F.coalesce(evidence == "array", F.lit(False))),
        ("evidence_refs", (evidence == "array") & (F.json_array_length("evidence_json") > R.EVIDENCE_REFS)),
        ("key", F.col("dedup_key").isNotNull() & ~R.valid_identifier(F.col("dedup_key"))),
        ("reply_range", F.col("reply_to") < 1),
        ("reply_missing", (F.col("kind") == "reply") & F.col("reply_to").isNull()),
    ]
    codes = F.array_compact(F.array(*[F.when(w, F.lit(c)) for c, w in rules]))
    return log.select("seq", F.array_join(codes, ",").alias("violations"))


def authority(log: DataFrame, members: DataFrame) -> DataFrame:
    """FLT5, JON4: (seq, verdict): unknown_sender, model_differs, unknown_recipient or ok.

    A participant with a role of an older version is unknown.
    """
    current = members.filter(F.col("role").isin(*ROLES, MAIN) & R.valid_agent_id(F.col("agent_id"))).select("engagement", "agent_id", "model")
    sender = current.select("engagement", F.col("agent_id").alias("sender"), F.col("model").alias("own_model"), F.lit(True).alias("knows_sender"))
    target = current.select("engagement", F.col("agent_id").alias("recipient"), F.lit(True).alias("knows_recipient"))
    rows = log.select("seq", "engagement", F.coalesce("sender", F.lit("")).alias("sender"), F.coalesce("recipient", F.lit("")).alias("recipient"), "model")
    both = join_one(join_one(rows, sender, ["engagement", "sender"], "left"), target, ["engagement", "recipient"], "left")
    topic = F.col("recipient").isin(*[f"@{r}" for r in (*ROLES, MAIN)])
    verdict = (
        F.when(F.col("knows_sender").isNull(), "unknown_sender")
        .when(~F.col("own_model").eqNullSafe(F.col("model")), "model_differs")
        .when(~topic & F.col("knows_recipient").isNull(), "unknown_recipient")
        .otherwise("ok")
    )
    return both.select("seq", verdict.alias("verdict"))


def threads(log: DataFrame) -> DataFrame:
    """JON2: (seq, reply_to, original_sender, original_recipient, original_archived) where the original exists."""
    original = log.select("engagement", F.col("seq").alias("reply_to"), F.col("sender").alias("original_sender"), F.col("recipient").alias("original_recipient"), F.col("archived").alias("original_archived"))
    return join_one(log.filter("reply_to is not null").select("seq", "engagement", "reply_to", "sender", "recipient"), original, ["engagement", "reply_to"], "left")


def reply_verdicts(log: DataFrame, members: DataFrame) -> DataFrame:
    """FLT6: (seq, verdict) of messages with reply_to: no_original, not_addressed, wrong_recipient or ok.

    The original must be unarchived and addressed to the replier or to the topic of its registered role.
    """
    role = members.select("engagement", F.col("agent_id").alias("sender"), F.col("role").alias("own_role"))
    both = join_one(threads(log).filter("sender is not null"), role, ["engagement", "sender"], "left")
    mine = (F.col("original_recipient") == F.col("sender")) | (F.col("original_recipient") == F.concat(F.lit("@"), F.col("own_role")))
    verdict = (
        F.when(F.col("original_sender").isNull(), "no_original")
        .when((F.col("original_archived") != 0) | ~F.coalesce(mine, F.lit(False)), "not_addressed")
        .when(~F.col("original_sender").eqNullSafe(F.col("recipient")), "wrong_recipient")
        .otherwise("ok")
    )
    return both.select("seq", verdict.alias("verdict"))


def start_events(members: DataFrame) -> DataFrame:
    """IDM4: the start event of each registered agent that has a parent: (sender, recipient, kind, data_json)."""
    data = F.to_json(F.struct(F.col("agent_id").alias("agent"), F.lit("agent.started").alias("event"), "model", "model_source", "parent", "role"))
    return members.filter("parent is not null").select(F.col("agent_id").alias("sender"), F.col("parent").alias("recipient"), F.lit("event").alias("kind"), data.alias("data_json"))


def refused_registrations(exports: DataFrame) -> DataFrame:
    """§1.4: (seq, session_id, first_seq) of registrations that try to change the identity of a session of their engagement."""
    identity = F.struct("name", "role", "model", "parent", "model_source")
    first = exports.filter("session_id is not null").groupBy("engagement", "session_id").agg(F.min(F.struct("seq", identity.alias("identity"))).alias("f"))
    both = join_one(exports.filter("session_id is not null").select("seq", "engagement", "session_id", identity.alias("identity")), first, ["engagement", "session_id"]).filter("seq > f.seq")
    return both.filter(~F.col("identity").eqNullSafe(F.col("f.identity"))).select("seq", "session_id", F.col("f.seq").alias("first_seq"))


def completions(log: DataFrame, members: DataFrame) -> DataFrame:
    """IDM5: (sender, seq, dedup_key): the first close that each agent sent to its parent, under its computed key."""
    parent = members.filter("parent is not null").select("engagement", F.col("agent_id").alias("sender"), F.col("parent").alias("recipient"))
    closes = log.filter("kind = 'close'").select("engagement", "sender", "recipient", "seq")
    done = join_one(closes, parent, ["engagement", "sender", "recipient"], "left_semi").groupBy("engagement", "sender").agg(F.min("seq").alias("seq"))
    return done.select("sender", "seq", F.concat(F.lit("completion:"), "sender").alias("dedup_key"))
