"""Routing, envelopes, inbox pages and rosters (JON1, PRO1, PRO2, LIM, AGG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.errors import LogError
from logmill.functions import rules as R
from logmill.plans.skew import join_one
from logmill.sources.views import MAIN, ROLES

# Fixed value: what stands for a message that is larger than an envelope may be.
ARCHIVE_NAME = "agentschat.md"


def known(members: DataFrame) -> DataFrame:
    """FLT2: members whose id fits the pattern and whose role is of this version."""
    return members.filter(R.valid_agent_id(F.col("agent_id")) & F.col("role").isin(*ROLES, MAIN))


def addresses(members: DataFrame) -> DataFrame:
    """(engagement, agent_id, recipient): the two addresses of each known agent, its id and its role's topic."""
    return known(members).select("engagement", "agent_id", F.explode(F.array("agent_id", F.concat(F.lit("@"), "role"))).alias("recipient"))


def fanout(log: DataFrame, members: DataFrame) -> DataFrame:
    """JON1, JON6, FLT3: (engagement, agent_id, seq) of every delivery of an unarchived message.

    Each agent has two addresses, its id and its role's topic; exploding them turns the OR of the rule into one
    equi-join. A sender receives its own topic message, as no rule excludes it.
    """
    live = log.filter("archived = 0").select("engagement", "recipient", "seq")
    # A topic may be most of a log: its messages are salted, its few members are repeated for each salt.
    return join_one(live, addresses(members), ["engagement", "recipient"]).select("engagement", "agent_id", "seq")


def receivers(log: DataFrame, members: DataFrame) -> DataFrame:
    """FLT3: (seq, receivers) of every message, counted from the addresses, not from the deliveries."""
    sizes = addresses(members).groupBy("engagement", "recipient").agg(F.count(F.lit(1)).alias("n"))
    both = join_one(log.select("seq", "engagement", "recipient", "archived"), sizes, ["engagement", "recipient"], "left")
    return both.select("seq", F.when(F.col("archived") == 0, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("receivers"))


def delivered(log: DataFrame, members: DataFrame) -> DataFrame:
    """AGG8: (agent_id, delivered): how many messages each agent received, added up from its addresses. Agents without
    any give no row."""
    held = log.filter("archived = 0").groupBy("engagement", "recipient").agg(F.count(F.lit(1)).alias("n"))
    return join_one(addresses(members), held, ["engagement", "recipient"]).groupBy("agent_id").agg(F.sum("n").alias("delivered"))


def refs(evidence: Column) -> Column:
    """The refs of an evidence array; a lone object is an array of one; elements without a ref are left out."""
    v = F.try_parse_json(evidence)
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.try_variant_get(e, "$.ref", "string"))
    lone = F.array(F.try_variant_get(v, "$.ref", "string"))
    return F.coalesce(F.array_compact(F.when(F.schema_of_variant(v).startswith("OBJECT"), lone).otherwise(listed)), F.array().cast("array<string>"))


def _json(c: Column) -> Column:
    """A string or an array of strings as JSON; null stays null."""
    if_one = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(if_one, F.lit(2), F.length(if_one) - 2))


def envelope_text(df: DataFrame) -> Column:
    """PRO1: the envelope as JSON with sorted keys; absent keys are absent, not null. data stands as it is stored, and is
    absent where that is no JSON."""
    r = refs(F.col("evidence_json"))
    parts = [
        F.when(F.try_parse_json("data_json").isNotNull(), F.concat(F.lit('"data":'), "data_json")),
        F.concat(F.lit('"from":'), _json(F.col("sender"))),
        F.concat(F.lit('"kind":'), _json(F.col("kind"))),
        F.when(F.size(r) > R.EVIDENCE_REFS, F.concat(F.lit('"more_refs":'), (F.size(r) - R.EVIDENCE_REFS).cast("string"))),
        F.when(F.size(r) > 0, F.concat(F.lit('"refs":'), F.to_json(F.slice(r, 1, R.EVIDENCE_REFS)))),
        F.when(F.col("reply_to").isNotNull(), F.concat(F.lit('"reply":'), F.col("reply_to").cast("string"))),
        F.concat(F.lit('"seq":'), F.col("seq").cast("string")),
        F.concat(F.lit('"to":'), _json(F.col("recipient"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def stub_text() -> Column:
    """What is delivered for an envelope that is too large."""
    seq = F.col("seq").cast("string")
    ends = [F.concat(F.lit(f'"{k}":'), _json(F.col(c))) for k, c in (("from", "sender"), ("kind", "kind"))]
    data = F.concat(F.lit(f'"data":{{"archive":"{ARCHIVE_NAME}","legacy_message":'), seq, F.lit("}"))
    return F.concat(F.lit("{"), F.concat_ws(",", data, *ends, F.concat(F.lit('"seq":'), seq), F.concat(F.lit('"to":'), _json(F.col("recipient")))), F.lit("}"))


def envelopes(log: DataFrame) -> DataFrame:
    """PRO1: (seq, envelope, bytes, delivered_bytes): stored size, and that of the stub where it is too large."""
    text = envelope_text(log)
    size = F.octet_length(text)
    return log.select("seq", text.alias("envelope"), size.alias("bytes"), F.when(size > R.ENVELOPE_BYTES, F.octet_length(stub_text())).otherwise(size).alias("delivered_bytes"))


def check_page(after: int, limit: int) -> None:
    """FLT7."""
    if type(after) is not int or not 0 <= after <= 2**63 - 1 or type(limit) is not int or not 1 <= limit <= R.PAGE_ROWS:
        raise LogError("a page needs a cursor of at least 0 and a limit of 1 to 32")


def _fetched(log: DataFrame, members: DataFrame, after: int, limit: int) -> DataFrame:
    """The first ``limit`` + 1 messages of every agent after the cursor, found address by address: no message is
    delivered to more agents than will look at it, and only messages that are fetched are sized."""
    check_page(after, limit)
    newer = log.filter(F.col("seq") > after)
    here = Window.partitionBy("engagement", "recipient").orderBy("seq")
    # row_number <= k is cut on the map side already (WindowGroupLimit), so an address brings k rows a task.
    heads = newer.filter("archived = 0").select("engagement", "recipient", "seq").withColumn("place", F.row_number().over(here)).filter(F.col("place") <= limit + 1).drop("place")
    mine = Window.partitionBy("engagement", "agent_id").orderBy("seq")
    # A topic may be read by most agents: they are salted, its few messages are repeated for each salt.
    few = join_one(addresses(members), heads, ["engagement", "recipient"]).select("engagement", "agent_id", "seq").withColumn("position", F.row_number().over(mine)).filter(F.col("position") <= limit + 1)
    sizes = envelopes(newer.join(heads.select("seq"), "seq", "left_semi")).select("seq", "delivered_bytes")
    sized = join_one(few, sizes, ["seq"])
    total = R.PAGE_FIXED_BYTES + F.sum(F.col("delivered_bytes") + 1).over(mine.rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("delivered", (total <= R.PAGE_BYTES) & (F.col("position") <= limit))


def pages(log: DataFrame, members: DataFrame, after: int = 0, limit: int = R.PAGE_ROWS) -> DataFrame:
    """LIM1, AGG3: (engagement, agent_id, position, seq, delivered_bytes): the page after a cursor of every agent.

    At most ``limit`` rows in order of seq while 128 + the sum of (bytes + 1) stays within 8,192.
    """
    return _fetched(log, members, after, limit).filter("delivered").select("engagement", "agent_id", "position", "seq", "delivered_bytes")


def cursors(log: DataFrame, members: DataFrame, after: int = 0, limit: int = R.PAGE_ROWS) -> DataFrame:
    """LIM2, AGG1, AGG2: (engagement, agent_id, delivered, cursor, more) of every agent's page.

    With nothing left the cursor jumps to the engagement's high-water mark, archived and other messages included.
    """
    got = _fetched(log, members, after, limit).groupBy("engagement", "agent_id").agg(F.count(F.lit(1)).alias("fetched"), F.count_if("delivered").alias("delivered"), F.max(F.when(F.col("delivered"), F.col("seq"))).alias("last"))
    every = known(members).select("engagement", "agent_id").join(got, ["engagement", "agent_id"], "left").join(high_water(log), "engagement", "left")
    zero = F.lit(0).cast("long")
    more = F.coalesce(F.col("fetched") > F.col("delivered"), F.lit(False))
    last = F.coalesce("last", F.lit(after).cast("long"))
    return every.select("engagement", "agent_id", F.coalesce("delivered", zero).alias("delivered"), F.when(more, last).otherwise(F.greatest(last, F.coalesce("high_water", zero))).alias("cursor"), more.alias("more"))


def high_water(log: DataFrame) -> DataFrame:
    """AGG1: (engagement, high_water) over all messages, archived ones too."""
    return log.groupBy("engagement").agg(F.max("seq").alias("high_water"))


def info(members: DataFrame) -> DataFrame:
    """PRO2: (agent_id, info): the record of an agent as JSON, without parent where there is none."""
    return members.select("agent_id", F.to_json(F.struct(F.col("agent_id").alias("agent"), "model", "model_source", "parent", "role")).alias("info"))


def roster(members: DataFrame, keep: int = R.PAGE_ROWS) -> DataFrame:
    """LIM3: the ``keep`` newest agents of each engagement in order of seq, and whether there are more."""
    current = members.filter(F.col("role").isin(*ROLES, MAIN))
    newest = Window.partitionBy("engagement").orderBy(F.desc("seq"))
    few = current.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= keep + 1)
    more = F.max("back").over(Window.partitionBy("engagement")) > keep
    return few.withColumn("more", more).filter(F.col("back") <= keep).select("engagement", "seq", F.col("agent_id").alias("id"), "name", "role", "model", "model_source", "parent", "more")


def snapshot(engagements: DataFrame, members: DataFrame) -> DataFrame:
    """PRO6: (engagement, program, mode, participants, more): scope and roster; a roster has at most 32 agents."""
    lists = roster(members).groupBy("engagement").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("a"), F.bool_or("more").alias("more"))
    return engagements.join(lists, "engagement", "left").select("engagement", "program", "mode", F.coalesce(F.array_join(F.transform("a", lambda x: x["id"]), ","), F.lit("")).alias("participants"), F.coalesce("more", F.lit(False)).alias("more"))


def render(members: DataFrame, columns: list[str]) -> DataFrame:
    """PRO5, AGG5: (engagement, seq, line): columns padded to the widest value of the whole table, right-stripped.

    The widths are one scalar subquery over one aggregate; no row meets another.
    """
    cells = {c: F.coalesce(F.col(c), F.lit("-")) for c in columns}
    widths = members.agg(F.struct(*[F.max(F.greatest(F.length(cells[c]), F.lit(len(c)))).alias(c) for c in columns]).alias("w")).scalar()
    line = F.concat_ws("  ", *[F.rpad(cells[c], widths[c], F.lit(" ")) for c in columns])
    return members.select("engagement", "seq", F.rtrim(line).alias("line"))
