"""The audit text: blocks, ranges and recovery (PRJ, SRC7, STR3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.operators.inbox import envelope_text
from logmill.plans.skew import join_one, previous_in_group


def blocks(log: DataFrame) -> DataFrame:
    """SNK3, PRJ1, FN5: (engagement, seq, block): the audit block of every message.

    A header with time, role, model, engagement and seq, the envelope, and whom it asks or closes.
    """
    head = F.concat_ws(" | ", F.replace(F.col("created_at"), F.lit("+00:00"), F.lit("Z")), "role", "model", "engagement", F.concat(F.lit("seq="), F.col("seq").cast("string")))
    word = F.when(F.col("kind").isin("reply", "close"), "CLOSE").otherwise("ASK")
    text = F.concat(F.lit("\n### "), head, F.lit("\nJSON: "), envelope_text(log), F.lit("\n"), word, F.lit(": "), "recipient", F.lit("\n\n"))
    return log.select("engagement", "seq", text.alias("block"))


def between(log: DataFrame, after: int, high_water: int) -> DataFrame:
    """LIM4: the messages with after < seq <= high_water; the bounds reach the scan where seq is stored."""
    return log.filter((F.col("seq") > after) & (F.col("seq") <= high_water))


def progress(log: DataFrame) -> DataFrame:
    """AGG6: (engagement, projected, cursor) after all messages are written."""
    return log.groupBy("engagement").agg(F.count(F.lit(1)).alias("projected"), F.max("seq").alias("cursor"))


def recover(lines: DataFrame) -> DataFrame:
    """PRJ2, SRC7: (source, cursor): the highest seq of a complete block of each text.

    ``lines``: source, line_no, line (without its break), ended (whether the break is there). A header
    (``### ... | seq=N``) opens a block; the next ASK: or CLOSE: line completes it. An incomplete one never
    counts. Every header or terminator looks back to the nearest one before it, block by block, so a text of any
    length is spread over tasks.
    """
    number = F.regexp_extract("line", r"^### .* \| seq=(\d+)\r?$", 1).try_cast("long")
    end = F.col("ended") & (F.col("line").startswith("ASK: ") | F.col("line").startswith("CLOSE: "))
    seen = lines.select("source", "line_no", F.when(F.col("ended"), number).alias("header"), end.alias("end")).filter("header is not null or end")
    return previous_in_group(seen, "source", "line_no", "header", "open").groupBy("source").agg(F.coalesce(F.max(F.when(F.col("end"), F.col("open"))), F.lit(0).cast("long")).alias("cursor"))


#: What a session's entries say that they are.
CHECKPOINT = "cursor"


def session_checkpoints(entries: DataFrame, names: tuple[str, ...] = (CHECKPOINT,)) -> DataFrame:
    """FLT17: (agent_id, position, after, cursor, seqs) of the entries that are checkpoints of the session itself.

    ``entries``: agent_id and engagement of the session, position, type, name, and of the entry's data agent, of
    (its engagement), after, cursor, seqs. Other types and names, and data of another agent or engagement, are no
    checkpoints of it.
    """
    own = (F.col("type") == "custom") & F.col("name").isin(*names) & (F.col("agent") == F.col("agent_id")) & (F.col("of") == F.col("engagement"))
    return entries.filter(own).select("agent_id", "position", "after", "cursor", "seqs")


def recovered_cursors(checkpoints: DataFrame, deliveries: DataFrame) -> DataFrame:
    """STR3, JON8: (agent_id, cursor): the cursor of each agent after its checkpoints in order of position.

    ``checkpoints``: agent_id, position, after, cursor, seqs; ``deliveries``: agent_id, seq. A checkpoint counts if
    0 <= after <= the cursor so far, cursor >= after, and every seq of it was delivered (AGG8), which an equi-join
    finds; the cursor never goes back. Null fields and seqs do not count. The fold itself has an order: an agent's
    checkpoints pass through one task as a stream, of which it keeps one number.
    """
    key = ["agent_id", "position"]
    named = checkpoints.select(*key, F.explode("seqs").alias("seq"))
    lost = join_one(named, deliveries.select("agent_id", "seq").distinct(), ["agent_id", "seq"], "left_anti").select(*key).distinct()
    good = F.col("seqs").isNotNull() & (F.col("after") >= 0) & (F.col("cursor") >= F.col("after"))
    marked = checkpoints.select(*key, "after", "cursor", F.coalesce(good, F.lit(False)).alias("good")).join(lost.withColumn("lost", F.lit(True)), key, "left")
    steps = marked.select("agent_id", "position", "after", "cursor", (F.col("good") & F.col("lost").isNull()).alias("ok"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agent, at, begun = None, 0, False
        for batch in batches:
            ids, cursors = [], []
            for name, after, cursor, ok in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3, 4)]):
                if not begun or name != agent:
                    if begun:
                        ids.append(agent)
                        cursors.append(at)
                    agent, at, begun = name, 0, True
                if ok and after <= at < cursor:
                    at = cursor
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(cursors, pa.int64())], names=["agent_id", "cursor"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([agent], pa.string()), pa.array([at], pa.int64())], names=["agent_id", "cursor"])

    ordered = steps.repartition("agent_id").sortWithinPartitions("agent_id", "position")
    return ordered.mapInArrow(fold, "agent_id string, cursor bigint")
