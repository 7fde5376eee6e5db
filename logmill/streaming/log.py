"""The log as a stream (STR, PRJ1, SNK2, SNK3).

A log's seq is its cursor: Structured Streaming keeps it as offsets in the checkpoint, so a restarted query goes on
after the last committed batch. Batches may run again after a failure, so every sink here is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logmill.operators import audit
from logmill.operators.inbox import addresses
from logmill.operators.ingest import KEY
from logmill.plans.skew import text_key
from logmill.sources.tables import SCHEMAS


def read_log(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """STR1: the stored messages as a stream of files."""
    return spark.readStream.schema(SCHEMAS["messages"]).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_wins(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """STR4, IDM1: drops messages whose (engagement, sender, dedup_key) came before; null keys are equal to nothing.

    Keyed state grows with the keys unless ``delay`` bounds how late a repeat may arrive, by arrived_at.
    """
    stream = stream.withColumn("engagement", F.coalesce("engagement", F.lit("")))
    keyed, rest = stream.filter("dedup_key is not null and sender is not null"), stream.filter("dedup_key is null or sender is null")
    if delay is None:
        return keyed.dropDuplicates(KEY).unionByName(rest)
    timed = keyed.withColumn("arrived_at", F.col("arrived_at").cast("timestamp")).withWatermark("arrived_at", delay)
    kept = timed.dropDuplicatesWithinWatermark(KEY).withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz"))
    return kept.unionByName(rest)


def deliveries(stream: DataFrame, members: DataFrame) -> DataFrame:
    """STR2, JON6: (engagement, agent_id, seq) of each new message, by one stream-static join with the known agents."""
    address = addresses(members)
    live = stream.filter("coalesce(archived, 0) = 0").select(F.coalesce("engagement", F.lit("")).alias("engagement"), text_key("recipient").alias("recipient"), "seq")
    return live.join(address, ["engagement", "recipient"]).select("engagement", "agent_id", "seq")


def project_audit(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """PRJ1: append the audit block of every message exactly once; runs until all stored messages are projected.

    A batch writes to a folder of its own number and replaces it when it runs again. A message that is exported again
    is known by engagement and seq, which the state store keeps, and is not projected again.
    """
    once = stream.filter("seq is not null").withColumn("engagement", F.coalesce("engagement", F.lit(""))).dropDuplicates(["engagement", "seq"])

    def write(batch: DataFrame, number: int) -> None:
        rows = audit.blocks(batch.withColumns({c: text_key(c) for c in ("sender", "recipient", "kind")}))
        rows.sort("engagement", "seq").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
