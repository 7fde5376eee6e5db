"""Readers of documents, frames, artifacts and audit texts, and the sinks that go with them (SRC, SNK)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.errors import LogError
from logmill.functions.rules import ENVELOPE_BYTES
from logmill.operators.inbox import envelopes
from logmill.sources.tables import SCHEMAS

SCOPE = "program string, authorization_basis string, mode string, assets array<string>, allowed_methods array<string>, max_requests bigint, interval_seconds double, created_at string"
CATALOG = "schema_version int, models map<string,string>"


def scopes(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: scope documents, one JSON object a file, with the folder's name as engagement.

    A file that is no JSON object of the schema fails the read.
    """
    rows = spark.read.schema(SCOPE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("engagement"), "*")


def catalogs(spark: SparkSession, path: str) -> DataFrame:
    """SRC3, SRC8: role catalogs, one JSON object a file."""
    return spark.read.schema(CATALOG).option("multiLine", True).option("mode", "FAILFAST").json(path)


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """SRC4, SRC5: (path, bytes, sha256) of every file below ``root``; path is relative to it.

    The content is digested where it is read and goes no further.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").rpartition(":")[2].lstrip("/")
    relative = F.regexp_replace("path", rf"^[a-z0-9]+:/*\Q{base}\E/", "")
    return files.select(relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """SRC6, SRC9: (frame): JSON lines, parted at line feeds only."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("frame"))


def audit_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: (source, line_no, line, ended) of audit texts, for ``audit.recover``.

    Texts are read in splits by line, so a long one is spread over tasks. line_no ascends within a text, with gaps: where a line's
    split begins, plus its place in the split. Only the last line may lack its break: the bytes of a text's lines and
    their breaks then add up to one more than its size.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    placed = read.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("begin"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    bytes_ = F.sum(F.octet_length("line") + 1)
    splits = placed.groupBy("source", "begin").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.max("size").alias("size"), bytes_.alias("bytes"))
    texts = splits.groupBy("source").agg(F.max("begin").alias("end"), (F.sum("bytes") == F.max("size")).alias("whole"))
    known = splits.join(texts, "source").select("source", "begin", "first", F.when(~F.col("whole") & (F.col("begin") == F.col("end")), F.col("last")).alias("torn"))
    lines = placed.join(known, ["source", "begin"])
    return lines.select("source", (F.col("begin") + F.col("n") - F.col("first")).alias("line_no"), "line", F.coalesce(F.col("n") != F.col("torn"), F.lit(True)).alias("ended"))


def create_engagement(scope: DataFrame, path: str) -> None:
    """SNK1: write a scope document where there is none; an existing one is an error."""
    try:
        scope.coalesce(1).write.mode("errorifexists").json(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            raise LogError(f"there is an engagement at {path} already") from e
        raise


def append_log(messages: DataFrame, path: str) -> None:
    """SNK2: append messages to the stored log, by engagement and in order of recipient and seq within a file, so
    that reads of an engagement and an inbox skip the rest. If an envelope is larger than may be, nothing is appended."""
    if not envelopes(messages).filter(F.col("bytes") > ENVELOPE_BYTES).isEmpty():
        raise LogError(f"an envelope exceeds {ENVELOPE_BYTES} bytes")
    names = [c.split(" ")[0] for c in SCHEMAS["messages"].split(", ")]
    ordered = messages.select(*names).repartition("engagement", F.pmod(F.xxhash64("recipient"), F.lit(16))).sortWithinPartitions("engagement", "recipient", "seq")
    ordered.write.mode("append").partitionBy("engagement").parquet(path)


def write_audit(blocks: DataFrame, path: str) -> None:
    """SNK3: audit blocks as text, a folder an engagement, in order of seq within each file."""
    parted = blocks.repartitionByRange("engagement", "seq").sortWithinPartitions("engagement", "seq")
    # The writer ends each row with a line feed, which is the block's last one.
    parted.select("engagement", F.regexp_replace("block", r"\n\z", "").alias("value")).write.mode("append").partitionBy("engagement").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """SNK4, SNK5: replace a JSON folder. It is written beside, then takes the old one's place by renaming, so a failure
    while it is written leaves the old one as it was."""
    spark = df.sparkSession
    new, old = (f"{path.rstrip('/')}.{mark}-{uuid.uuid4().hex[:8]}" for mark in ("new", "old"))
    df.write.mode("errorifexists").json(new)
    at, aside, made = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, old, new))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(at)
    if there and not fs.rename(at, aside):
        raise LogError(f"{path} can't be put aside")
    if not fs.rename(made, at):
        if there:
            fs.rename(aside, at)
        raise LogError(f"{path} can't be replaced")
    if there:
        fs.delete(aside, True)
