"""Desired against current state of keyed digests (REC, JON7, SET)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(desired: DataFrame, current: DataFrame) -> DataFrame:
    """REC1, REC2, JON7, SET4: (path, action, conflict) of every path of either side.

    Both have path and digest, one row a path; a null desired digest is a tombstone. action: install, update,
    delete, unchanged or keep (nothing is wanted of a current path). conflict: a changed path is there already.
    """
    both = desired.select("path", F.col("digest").alias("want"), F.lit(True).alias("planned")).join(current.select("path", F.col("digest").alias("have"), F.lit(True).alias("there")), "path", "full_outer")
    action = (
        F.when(F.col("planned").isNull(), "keep")
        .when(F.col("want").isNull(), F.when(F.col("there"), "delete").otherwise("unchanged"))
        .when(F.col("there").isNull(), "install")
        .when(F.col("want") == F.col("have"), "unchanged")
        .otherwise("update")
    )
    return both.select("path", action.alias("action"), action.isin("update", "delete").alias("conflict"), "want", "have")


def summary(changes: DataFrame) -> DataFrame:
    """AGG7: how many paths each action has."""
    return changes.groupBy("action").agg(F.count(F.lit(1)).alias("paths"))


def manifest(changes: DataFrame) -> DataFrame:
    """REC3: (path, original_sha256, installed_sha256) of the paths that change, to undo them by."""
    return changes.filter(F.col("action").isin("install", "update", "delete")).select("path", F.col("have").alias("original_sha256"), F.col("want").alias("installed_sha256"))


def rollback_gate(records: DataFrame, current: DataFrame, backups: DataFrame) -> DataFrame:
    """REC4: (records, matching, allowed): a rollback is allowed only if every record's path still has its digest, or is
    still absent where it was removed, and the backup of what was there before still has the digest of that. Both
    tables have path and digest. No records: allowed."""
    both = records.join(current, "path", "left").join(backups.select("path", F.col("digest").alias("saved")), "path", "left")
    whole = F.col("original_sha256").isNull() | F.col("original_sha256").eqNullSafe(F.col("saved"))
    same = F.col("installed_sha256").eqNullSafe(F.col("digest")) & whole
    return both.agg(F.count(F.lit(1)).alias("records"), F.count_if(same).alias("matching"), F.coalesce(F.bool_and(same), F.lit(True)).alias("allowed"))
