"""Tables written in the middle of a job.

Iterative operators cut their lineage by writing each round to the folder that all executors share
(``spark.checkpoint.dir``) and reading it back, so a lost executor costs one task, not the loop. Parquet is
used rather than an RDD checkpoint: it is columnar and compressed, and the reader gives AQE true sizes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logmill.errors import LogError
from logmill.plans.ship import ship

SETTING = "spark.checkpoint.dir"
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; in a single local process, where unset, a temporary one."""
    named = spark.conf.get(SETTING, None) or _set_by_context(spark)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise LogError(f"set {SETTING} to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="logmill-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def _set_by_context(spark: SparkSession) -> str | None:
    """The folder that ``setCheckpointDir`` has named, if any."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


class Scratch:
    """The scratch tables of one run of an operator.

    ``drop`` frees a table that no later step reads. What the returned DataFrame still reads stays until
    ``clear_scratch`` or the end of a local process.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_counting(self, df: DataFrame, name: str, rows: Column) -> tuple[DataFrame, int]:
        """``write``, and how many of the rows ``rows`` holds for, counted while they are written."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count_if(rows).alias("rows")), name)
        return out, seen.get["rows"]

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.base}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once its results are written elsewhere."""
    _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
