"""Joins and ranks of hot keys, scratch tables."""

import pytest
from pyspark.sql import functions as F

from logmill.errors import LogError
from logmill.plans import scratch, skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_one_equals_a_plain_join(how, spark):
    many = spark.range(300).select("id", F.when(F.col("id") < 200, 1).when(F.col("id") < 290, F.col("id")).cast("long").alias("k"))
    one = spark.range(250).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.join_one(many, one, ["k"], how, hot_rows=50)
    want = many.join(one, ["k"], how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert "__salt" not in got.columns
    few = skew.join_one(many, one, ["k"], how, rows=300)
    assert sorted(map(str, few.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_rank_in_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("g"), (F.col("id") * 7).alias("o"))
    got = {(r.g, r.o): r.n for r in skew.rank_in_group(df, "g", "o", "n", block=100).collect()}
    for g in ("hot", "rest"):
        assert [got[k] for k in sorted(x for x in got if x[0] == g)] == list(range(1, sum(x[0] == g for x in got) + 1))


def test_previous_in_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7).alias("o"), (F.col("id") + 5).alias("v"))
    got = {(r.g, r.o): r.p for r in skew.previous_in_group(df, "g", "o", "v", "p", block=100).collect()}
    assert all(got[i % 2, i * 7] == (i + 3 if i > 1 else None) for i in range(1000))


def test_scratch_tables(spark):
    s = scratch.Scratch(spark, "t")
    df = s.write(spark.range(5), "a")
    assert df.count() == 5
    s.drop("a")
    with pytest.raises(Exception):
        df.count()
    scratch.clear_scratch(spark)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    monkeypatch.setattr(scratch, "_set_by_context", lambda s: None)
    with pytest.raises(LogError):
        scratch.shared_folder(Session())


def test_text_key(spark):
    df = spark.createDataFrame([("  ABC\t",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(skew.text_key("t")).collect()] == ["abc", None, ""]


def test_executors_import_the_package_from_anywhere(small, tmp_path):
    """A driver in another folder that alone knows where the package is."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from logmill.queries import QUERIES
print("rows", QUERIES["p4_found"](spark, {small!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in out.stdout, out.stderr[-2000:]
