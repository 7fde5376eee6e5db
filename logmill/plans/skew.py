"""Joins and ranks that keep hot keys out of single tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.plans.ship import ship

#: A key with more rows than this is spread over one task for each so many rows.
HOT_ROWS = 200_000


def join_one(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Join ``many`` with ``one``, which has one row a key or a few, however often a key occurs in ``many``.

    Keys with more than ``hot_rows`` rows in ``many`` get salts on both sides, as many as their counted rows fill with
    ``hot_rows`` each, so no salt has much more rows however hot its key is. There are at most rows / hot_rows such keys
    and as many salts again, which bounds the broadcast and the copies: 500,000 for 1e11 rows. ``how``: inner, left,
    left_semi or left_anti. Where ``rows``, a known count of ``many``, is no more than one hot key has, none is looked for. Null keys match nothing; for ``left`` and ``left_anti`` they are kept apart so that
    they don't meet in one task.
    """
    present = F.lit(True)
    for k in keys:
        present &= F.col(k).isNotNull()
    held = many.filter(present)
    if rows is not None and rows <= hot_rows:
        plain = held.join(one, keys, how)
        return plain.unionByName(many.filter(~present), allowMissingColumns=True) if how in ("left", "left_anti") else plain
    hot = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > hot_rows).select(*keys, F.ceil(F.col("__rows") / F.lit(hot_rows)).alias("__salts"))
    spread = F.pmod(F.xxhash64(*[many[c] for c in many.columns]), F.col("__salts"))
    left = held.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.coalesce(spread, F.lit(0).cast("long"))).drop("__salts")
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__salts") - 1, F.lit(0).cast("long")))
    right = one.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(salts)).drop("__salts")
    joined = left.join(right, [*keys, "__salt"], how).drop("__salt")
    if how in ("left", "left_anti"):
        joined = joined.unionByName(many.filter(~present), allowMissingColumns=True)
    return joined


def rank_in_group(df: DataFrame, group: str, order: str, name: str, block: int = 65_536) -> DataFrame:
    """Number the rows of each group from 1 in the order of ``order``, a long that is unique within the group.

    Each group is cut into blocks of ``block`` consecutive values of ``order``; a task ranks one block (at most
    ``block`` rows) and adds the counts of the blocks before it. So no group, however large, meets in one task.
    """
    cut = df.withColumn("__block", F.floor(F.col(order) / F.lit(block)))
    sizes = cut.groupBy(group, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(group, "__block").orderBy(order))
    return cut.join(starts, [group, "__block"]).withColumn(name, within.cast("long") + F.col("__before")).drop("__block", "__before")


def previous_in_group(df: DataFrame, group: str, order: str, value: str, name: str, block: int = 65_536) -> DataFrame:
    """The ``value`` of the row before, in the order of ``order``, a long that is unique within the group.

    As ``rank_in_group``, block by block: the first row of a block takes the last value of the block before it.
    """
    cut = df.withColumn("__block", F.floor(F.col(order) / F.lit(block)))
    row = F.max(F.struct(order, F.col(value).alias("v")))
    lasts = cut.groupBy(group, "__block").agg(row.alias("__last"))
    carried = lasts.select(group, "__block", F.lag("__last.v").over(Window.partitionBy(group).orderBy("__block")).alias("__carry"))
    within = Window.partitionBy(group, "__block").orderBy(order)
    first = F.row_number().over(within) == 1
    return cut.join(carried, [group, "__block"]).withColumn(name, F.when(first, F.col("__carry")).otherwise(F.lag(value).over(within))).drop("__block", "__carry")


def first_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row a key: the least by ``order``, then by the kept columns; aggregated before the shuffle."""
    fields = [*order, *(c for c in keep if c not in order)]
    row = F.struct(*[F.col(c) for c in fields])
    return df.groupBy(*keys).agg(F.min(row).alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in keep])


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan with work for less than half of the cores (a small file of one row group), dealt out by ``key``.

    Large tables have more splits than cores and pass unchanged, without a shuffle. ``scan`` must be a scan with
    projections and filters only: its partitions are counted without running anything.
    """
    ship(scan.sparkSession)  # scans are spread for Python's sake
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan._jdf.rdd().getNumPartitions() * 2 <= cores else scan


def text_key(column: Column | str) -> Column:
    """Trimmed and in lower case, as ids, topics, kinds and sources are compared; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
