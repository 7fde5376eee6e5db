"""References to records that do not exist (problem 3).

The operator keeps, for each key (engagement, target table, key), signed counts: how many rows refer to it, how
many rows have it, how many purges note it. Rows that come add to them and rows that go subtract, so a state is carried
from one batch of changes to the next. A key with references and no rows is an orphan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.plans.scratch import Scratch
from logmill.plans.skew import first_by, join_one, text_key

KEY = ["engagement", "target", "key"]
COUNTS = ["n_refs", "n_rows", "n_purges"]


def utc_month(created_at: Column | str) -> Column:
    """yyyy-MM in UTC of an ISO-8601 text, spaced, suffixed or offset in any way; null if it is no time."""
    c = F.col(created_at) if isinstance(created_at, str) else created_at
    instant = F.regexp_replace(c, r"(?U)^\s+|\s+$", "").try_cast("timestamp")
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz")), "yyyy-MM")


@dataclass
class State:
    """What is kept between batches of changes: one narrow row a source row, and signed counts.

    ``rows``: row_id, ref_table, seq, engagement, own_target, own_key, arrived_at, created_at, refs. ``counts``: KEY, at
    and the numbers of references, rows and purges of that key that arrived then; what has gone to zero is left out.
    Times are part of the counts, so a removal takes back the earliest arrival, too.
    """

    rows: DataFrame
    counts: DataFrame


def facts(messages: DataFrame, participants: DataFrame, purges: DataFrame) -> DataFrame:
    """One row for each row of the tables as exported, with what it refers to and the key that it makes exist.

    row_id names the row over all exports: its table and seq (or purge_id; without one, a hash of its fields). refs are
    structs of ref_field, target, key: null and blank values and topics (``@...``) refer to nothing, and rows
    without seq have no name to be reported under, so they refer to nothing either. Keys are trimmed and in lower case, a
    null engagement is ''. Rows that neither exist as a key nor refer are left out.
    """
    ref = "array<struct<ref_field:string,target:string,key:string>>"

    def field(name: str, target: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("ref_field"), F.lit(target).alias("target"), key.alias("key"))

    def fact(df: DataFrame, table: str, number: str, target: Column, key: Column, at: Column, created: Column, refs: Column) -> DataFrame:
        scope = F.coalesce("engagement", F.lit(""))
        seq = F.col(number)
        row_id = F.concat(F.lit(f"{table}/"), F.coalesce(seq.cast("string"), F.concat(F.lit("#"), F.xxhash64(scope, key, at).cast("string"))))
        named = F.when(seq.isNotNull(), F.filter(refs.cast(ref), lambda r: r["key"].isNotNull() & (r["key"] != ""))).otherwise(F.array().cast(ref))
        out = df.select(row_id.alias("row_id"), F.lit(table).alias("ref_table"), seq.alias("seq"), scope.alias("engagement"), target.alias("own_target"), key.alias("own_key"), at.alias("arrived_at"), created.alias("created_at"), named.alias("refs"))
        return out.filter("own_key <> '' or size(refs) > 0")

    recipient = text_key("recipient")
    none = F.lit(None)
    m = fact(messages, "messages", "seq", F.lit("messages"), F.col("seq").cast("string"), F.col("arrived_at"), F.col("created_at"), F.array(field("reply_to", "messages", F.col("reply_to").cast("string")), field("recipient", "participants", F.when(~recipient.startswith("@"), recipient))))
    p = fact(participants, "participants", "seq", F.lit("participants"), text_key("agent_id"), F.col("arrived_at"), F.col("created_at"), F.array(field("parent", "participants", text_key("parent"))))
    g = fact(purges, "purges", "purge_id", text_key("target"), text_key("target_key"), F.col("purged_at"), none.cast("string"), F.array())
    return m.unionByName(p).unionByName(g)


def _once(rows: DataFrame) -> DataFrame:
    """One row a row_id, the earliest to arrive."""
    return first_by(rows, ["row_id"], ["arrived_at"], [c for c in rows.columns if c != "row_id"])


def deltas(rows: DataFrame, sign: int = 1) -> DataFrame:
    """The signed changes of counts that rows make when they come (1) or go (-1)."""

    def one(target: Column, key: Column, which: str | Column) -> Column:
        return F.struct(target.alias("target"), key.alias("key"), *[F.when(which == F.lit(c), sign).otherwise(0).cast("long").alias(c) for c in COUNTS])

    own = one(F.col("own_target"), F.col("own_key"), F.when(F.col("ref_table") == "purges", "n_purges").otherwise("n_rows"))
    every = F.concat(F.array(own), F.transform("refs", lambda r: one(r["target"], r["key"], F.lit("n_refs"))))
    named = F.filter(every, lambda c: F.coalesce(c["key"] != "", F.lit(False)))
    return rows.select("engagement", F.col("arrived_at").alias("at"), F.explode(named).alias("c")).select("engagement", "c.target", "c.key", "at", *[F.col("c")[c].alias(c) for c in COUNTS])


def advance(state: State | None, changed: DataFrame, removed: DataFrame | None = None) -> State:
    """The state after a batch of changes: ``changed`` as from ``facts``, ``removed`` (row_id) rows that are gone.

    Exporting a row again changes nothing unless it arrived earlier; a removed row is gone with all its exports, and
    counts anew when it comes again. Removals of a batch come before its changes. A batch costs one pass over the stored
    rows and counts; only rows named by it are counted anew.
    """
    new = _once(changed)
    if state is None:
        return State(new, deltas(new))
    gone = removed.select("row_id").distinct() if removed is not None else new.select("row_id").limit(0)
    touched = new.select("row_id").unionByName(gone).distinct()
    old = state.rows.join(touched, "row_id", "left_semi")
    after = _once(old.join(gone, "row_id", "left_anti").unionByName(new))
    rows = state.rows.join(touched, "row_id", "left_anti").unionByName(after)
    parts = state.counts.unionByName(deltas(old, -1)).unionByName(deltas(after))
    counts = parts.groupBy(*KEY, "at").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return State(rows, counts.filter(" or ".join(f"{c} <> 0" for c in COUNTS)))


def store(state: State, scratch: Scratch, name: str) -> State:
    """The state written to the shared folder and read again, as it is between two batches."""
    return State(scratch.write(state.rows, f"{name}-rows"), scratch.write(state.counts, f"{name}-counts"))


def per_key(state: State) -> DataFrame:
    """(KEY, n_refs, n_rows, n_purges, first_row, first_ref), aggregated before the shuffle: a key that a third of all
    rows refer to costs one row a task."""
    first = [F.min(F.when(F.col(n) > 0, F.col("at"))).alias(a) for n, a in (("n_rows", "first_row"), ("n_refs", "first_ref"))]
    return state.counts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in COUNTS], *first)


def orphan_keys(state: State) -> DataFrame:
    """Keys with positive references and no rows, or whose rows came after a reference."""
    return per_key(state).filter("n_refs > 0 and (n_rows <= 0 or first_row > first_ref)")


def references(state: State) -> DataFrame:
    """One row a reference: ref_table, ref_field, seq, engagement, target, key, arrived_at, created_at."""
    rows = state.rows.select("ref_table", "seq", "engagement", "arrived_at", "created_at", F.explode("refs").alias("r"))
    return rows.select("ref_table", "r.ref_field", "seq", "engagement", "r.target", "r.key", "arrived_at", "created_at")


def orphans(state: State) -> DataFrame:
    """The references whose key is an orphan, with ``status``: missing, deleted or late.

    ``late``: the target arrived after the referring row. Without a target: ``deleted`` if a purge notes the key,
    else ``missing``. A null arrival is never later. A hot orphan key is salted (``join_one``).
    """
    keys = orphan_keys(state).select(*KEY, "n_rows", "n_purges", "first_row")
    gone = F.col("n_rows") <= 0
    status = F.when(gone & (F.col("n_purges") > 0), "deleted").when(gone, "missing").when(F.col("first_row") > F.col("arrived_at"), "late")
    return join_one(references(state), keys, KEY).withColumn("status", status).filter("status is not null")


def find_orphans(messages: DataFrame, participants: DataFrame, purges: DataFrame) -> DataFrame:
    """All orphan references of the tables, i.e. of the state after one batch that holds them all; columns of
    ``references`` and ``status``. Empty tables give none."""
    return orphans(advance(None, facts(messages, participants, purges)))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, month of created_at ('' if it is no time) and status."""
    month = F.coalesce(utc_month("created_at"), F.lit(""))
    return found.groupBy("ref_table", "ref_field", month.alias("month"), "status").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("key").alias("n_keys"))
