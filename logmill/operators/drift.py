"""Schemas that drift between the files of a feed (problem 5).

Each file gets a fingerprint: its fields with the JSON types of their values. Neighbouring fingerprints give the
migration steps (added, removed, renamed, retyped), and every record is routed through the chain of steps of its
feed into one table per record type.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.functions import jsontree as J
from logmill.functions.batches import map_rows
from logmill.operators.migrate import ADDED
from logmill.plans.scratch import Scratch
from logmill.plans.skew import join_one
from logmill.sources.tables import columns

FILE = ["feed", "file_name"]
#: A rename needs this many records with values on both sides, and equal values in more than half of them.
LEAST_PAIRS = 2
#: After every version.
LAST = 2**31 - 1


def _fields(body: str | None):
    """(name, type, hash of the value or None) of each field of a JSON object; no rows for anything else.

    The type is the one that is written: a field that turns from embedded texts to objects is retyped. Values are
    compared as what the texts stand for.
    """
    value = J.read_open(body)
    if isinstance(value, dict):
        for k, v in value.items():
            yield J.clean(k), J.written_kind(v), None if v is None else xxhash.xxh3_64_intdigest(J.canonical(v).encode("utf-8", "surrogatepass")) - 2**63


def _records(dump_rows: DataFrame) -> DataFrame:
    return dump_rows.select(F.coalesce("feed", F.lit("")).alias("feed"), F.coalesce("file_name", F.lit("")).alias("file_name"), "exported_at", "line_no", "rec_key", "body")


def fingerprints(dump_rows: DataFrame) -> DataFrame:
    """(feed, file_name, exported_at, field, type, n_values): one row a field and type of each file.

    A file has a field if any of its records has the key; null values count for the type ``null``. Lines delivered
    twice count once. The counts are made batch by batch before anything is shuffled.
    """
    lines = _records(dump_rows)
    once = lines.groupBy("feed", "file_name", "line_no", F.xxhash64("body").alias("h")).agg(F.min("body").alias("body"), F.min("exported_at").alias("exported_at"))

    def rows(feed: str, file_name: str, exported_at: object, body: str | None):
        for name, kind, _ in _fields(body):
            yield feed, file_name, exported_at, name, kind

    typed = map_rows(once, ["feed", "file_name", "exported_at", "body"], "feed string, file_name string, exported_at timestamp_ntz, field string, type string", rows)
    return typed.groupBy("feed", "file_name", "field", "type").agg(F.min("exported_at").alias("exported_at"), F.count(F.lit(1)).alias("n_values"))


def numbered_files(dump_rows: DataFrame) -> DataFrame:
    """(feed, file_name, version): every file, also one without fields, numbered from 1 in order of export."""
    files = _records(dump_rows).groupBy(*FILE).agg(F.min("exported_at").alias("exported_at"))
    return files.withColumn("version", F.row_number().over(Window.partitionBy("feed").orderBy("exported_at", "file_name"))).drop("exported_at")


def versions(prints: DataFrame, files: DataFrame) -> DataFrame:
    """(feed, file_name, version, field, types): fields of each file; ``files`` as numbered_files has them.

    ``types`` are the types that most non-null values have: one, several in a tie, or none if all are null. The
    window runs over files, not records.
    """
    counted = prints.groupBy(*FILE, "field").agg(F.collect_list(F.when(F.col("type") != "null", F.struct("n_values", "type"))).alias("c"))
    most = F.array_max(F.transform("c", lambda x: x["n_values"]))
    types = F.array_sort(F.transform(F.filter("c", lambda x: x["n_values"] == most), lambda x: x["type"]))
    return counted.select(*FILE, "field", types.alias("types")).join(files, FILE)


@dataclass
class History:
    """The files of some feeds: (feed, file_name, version), their fields as in ``versions``, and what changed."""

    files: DataFrame
    fields: DataFrame
    changes: DataFrame


def changes(dump_rows: DataFrame) -> DataFrame:
    """The changes of ``history``."""
    return history(dump_rows).changes


def history(dump_rows: DataFrame) -> History:
    """Every file's version and fields, and each change between a file and the one before it.

    Changes are (feed, file_name, version, change, field, old_field).

    ``renamed`` if at least two records in both files have values under the gone and the new name and more than
    half of these pairs are equal. Where several names qualify, a gone and a new field are matched if each is the
    other's best (share of equal pairs, then their number, then the name), again until none is left. ``retyped``
    if no type that most values have is the same in both files; a file without values changes no type. A feed's
    first file has no changes; bodies that are no JSON objects and null bodies have no fields.
    """
    scratch = Scratch(dump_rows.sparkSession, "drift")
    files = scratch.write(numbered_files(dump_rows), "files")
    seen = scratch.write(versions(scratch.write(fingerprints(dump_rows), "fingerprints"), files), "versions")
    now = seen.select("feed", "version", "field", F.lit(True).alias("is_now"), F.col("types").alias("now_types"))
    before = seen.select("feed", (F.col("version") + 1).alias("version"), "field", F.lit(True).alias("is_before"), F.col("types").alias("before_types"))
    both = now.join(before, ["feed", "version", "field"], "full_outer")
    # The version after the last has only fields before it and drops out here, as the first does.
    steps = scratch.write(both.filter("version > 1").join(files, ["feed", "version"]), "steps")
    new = steps.filter("is_before is null").select("feed", "file_name", "version", "field")
    gone = steps.filter("is_now is null").select("feed", "file_name", "version", F.col("field"))
    retyped = steps.filter("size(now_types) > 0 and size(before_types) > 0 and not arrays_overlap(now_types, before_types)")
    pairs = scratch.write(_renames(dump_rows, files, new, gone), "renames")
    key = ["feed", "version"]
    renamed = pairs.join(files, key).select("feed", "file_name", "version", F.lit("renamed").alias("change"), F.col("new").alias("field"), F.col("gone").alias("old_field"))

    def plain(df: DataFrame, change: str) -> DataFrame:
        return df.select("feed", "file_name", "version", F.lit(change).alias("change"), "field", F.lit("").alias("old_field"))

    added = plain(new.join(pairs.select(*key, F.col("new").alias("field")), [*key, "field"], "left_anti"), "added")
    removed = plain(gone.join(pairs.select(*key, F.col("gone").alias("field")), [*key, "field"], "left_anti"), "removed")
    return History(files, seen, renamed.unionByName(added).unionByName(removed).unionByName(plain(retyped, "retyped")))


def _renames(dump_rows: DataFrame, files: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """(feed, version, gone, new) of the renamed fields.

    Only files with both gone and new fields are parsed again. Each record's values under gone names meet those of
    the same record under new names: as many combinations as one record's changed fields have.
    """
    key = ["feed", "version"]
    lists = new.groupBy(*key).agg(F.collect_set("field").alias("new")).join(gone.groupBy(*key).agg(F.collect_set("field").alias("gone")), key)
    wanted = lists.select("feed", "version", F.lit("new").alias("side"), F.col("new").alias("names")).unionByName(lists.select("feed", "version", F.lit("gone").alias("side"), F.col("gone").alias("names")))
    at = wanted.withColumn("file_version", F.when(F.col("side") == "new", F.col("version")).otherwise(F.col("version") - 1))
    named = at.join(files.withColumnRenamed("version", "file_version"), ["feed", "file_version"]).select("feed", "file_name", "version", "side", "names")
    # A file may be most of a dump; it meets two rows here, and one below.
    lines = join_one(_records(dump_rows).filter("rec_key is not null").select(*FILE, "rec_key", "line_no", "body"), named, FILE)

    def rows(feed: str, version: int, side: str, rec_key: str, line_no: int | None, names: list[str], body: str | None):
        names = set(names)
        hits = [(k, h) for k, _, h in _fields(body) if k in names and h is not None]
        if hits:
            yield feed, version, side, rec_key, line_no, hits

    parsed = map_rows(lines, ["feed", "version", "side", "rec_key", "line_no", "names", "body"], "feed string, version int, side string, rec_key string, line_no int, hits array<struct<name: string, h: bigint>>", rows)
    # A record that stands in a file several times counts once, by its first line.
    sides = parsed.groupBy(*key, "rec_key").agg(*[F.min(F.when(F.col("side") == s, F.struct("line_no", "hits")))["hits"].alias(s) for s in ("gone", "new")])
    pairs = sides.filter("gone is not null and new is not null").withColumn("g", F.explode("gone")).withColumn("n", F.explode("new"))
    scored = pairs.groupBy(*key, F.col("g.name").alias("gone"), F.col("n.name").alias("new")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("g.h") == F.col("n.h")).alias("equal"))
    fit = scored.filter((F.col("pairs") >= LEAST_PAIRS) & (F.col("equal") * 2 > F.col("pairs")))

    def match(candidates: list) -> list[dict]:
        ranked = sorted(candidates, key=lambda c: (-c["equal"] / c["pairs"], -c["equal"], c["gone"], c["new"]))
        used_gone, used_new, out = set(), set(), []
        for c in ranked:
            if c["gone"] not in used_gone and c["new"] not in used_new:
                used_gone.add(c["gone"])
                used_new.add(c["new"])
                out.append({"gone": c["gone"], "new": c["new"]})
        return out

    # Candidates of one file: at most its changed fields squared, whatever the number of records.
    one = fit.groupBy(*key).agg(F.collect_list(F.struct("gone", "new", "pairs", "equal")).alias("c"))
    chosen = map_rows(one, ["feed", "version", "c"], "feed string, version int, gone string, new string", lambda feed, version, c: [(feed, version, x["gone"], x["new"]) for x in match(c)])
    return chosen


def canonical_names(dump_rows: DataFrame, found: DataFrame) -> DataFrame:
    """(feed, since, until, name, target): under which name a field belongs into the table, from version to version.

    The chained renames of each feed: a chain begins where its field is added, or with the feed, and ends where the
    field is removed; a later field of the same name begins another. It takes the name that the table of the
    record type knows; without one, its first. The chains of a feed are built from its changes, not its records.
    """
    steps = found.filter("change <> 'retyped'").groupBy("feed").agg(F.collect_list(F.struct("version", "change", "old_field", "field")).alias("steps"))
    feeds = dump_rows.select(F.coalesce("feed", F.lit("")).alias("feed"), "record_type").groupBy("feed").agg(F.min("record_type").alias("record_type"))
    known = {t: set(columns(t)) for t in ("participants", "messages")}

    def rows(feed: str, record_type: str | None, steps: list):
        chains: list[list] = []  # [[(since, name), ...], until]
        alive: dict[str, list] = {}
        for version in sorted({x["version"] for x in steps}):
            own = sorted((x for x in steps if x["version"] == version), key=lambda x: (x["old_field"], x["field"]))
            after: dict[str, list] = {}
            for x in own:
                if x["change"] == "renamed":
                    chain = alive.pop(x["old_field"], None)
                    if chain is None:
                        chain = [[(0, x["old_field"])], LAST]
                        chains.append(chain)
                    chain[0].append((version, x["field"]))
                    after[x["field"]] = chain
                elif x["change"] == "removed" and (chain := alive.pop(x["field"], None)):
                    chain[1] = version
                elif x["change"] == "added":
                    after[x["field"]] = [[(version, x["field"])], LAST]
                    chains.append(after[x["field"]])
            alive |= after
        for names, end in chains:
            target = next((n for _, n in names if n in known.get(record_type, ())), names[0][1])
            for (since, name), until in zip(names, [v for v, _ in names[1:]] + [end]):
                if name != target:
                    yield feed, since, until, name, target

    return map_rows(steps.join(feeds, "feed"), ["feed", "record_type", "steps"], "feed string, since int, until int, name string, target string", rows)


#: What the JSON type of a column's values is.
WRITTEN = {"bigint": "integer", "int": "integer", "string": "string"}


def _columns(record_type: str) -> dict[str, str]:
    """The columns that come from the records; engagement and arrival are not exported."""
    return {n: t for n, t in columns(record_type).items() if n not in ("engagement", "arrived_at")}


def steps(seen: History, names: DataFrame, record_type: str) -> DataFrame:
    """(feed, file_name, step, field, target): the rules that a file's records pass on their way into the table.

    ``rename`` to a column's name; ``cast`` where most values have another JSON type than the column, target its type;
    ``default`` for a column that the file lacks and older versions have a value for, target the value; ``extra``
    for a field that the table lacks. One row a field of a file, whatever the number of records.
    """
    table = _columns(record_type)
    at = names.select("feed", F.col("name").alias("field"), "target", "since", "until")
    found = seen.fields.join(at, ["feed", "field"], "left").filter("since is null or (version >= since and version < until)")
    left = seen.fields.join(found.select(*FILE, "field"), [*FILE, "field"], "left_anti")  # its chains are those of other versions
    named = found.select(*FILE, "field", "types", F.coalesce("target", "field").alias("target")).unionByName(left.select(*FILE, "field", "types", F.col("field").alias("target")))
    kinds = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    written = F.create_map(*[F.lit(x) for n, t in table.items() for x in (n, WRITTEN[t])])
    kind, want = F.element_at(kinds, F.col("target")), F.element_at(written, F.col("target"))

    def step(df: DataFrame, name: str, target: Column) -> DataFrame:
        return df.select(*FILE, F.lit(name).alias("step"), "field", target.alias("target"))

    renamed = step(named.filter("field <> target"), "rename", F.col("target"))
    cast = step(named.filter(kind.isNotNull() & (F.size("types") > 0) & ~F.array_contains("types", want)), "cast", kind)
    extra = step(named.filter(kind.isNull()), "extra", F.lit(""))
    rules = [F.struct(F.lit(n).alias("field"), F.lit(str(v)).alias("value")) for n, (_, v) in ADDED[record_type].items() if v is not None]
    every = seen.files.select(*FILE, F.explode(F.array(*rules)).alias("d")).select(*FILE, F.col("d.field").alias("field"), F.col("d.value").alias("value"))
    default = step(every.join(named.select(*FILE, F.col("target").alias("field")), [*FILE, "field"], "left_anti"), "default", F.col("value"))
    return renamed.unionByName(cast).unionByName(default).unionByName(extra)


def migrations(dump_rows: DataFrame, record_type: str) -> DataFrame:
    """The ``steps`` of every file of a record type."""
    rows_in = dump_rows.filter(F.col("record_type") == record_type)
    seen = history(rows_in)
    return steps(seen, canonical_names(rows_in, Scratch(dump_rows.sparkSession, "steps").write(seen.changes, "changes")), record_type)


def unify(dump_rows: DataFrame, record_type: str) -> DataFrame:
    """One consistent table of all files of a record type.

    Every line is routed through the ``steps`` of its file: the chained renames of its feed, casts to the columns of the
    type's table, and defaults of columns that the whole file lacks (not of values that a record lacks). A value
    that does not fit and every field the table lacks stay in ``extra`` as text. Of two fields of a line that belong
    into one column, the one that has its name, else the first by name, with a value gets it, and the other stays in
    ``extra`` under its own name. Columns: dump_id, feed, file_name,
    exported_at, line_no, the table's columns, extra. Lines delivered twice come out once. A body that is no JSON
    object gives a row with nulls, so no line is lost.
    """
    rows_in = dump_rows.filter(F.col("record_type") == record_type)
    scratch = Scratch(dump_rows.sparkSession, "unify")
    seen = history(rows_in)
    names = scratch.write(canonical_names(rows_in, scratch.write(seen.changes, "changes")), "names")
    rules = scratch.write(steps(seen, names, record_type), "steps").filter("step in ('rename', 'default')")
    chosen = [F.map_from_entries(F.collect_list(F.when(F.col("step") == s, F.struct("field", "target")))).alias(a) for s, a in (("rename", "renames"), ("default", "defaults"))]
    per_file = rules.groupBy(*FILE).agg(*chosen)
    once = rows_in.groupBy(F.coalesce("feed", F.lit("")).alias("feed"), F.coalesce("file_name", F.lit("")).alias("file_name"), "line_no", F.xxhash64("body").alias("h")).agg(F.min("dump_id").alias("dump_id"), F.min("exported_at").alias("exported_at"), F.min("body").alias("body"))
    lines = join_one(once, per_file, FILE, "left")

    def rows(dump_id: int, feed: str, file_name: str, exported_at: object, line_no: int | None, body: str | None, renames: list | None, defaults: list | None):
        value = J.read_open(body)
        names = dict(renames or ())
        fields: dict[str, str | None] = {}
        items = value.items() if isinstance(value, dict) else ()
        texts = {J.clean(k): J.clean(t) if (t := J.text_of(J.opened(v))) is not None else None for k, v in items}
        # A key that is a target itself comes first; a renamed one whose place is taken keeps its own name.
        left = []
        for k in sorted(texts, key=lambda k: (k in names, k)):
            name = names.get(k, k)
            if fields.get(name) is None:
                fields[name] = texts[k]
            elif texts[k] is not None:
                left.append(k)
        for k in left:
            name = k
            while fields.get(name) is not None:  # another field was renamed to this one's own name
                name += "_"
            fields[name] = texts[k]
        if isinstance(value, dict):
            fields = dict(defaults or ()) | fields
        yield dump_id, feed, file_name, exported_at, line_no, list(fields.items())

    out = map_rows(lines, ["dump_id", "feed", "file_name", "exported_at", "line_no", "body", "renames", "defaults"], "dump_id bigint, feed string, file_name string, exported_at timestamp_ntz, line_no int, fields map<string,string>", rows)
    typed = {n: F.element_at("fields", F.lit(n)).try_cast(t) for n, t in _columns(record_type).items()}
    fits = lambda k, v: F.coalesce(*[F.when(k == n, c.isNotNull() | v.isNull()) for n, c in typed.items()], F.lit(False))
    extra = F.map_filter("fields", lambda k, v: ~fits(k, v))
    return out.select("dump_id", "feed", "file_name", "exported_at", "line_no", *[c.alias(n) for n, c in typed.items()], extra.alias("extra"))
