"""JSON frames, task headers, batches and session entries (SRC6, FLT10 to FLT14, PRO9, PRO10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions import rules as R
from logmill.sources.views import ROLES

# Limits of frames, and what a resident server answers to.
FRAME_BYTES = 1_048_576
NOTES = 64
NOTE_BYTES = 8192
BATCH = 4
COMMANDS = ["scope", "register", "message", "inbox", "peers", "project", "show", "dispatch"]
HEADER_BYTES = 2048
#: What a machine-authored header line begins with, now and in older versions; a deployment names its own.
MARK = "Agent-Task:"
OLDER_MARKS = ("AgentJob-Task:",)


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def requests(frames: DataFrame, commands: list[str] | None = None) -> DataFrame:
    """SRC6, FLT11: ``frames`` with id, command and problem: the first rule that a line breaks, null if none.

    too_long, no_json, no_id, no_args, command, bound. ``frame`` is the line without its break. A null line is
    no JSON.
    """
    v = F.try_parse_json("frame")
    args = F.try_variant_get(v, "$.args", "array<variant>")
    texts = F.transform(args, lambda a: F.try_variant_get(a, "$", "string"))
    id_type = _type(F.try_variant_get(v, "$.id", "variant"))
    bound = F.exists(texts, lambda a: a.isin("--engagement", "--help", "-h") | a.startswith("--engagement="))
    problem = (
        F.when(F.octet_length("frame") > FRAME_BYTES, "too_long")
        .when(v.isNull(), "no_json")
        .when(~F.coalesce(_type(v).startswith("OBJECT"), F.lit(False)) | ~F.coalesce(id_type == "BIGINT", F.lit(False)), "no_id")
        .when(F.coalesce(F.size(args) < 1, F.lit(True)) | ~F.coalesce(F.forall(args, lambda a: _type(a) == "STRING"), F.lit(False)), "no_args")
        .when(~F.get(texts, F.lit(0)).isin(*(commands or COMMANDS)), "command")
        .when(bound, "bound")
    )
    return frames.select("*", F.try_variant_get(v, "$.id", "bigint").alias("id"), F.when(problem.isNull(), F.get(texts, F.lit(0))).alias("command"), problem.alias("problem"))


def replies(frames: DataFrame) -> DataFrame:
    """FLT12, SRC9: ``frames`` with problem: no_json, shape (ok with an object, or not ok with an error text), or
    notes (over 64, over 8,192 bytes, or one without a positive seq, two ends, a known kind and object data)."""
    v = F.try_parse_json("frame")
    ok = F.try_variant_get(v, "$.ok", "boolean")
    data, error = F.try_variant_get(v, "$.data", "variant"), F.try_variant_get(v, "$.error", "variant")
    shape = F.when(ok, _type(data).startswith("OBJECT")).otherwise(_type(error) == "STRING")
    notes_value = F.try_variant_get(v, "$.data._messages", "variant")
    notes = F.try_variant_get(notes_value, "$", "array<variant>")

    def good(n: Column) -> Column:
        seq, kind, body = F.try_variant_get(n, "$.seq", "variant"), F.try_variant_get(n, "$.kind", "string"), F.try_variant_get(n, "$.data", "variant")
        ends = (_type(F.try_variant_get(n, "$.from", "variant")) == "STRING") & (_type(F.try_variant_get(n, "$.to", "variant")) == "STRING")
        rule = (_type(seq) == "BIGINT") & (F.try_variant_get(n, "$.seq", "bigint") >= 1) & ends & kind.isin("ask", "reply", "close", "event") & _type(body).startswith("OBJECT")
        return F.coalesce(rule & (F.octet_length(F.to_json(n)) <= NOTE_BYTES), F.lit(False))

    fine = notes_value.isNull() | F.coalesce((F.size(notes) <= NOTES) & F.forall(notes, good), F.lit(False))
    problem = F.when(v.isNull(), "no_json").when(ok.isNull() | ~F.coalesce(shape, F.lit(False)), "shape").when(ok & ~fine, "notes")
    return frames.select("*", problem.alias("problem"))


def page_problems(pages: DataFrame) -> DataFrame:
    """FLT13: ``pages`` (after, cursor, seqs, more) with valid: at most 32 seqs, all in (after, cursor], cursor >= after."""
    rule = (F.size("seqs") <= R.PAGE_ROWS) & (F.col("cursor") >= F.col("after")) & F.col("more").isNotNull() & F.forall("seqs", lambda s: (s > F.col("after")) & (s <= F.col("cursor")))
    return pages.select("*", F.coalesce(rule, F.lit(False)).alias("valid"))


def task_headers(prompts: DataFrame, mark: str = MARK) -> DataFrame:
    """FLT10: ``prompts`` (text) with role, parent, folder and problem (lines, json, fields; null if none).

    Exactly one line begins with the mark; it has at most 2,048 bytes, and its JSON object exactly three fields.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith(mark))
    body = F.substring(F.get(lines, F.lit(0)), F.lit(len(mark) + 1), F.length(F.get(lines, F.lit(0))))
    v = F.try_parse_json(body)
    get = {k: F.try_variant_get(v, f"$.{k}", "string") for k in ("role", "parent", "engagement_dir")}
    strings = F.lit(True)
    for k in get:
        strings &= F.coalesce(_type(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.lit(False))
    keys = F.coalesce(F.array_sort(F.json_object_keys(body)) == F.array(*[F.lit(k) for k in sorted(get)]), F.lit(False))
    problem = (
        F.when(F.coalesce((F.size(lines) != 1) | (F.octet_length(F.get(lines, F.lit(0))) > HEADER_BYTES), F.lit(True)), "lines")
        .when(v.isNull(), "json")
        .when(~(keys & strings & F.coalesce(get["role"].isin(*ROLES) & (get["parent"] != ""), F.lit(False))), "fields")
    )
    ok = problem.isNull()
    return prompts.select("*", F.when(ok, get["role"]).alias("role"), F.when(ok, get["parent"]).alias("parent"), F.when(ok, get["engagement_dir"]).alias("folder"), problem.alias("problem"))


def batches(items: DataFrame, marks: tuple[str, ...] = (MARK, *OLDER_MARKS)) -> DataFrame:
    """FLT14: (batch, items, accepted): a batch of 1 to 4 items is accepted whole or refused whole.

    ``items``: batch, role, task, model, route_model. Known role, non-blank text without a forged header of any
    version, and no other model than the route's.
    """
    forged = F.lit(False)
    for mark in marks:
        forged |= F.concat(F.lit("\n"), "task").contains(f"\n{mark}")
    good = F.col("role").isin(*ROLES) & (R.strip(F.col("task")) != "") & ~forged & (F.col("model").isNull() | (F.col("model") == F.col("route_model")))
    all_good = F.bool_and(F.coalesce(good, F.lit(False)))
    return items.groupBy("batch").agg(F.count(F.lit(1)).alias("items"), (all_good & (F.count(F.lit(1)) <= BATCH)).alias("accepted"))


def text_content(content: Column) -> Column:
    """PRO9: a string as it is, or the ``text`` parts of an array, joined; anything else is ''. ``content`` is JSON."""
    v = F.try_parse_json(content)
    parts = F.from_json(content, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    return F.coalesce(F.when(_type(v) == "STRING", F.try_variant_get(v, "$", "string")).when(_type(v).startswith("ARRAY"), joined), F.lit(""))


def completion_status(entries: DataFrame) -> DataFrame:
    """PRO10: (session, status) by the stop reason of the last assistant entry: failed, cancelled or completed."""
    last = F.max_by(F.when(F.col("role") == "assistant", F.coalesce("stop_reason", F.lit(""))), F.when(F.col("role") == "assistant", F.col("position")))
    got = entries.groupBy("session").agg(last.alias("reason"))
    return got.select("session", F.when(F.col("reason") == "error", "failed").when(F.col("reason") == "aborted", "cancelled").otherwise("completed").alias("status"))


def valid_catalog(catalogs: DataFrame, version: int = 4) -> DataFrame:
    """FLT9, SET1: ``catalogs`` (schema_version, models) with valid: this version, exactly the roles, good selectors."""
    rule = (F.col("schema_version") == version) & (F.array_sort(F.map_keys("models")) == F.array(*[F.lit(r) for r in sorted(ROLES)])) & F.forall(F.map_values("models"), R.valid_selector)
    return catalogs.select("*", F.coalesce(rule, F.lit(False)).alias("valid"))


def named_twice(overrides: DataFrame, group: str) -> DataFrame:
    """AGG8: (group, name) of the overrides that are named more than once, which refuses them."""
    return overrides.filter("name is not null").groupBy(group, "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(group, "name")


def missing(required: Column, packaged: Column) -> Column:
    """SET2: what is required and not packaged, in order."""
    return F.array_sort(F.array_except(required, packaged))
