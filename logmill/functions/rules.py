"""Validation and policy rules as column expressions, JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of a message log.
IDENTIFIER_BYTES = 256
DATA_BYTES = 2048
ENVELOPE_BYTES = 4096
PAGE_BYTES = 8192
PAGE_FIXED_BYTES = 128
PAGE_ROWS = 32
EVIDENCE_REFS = 8
SELECTOR_CHARS = 256
# Modes of a scope document, and tokens that make a URL's path ambiguous.
MODES = ["blackbox", "source", "audit", "patch", "development"]
AMBIGUOUS = ["%2e", "%2f", "%5c", "%252e", "%252f", "%255c", "\\"]
# Effort suffixes of a selector.
EFFORTS = ["off", "auto", "inherit", "minimal", "low", "medium", "high", "xhigh", "max"]

_PART = "[A-Za-z0-9][A-Za-z0-9._-]*"
#: provider/model[/more...][:effort]; the end anchor is absolute, so a last newline is refused.
SELECTOR = rf"\A{_PART}(?:/{_PART})+(?::{_PART})?\z"
AGENT = r"\Aa[0-9a-f]{1,16}\z"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def valid_identifier(c: Column, most: int = IDENTIFIER_BYTES) -> Column:
    """FLT1: not blank, at most ``most`` UTF-8 bytes before stripping, no line break or bar. Null is not valid."""
    return F.coalesce((strip(c) != "") & (F.octet_length(c) <= most) & ~c.rlike(r"[\r\n|]"), F.lit(False))


def valid_agent_id(c: Column) -> Column:
    """FLT2's pattern."""
    return F.coalesce(c.rlike(AGENT), F.lit(False))


def valid_selector(c: Column) -> Column:
    """FLT8: the selector grammar, at most 256 characters."""
    return F.coalesce(c.rlike(SELECTOR) & (F.length(c) <= SELECTOR_CHARS), F.lit(False))


def selector_parts(c: Column) -> Column:
    """PRO3: provider, name and effort; parted at the first slash, then at the first colon; no effort is null."""
    rest = F.regexp_extract(c, r"(?s)^[^/]*/(.*)$", 1)
    return F.struct(
        F.regexp_extract(c, r"(?s)^([^/]*)", 1).alias("provider"),
        F.regexp_extract(rest, r"(?s)^([^:]*)", 1).alias("name"),
        F.nullif(F.regexp_extract(rest, r"(?s)^[^:]*:(.*)$", 1), F.lit("")).alias("effort"),
    )


def model_base(c: Column) -> Column:
    """PRO8: a selector without a known effort suffix."""
    return F.regexp_replace(c, rf":(?:{'|'.join(EFFORTS)})\z", "")


def observed_model(provider: Column, name: Column) -> Column:
    """PRO7: provider/id, null if either is null or empty."""
    return F.when((provider != "") & (name != ""), F.concat_ws("/", provider, name))


def asset_class(c: Column) -> Column:
    """POL1: url, dir, or null for a blank asset."""
    return F.when(strip(c) != "", F.when(strip(c).rlike("(?i)^https?://"), "url").otherwise("dir"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def url(c: Column) -> Column:
    """POL2: struct(reason, scheme, host, port, path) of a URL.

    ``reason`` is the first rule that it breaks, null if none: empty, control, malformed, scheme, host, credentials,
    fragment, traversal, encoding, port. The other fields hold values only where it is null. Parsed by expressions:
    Spark's parse_url keeps the case of hosts and refuses names with an underscore.
    """

    def cut(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        return F.struct(u.alias("u"), scheme.alias("scheme"), F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:", "").alias("rest"))

    def parts(p: Column) -> Column:
        net = F.regexp_extract(p["rest"], r"^//([^/?#]*)", 1)
        path = F.regexp_extract(p["rest"], r"^(?://[^/?#]*)?([^?#]*)", 1)
        fragment = F.regexp_extract(p["rest"], r"(?s)#(.*)$", 1)
        return F.struct(p["u"].alias("u"), p["scheme"].alias("scheme"), net.alias("net"), F.coalesce(F.nullif(path, F.lit("")), F.lit("/")).alias("path"), fragment.alias("fragment"), F.regexp_extract(net, r"([^@]*)$", 1).alias("at"))

    def ends(p: Column) -> Column:
        boxed = p["at"].startswith("[")
        host = F.when(boxed, F.regexp_extract(p["at"], r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(p["at"], r"^([^:]*)", 1))
        port = F.when(boxed, F.regexp_extract(p["at"], r"\]:(.*)$", 1)).otherwise(F.regexp_extract(p["at"], r"^[^:]*:(.*)$", 1))
        return F.struct(*[p[k].alias(k) for k in ("u", "scheme", "net", "path", "fragment")], F.lower(host).alias("host"), port.alias("port"), F.lower(p["path"]).alias("low"))

    def judged(p: Column) -> Column:
        ambiguous = F.exists(F.array(*[F.lit(t) for t in AMBIGUOUS]), lambda t: p["low"].contains(t))
        reason = (
            F.when(p["u"] == "", "empty")
            .when(p["u"].rlike(r"[\x00-\x1f\x7f]"), "control")
            .when(p["net"].contains("[") != p["net"].contains("]"), "malformed")
            .when(~p["scheme"].isin("http", "https"), "scheme")
            .when(p["host"] == "", "host")
            .when(p["net"].contains("@"), "credentials")
            .when(p["fragment"] != "", "fragment")
            .when(p["path"].contains(".."), "traversal")
            .when(ambiguous, "encoding")
            .when((p["port"] != "") & ~(p["port"].rlike(r"^[0-9]{1,5}$") & (p["port"].try_cast("int") <= 65535)), "port")
        )
        return F.struct(reason.alias("reason"), *[p[k].alias(k) for k in ("scheme", "host", "port", "path")])

    def kept(p: Column) -> Column:
        ok = p["reason"].isNull()
        return F.struct(p["reason"].alias("reason"), F.when(ok, p["scheme"]).alias("scheme"), F.when(ok, p["host"]).alias("host"), F.when(ok, p["port"].try_cast("int")).alias("port"), F.when(ok, p["path"]).alias("path"))

    return let(let(let(let(let(F.coalesce(strip(c), F.lit("")), cut), parts), ends), judged), kept)


def path_within(prefix: Column, path: Column) -> Column:
    """POL5's path rule: equal to the prefix or below it at a segment's end; a last slash of the prefix is nothing."""
    p = F.when(prefix == "/", prefix).otherwise(F.regexp_replace(prefix, "/+$", ""))
    return p.isin("", "/") | (path == p) | path.startswith(F.concat(p, F.lit("/")))


def url_allowed(asset: Column, target: Column) -> Column:
    """POL5: the target has the asset's origin (an explicit port differs from none) and lies in its path.

    ``asset`` and ``target`` are structs of ``url``; false where either breaks a rule.
    """
    same = (asset["scheme"] == target["scheme"]) & (asset["host"] == target["host"]) & asset["port"].eqNullSafe(target["port"])
    return F.coalesce(same & path_within(asset["path"], target["path"]), F.lit(False))


def asset_problem(asset: Column, mode: Column) -> Column:
    """POL7: blank, needs_url, needs_dir, relative, a reason of ``url``, or null. What exists is not looked up."""
    kind = asset_class(asset)
    return (
        F.when(kind.isNull(), "blank")
        .when((mode == "blackbox") & (kind != "url"), "needs_url")
        .when((mode == "source") & (kind != "dir"), "needs_dir")
        .when(kind == "url", url(asset)["reason"])
        .when(~strip(asset).startswith("/"), "relative")
    )


def normal_path(c: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` steps; null if it is not absolute."""
    none = F.array().cast("array<string>")
    steps = F.aggregate(
        F.filter(F.split(c, "/"), lambda x: ~x.isin("", ".")),
        none,
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)),
    )
    return F.when(c.startswith("/"), F.concat(F.lit("/"), F.array_join(steps, "/")))


def path_allowed(root: Column, path: Column) -> Column:
    """POL6 by the paths' text: equal to the root or below it; false for a relative or null path. Links of the file
    system are not followed."""
    r, p = normal_path(root), normal_path(path)
    return F.coalesce((r == "/") | (r == p) | p.startswith(F.concat(r, F.lit("/"))), F.lit(False)) & p.isNotNull()


def session_agent_id(engagement: Column, session: Column) -> Column:
    """FN7: an agent id made from a session's id and its engagement, so that a retried task makes the same one."""
    return F.concat(F.lit("a"), F.substring(F.sha2(F.concat(engagement, F.lit("/"), session), 256), 1, 16))


def stamp(time: Column) -> Column:
    """FN12: YYYYMMDDTHHMMSSffffffZ of a UTC time."""
    return F.date_format(time, "yyyyMMdd'T'HHmmssSSSSSS'Z'")


def basename(path: Column) -> Column:
    """FN10: the last step of a path."""
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def safe_ref(c: Column) -> Column:
    """FLT15, FLT16: a reference that stays in its folder by its text: an identifier of 512 bytes, relative, and at
    no point above its start. Links of the file system are not followed."""
    step = F.aggregate(
        F.split(c, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out")),
        lambda a, x: F.struct(
            F.when(x == "..", a["depth"] - 1).when(x.isin("", "."), a["depth"]).otherwise(a["depth"] + 1).alias("depth"),
            (a["out"] | ((x == "..") & (a["depth"] <= 0))).alias("out"),
        ),
    )
    return valid_identifier(c, 512) & ~c.startswith("/") & ~F.coalesce(step["out"], F.lit(True))
