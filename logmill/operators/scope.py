"""Scope documents, assets and URLs (SCP1, POL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.functions import rules as R
from logmill.plans.skew import join_one


def assets(engagements: DataFrame) -> DataFrame:
    """POL1, POL7: (engagement, position, asset, class, problem) of every asset; problem is null for a good one."""
    rows = engagements.select("engagement", "mode", F.posexplode("assets").alias("position", "asset"))
    return rows.select("engagement", "position", "asset", R.asset_class(F.col("asset")).alias("class"), R.asset_problem(F.col("asset"), F.col("mode")).alias("problem"))


def normalize(engagements: DataFrame) -> DataFrame:
    """SCP1: (engagement, problems, methods, url_assets, source_roots, max_requests, interval_seconds).

    ``problems`` names every field that breaks a rule, in the order of the document, joined by commas; '' if the
    document is valid. Texts are stripped, methods in upper case, assets split by class. A null max_requests is 0,
    a null interval 1.0.
    """
    def blank(c: str):
        return F.coalesce(R.strip(F.col(c)) == "", F.lit(True))

    interval = F.coalesce("interval_seconds", F.lit(1.0))
    none = F.array().cast("array<string>")
    bad_method = F.exists(F.col("allowed_methods"), lambda m: F.coalesce(R.strip(m) == "", F.lit(True)))
    bad_asset = F.exists(F.col("assets"), lambda a: R.asset_problem(a, F.col("mode")).isNotNull())
    rules = [
        ("program", blank("program")),
        ("authorization_basis", blank("authorization_basis")),
        ("mode", ~F.coalesce(F.col("mode").isin(*R.MODES), F.lit(False))),
        ("assets", F.coalesce(F.size("assets") <= 0, F.lit(True)) | F.coalesce(bad_asset, F.lit(False))),
        ("allowed_methods", F.coalesce(F.size("allowed_methods") <= 0, F.lit(True)) | F.coalesce(bad_method, F.lit(False))),
        ("max_requests", F.coalesce(F.col("max_requests") < 0, F.lit(False))),
        ("interval_seconds", F.isnan(interval) | (interval < 0) | (interval == float("inf"))),
        ("created_at", blank("created_at")),
    ]
    stripped = F.transform("assets", R.strip)
    urls = F.filter(stripped, lambda a: R.asset_class(a) == "url")
    folders = F.filter(stripped, lambda a: R.asset_class(a) == "dir")
    return engagements.select(
        "engagement",
        F.array_join(F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in rules])), ",").alias("problems"),
        F.coalesce(F.transform("allowed_methods", lambda m: F.upper(R.strip(m))), none).alias("methods"),
        F.coalesce(urls, none).alias("url_assets"),
        F.coalesce(folders, none).alias("source_roots"),
        F.coalesce("max_requests", F.lit(0)).alias("max_requests"),
        interval.alias("interval_seconds"),
    )


def target_urls(log: DataFrame) -> DataFrame:
    """(engagement, seq, position, url): the URLs that the tasks of the log name."""
    listed = F.try_variant_get(F.try_parse_json("data_json"), "$.task.targets", "array<variant>")
    urls = F.transform(listed, lambda t: F.try_variant_get(t, "$.asset", "string"))
    return log.select("engagement", "seq", F.posexplode(urls).alias("position", "url")).filter("url is not null")


def allowed(engagements: DataFrame, targets: DataFrame) -> DataFrame:
    """POL5: (engagement, seq, position, url, allowed): whether a URL lies in any asset of its engagement.

    An equi-join on engagement and origin, so only assets that may hold a URL meet it; each URL comes out once.
    """
    a = engagements.select("engagement", F.explode("assets").alias("asset")).select("engagement", R.url(F.col("asset")).alias("a")).filter("a.reason is null")
    a = a.select("engagement", F.col("a.scheme").alias("scheme"), F.col("a.host").alias("host"), F.coalesce("a.port", F.lit(-1)).alias("port"), F.col("a.path").alias("prefix"))
    prefixes = a.groupBy("engagement", "scheme", "host", "port").agg(F.collect_set("prefix").alias("prefixes"))
    t = targets.withColumn("u", R.url(F.col("url"))).select("engagement", "seq", "position", "url", F.col("u.scheme").alias("scheme"), F.col("u.host").alias("host"), F.when(F.col("u.reason").isNull(), F.coalesce("u.port", F.lit(-1))).alias("port"), F.col("u.path").alias("path"))
    both = join_one(t, prefixes, ["engagement", "scheme", "host", "port"], "left")
    inside = F.exists("prefixes", lambda p: R.path_within(p, F.col("path")))
    return both.select("engagement", "seq", "position", "url", F.coalesce(inside, F.lit(False)).alias("allowed"))


def origins(targets: DataFrame) -> DataFrame:
    """POL4: (scheme, host, port, urls): how many URLs each origin has; port -1 where none is given."""
    u = targets.withColumn("u", R.url(F.col("url"))).filter("u.reason is null")
    return u.groupBy(F.col("u.scheme").alias("scheme"), F.col("u.host").alias("host"), F.coalesce("u.port", F.lit(-1)).alias("port")).agg(F.count(F.lit(1)).alias("urls"))
