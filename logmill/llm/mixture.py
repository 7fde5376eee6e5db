"""Mixing sources to target weights (problem 7): Sainte-Laguë quotas of equal-token blocks."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.plans.scratch import Scratch
from logmill.plans.skew import spread, text_key

#: Where the vocabularies of public tokenizers are; a parameter, as is the file's name.
TOKENIZERS = os.environ.get("LOGMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Tokens of a block, the unit of apportionment.
BLOCK_TOKENS = 256
#: Tokens of a shard: what one task orders.
SHARD_TOKENS = 50_000_000
# The word pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters encoded at a time.
PIECE = 1_000_000
# A letter or digit and then white space, or one and then another kind: the pattern begins a word at the second
# whatever follows, so counts of the parts add up to the count of the whole.
_SEAM = regex.compile(r"(?<=[\p{L}\p{N}])[ \t\n\r]|(?<=\p{L})[^\p{L}\s]|(?<=\p{N})[^\p{N}\s]")


def _pieces(text: str) -> Iterator[str]:
    """Parts of a long text that end where words end; a text without such places is one part."""
    at = 0
    while at < len(text):
        m = _SEAM.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, sources: list[str] | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document with a text; source trimmed and in lower case.

    Null and blank texts have no tokens and give no row; a null or blank source is ''. Repeated doc_ids stay. With
    ``sources``, the texts of others are not read into Python.
    """
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            counts = [sum(len(encode(p)) for p in _pieces(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source", "tokens"])

    held = documents.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).select("doc_id", F.coalesce(text_key("source"), F.lit("")).alias("source"), "text")
    if sources is not None:
        held = held.filter(F.col("source").isin(sources))
    return spread(held, "doc_id").mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), none beyond its cap; ties go to the earlier.

    The k-th seat of each has one quotient, so the quotients that win are those above a divisor: it is found by
    bisection, and the few seats at the divisor itself by their quotients. Time does not grow with the seats.
    """
    w = np.asarray(weights, float)
    cap = np.full(len(w), seats, np.int64) if caps is None else np.minimum(np.asarray(caps, np.int64), seats)
    cap = np.where(w > 0, cap, 0)
    if cap.sum() <= seats:
        return cap.tolist()

    def won(divisor: float) -> np.ndarray:
        return np.minimum(np.floor((w / divisor + 1) / 2).astype(np.int64), cap)

    low, high = 0.0, float(w.max()) * 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high) or middle <= 0:
            break
        if won(middle).sum() > seats:
            low = middle
        else:
            high = middle
    given = won(high)
    for _ in range(int(seats - given.sum())):
        quotient = np.where(given < cap, w / (2 * given + 1), -1.0)
        given[int(np.argmax(quotient))] += 1
    return given.tolist()


def plan(sizes: pd.DataFrame, targets: pd.DataFrame, total_tokens: int | None, block: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Quotas of blocks for each shard, and the shares aimed at for each source.

    ``sizes``: source, shard, tokens; ``targets``: source, target_share, max_repeats. Sources without documents
    can't contribute: their share goes to the others in proportion. Without ``total_tokens`` the mixture is as
    large as it can be with every source at its share: the least of capacity / share. With it, a source whose
    capacity ends leaves its further blocks to the next quotients.
    """
    have = sizes.groupby("source")["tokens"].sum()
    t = targets.assign(have=targets["source"].map(have).fillna(0).astype("int64"))
    t["usable"] = (t["have"] > 0) & (t["target_share"] > 0) & (t["max_repeats"] > 0)
    share = t["target_share"].where(t["usable"], 0.0)
    t["share"] = share / share.sum() if share.sum() else 0.0
    room = t["have"] * t["max_repeats"].clip(lower=0)
    if total_tokens is None:
        use = t["usable"]
        total_tokens = int((room[use] / t["share"][use]).min()) if use.any() else 0
    t["blocks"] = sainte_lague(t["share"].tolist(), total_tokens // block, (room // block).tolist())
    rows = []
    for r in t[t["usable"]].itertuples():
        shards = sizes[sizes["source"] == r.source].sort_values("shard")
        most = shards["tokens"] * r.max_repeats
        if r.blocks >= most.sum() // block:  # all there is, the last part of a block included
            quotas = most
        else:
            given = sainte_lague(shards["tokens"].astype(float).tolist(), r.blocks, (-(-most // block)).tolist())
            quotas = np.minimum(np.asarray(given) * block, most)
        rows += [(r.source, int(s), int(q), int(n)) for s, q, n in zip(shards["shard"], quotas, shards["tokens"]) if q]
    return pd.DataFrame(rows, columns=["source", "shard", "quota", "shard_tokens"]), t


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(the mixture, the shares reached).

    The mixture has one row a document that is used: (doc_id, source, tokens, shard, block, copies), copies at most
    max_repeats of its source. Shards are dealt by a hash of doc_id; within a shard documents stand in the order of
    that hash, cut into blocks of ``block`` tokens each. A document belongs to the block its middle falls in, so none
    is cut. A shard's quota takes whole rounds of all blocks, then blocks drawn in an order seeded by ``seed``, up to
    the one whose middle passes what is left of the quota. Sums stay within half a block, or half a document where
    documents are larger, of each shard's quota; mixtures of few blocks want a smaller ``block``.

    The report has a row for each source of the targets: target_share, reached_share, tokens, documents, copies,
    available_tokens. Documents of sources without a target, '' included, are left out; a null share counts as 0,
    a null max_repeats as 1, repeated target rows as the first. An empty table gives an empty mixture.

    To the driver go the targets, one row a source, and sums for each source and shard: one row for ``shard_tokens`` tokens.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixture")
    goal = targets.filter(text_key("source") != "").select(text_key("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    goals = goal.toPandas().sort_values(["source", "target_share"]).drop_duplicates("source").reset_index(drop=True)
    held = scratch.write(token_counts(documents, tokenizers, vocabulary, goals["source"].tolist()).filter("tokens > 0"), "tokens")
    sums = {r["source"]: r["n"] for r in held.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    number = F.coalesce(F.create_map(*[F.lit(x) for s, n in sums.items() for x in (s, -(-n // shard_tokens))])[F.col("source")] if sums else F.lit(1), F.lit(1))
    dealt = held.withColumn("at", F.xxhash64("doc_id")).withColumn("shard", F.pmod(F.xxhash64("at"), number).cast("int"))
    sizes = dealt.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).toPandas()
    quotas, shares = plan(sizes, goals, total_tokens, block)
    quota = spark.createDataFrame(list(quotas.itertuples(index=False, name=None)), "source string, shard int, quota bigint, shard_tokens bigint")
    # All windows keep the partitioning of the first: one shuffle of narrow rows.
    part = ["source", "shard"]
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    at_first = before.partitionBy(*part).orderBy("at", "doc_id", "tokens")
    placed = dealt.withColumn("block", F.floor((F.coalesce(F.sum("tokens").over(at_first), F.lit(0)) + F.col("tokens") / 2) / block))
    draw = placed.withColumn("draw", F.xxhash64(F.lit(seed), *part, "block"))
    drawn = draw.withColumn("passed", F.coalesce(F.sum("tokens").over(before.partitionBy(*part).orderBy("draw", "block", "at", "doc_id", "tokens")), F.lit(0)))
    own = Window.partitionBy(*part, "block")
    middle = drawn.withColumn("middle", F.min("passed").over(own) + F.sum("tokens").over(own) / 2)
    # The quotas are as few as the shards: their size is known.
    joined = middle.join(F.broadcast(quota) if len(quotas) < 1_000_000 else quota, part)
    rounds = F.floor(F.col("quota") / F.col("shard_tokens"))
    copies = rounds + (F.col("middle") <= F.col("quota") % F.col("shard_tokens")).cast("long")
    mixed = scratch.write(joined.select("doc_id", "source", "tokens", "shard", "block", copies.cast("int").alias("copies")).filter("copies > 0"), "mixed")
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"))
    aims = spark.createDataFrame([(r.source, float(r.target_share), int(r.have)) for r in shares.itertuples()], "source string, target_share double, available_tokens bigint")
    whole = Window.partitionBy()
    report = aims.join(used, "source", "left").select("source", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "copies")], "available_tokens")
    report = report.withColumn("reached_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(whole), F.lit(0)), F.lit(0.0)))
    return mixed, report
