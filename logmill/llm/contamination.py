"""Evaluation texts leaking into training text (problem 6): suffix arrays over shards of the corpus."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.text import word_runs
from logmill.plans.scratch import Scratch
from logmill.plans.skew import spread

#: Shorter runs of words are no passages.
RUN = 5
#: Words of one shard; a shard holds whole documents and ends with the one that fills it.
SHARD_WORDS = 1_048_576
#: Bytes of test text that are searched for at a time; more are searched in blocks.
BLOCK_BYTES = 64_000_000
#: With more documents to remove than this, they are not broadcast.
MOST_BROADCAST = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the RUN words from each position on, for positions with so many words left."""
    n = max(len(ids) - RUN + 1, 0)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(RUN):
            h = (h ^ ids[k : k + n].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    return h


class Tests:
    """A block of test items: their words one after another, once, and where each item begins.

    Memory grows with the items' words: per word its number, that of the gram (RUN words) that begins there, and at most one
    hash. ``gram_at`` is a place of each gram, which decides what it is: equal hashes are compared word by word.
    """

    def __init__(self, items: Iterable[tuple[int, str | None]]):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        item_ids, starts, ids = [], [0], array("i")
        for item_id, text in items:
            begin = len(ids)
            for run in word_runs(text):
                ids.extend(number(w, len(self.vocabulary) + 1) for w in run)
            if len(ids) - begin < RUN:
                del ids[begin:]
                continue
            item_ids.append(item_id)
            ids.append(0)  # no word: an item's end
            starts.append(len(ids))
        self.item_ids = np.asarray(item_ids, np.int64)
        self.starts = np.asarray(starts, np.int64)
        self.ids = np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)
        self.lengths = np.diff(self.starts) - 1
        whole = _whole(self.ids)
        hashes = _hashes(self.ids)[whole]
        self.known, first, gram = np.unique(hashes, return_index=True, return_inverse=True)
        self.gram_at = whole[first]
        self.text = np.zeros(len(self.ids), np.int32)  # the items as texts of grams, parted by 0
        self.text[whole] = gram + 1

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, numbers from 1) of the grams of a text that some item has."""
        at = _whole(ids)
        if not len(at) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        h = _hashes(ids)[at]
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[k] == h
        at, k = at[hit], k[hit]
        same = np.ones(len(at), bool)
        for j in range(RUN):
            same &= ids[at + j] == self.ids[self.gram_at[k] + j]
        return at[same], (k[same] + 1).astype(np.int32)


def _whole(ids: np.ndarray) -> np.ndarray:
    """The positions from which RUN words go on without a 0."""
    stops = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.flatnonzero(stops[RUN:] == stops[:-RUN]) if len(ids) >= RUN else np.zeros(0, np.int64)


class SuffixArray:
    """All suffixes of a text of numbers in order, by doubling of ranks.

    0 parts texts and equals nothing, not even another 0, so no common prefix reaches over it. ``ranks[k][i]`` numbers
    the runs of 2^k numbers by their place in order; they give the longest common prefix of two suffixes in as many
    steps as there are ranks. These end where all suffixes differ: memory and time grow with the text and the
    logarithm of its longest repeat.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank = np.unique(np.where(text == 0, np.arange(n), text.astype(np.int64) + n), return_inverse=True)[1].astype(np.int32)
        self.ranks, step = [rank], 1
        while n and int(rank.max()) + 1 < n:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:]
            rank = np.unique(rank * np.int64(n) + after, return_inverse=True)[1].astype(np.int32)
            self.ranks.append(rank)
            step *= 2
        self.rank = rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lengths of the longest common prefixes of pairs of different suffixes."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[k][a] == self.ranks[k][b]
            for x in (out, a, b):
                x[same] += 1 << k
        return out


def _runs(at: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams at ascending positions as a text in which a 0 follows each run, and the position of each (-1 for a 0)."""
    ends = np.append(np.flatnonzero(np.diff(at) != 1) + 1, len(at))
    return np.insert(grams, ends, 0), np.insert(at, ends, -1)


def search(doc_ids: list[int], starts: list[int], ids: np.ndarray, tests: Tests, least: float = 0.0) -> Iterator[np.ndarray]:
    """Rows of (doc_id, item_id, item_words, covered_words, longest_run, at_word) of one shard, in arrays.

    ``ids``: the shard's words, a 0 for a word that no item has and after each document, ``starts`` where documents begin.
    covered_words counts the item's words that stand in the document in runs of RUN or more; longest_run is the
    longest verbatim match, at_word the document's word at which it begins (of several such places the first in
    suffix order). Rows with less than the share ``least`` of the item covered are left out.

    A match of RUN + k words is one of k + 1 grams, so the arrays are built over grams that both sides have: the
    documents' and the items' suffixes stand in one order, and each item suffix is searched among those of each
    document that has its first gram. The longest match of the two is with a neighbour in that order.
    """
    at, gram = tests.grams(ids)
    if not len(at):
        return
    present = np.zeros(len(tests.known) + 1, bool)
    present[gram] = True
    p = np.flatnonzero(present[tests.text])
    text, t_at = _runs(at, gram)
    item_text, p_at = _runs(p, tests.text[p])
    array = SuffixArray(np.concatenate([text, item_text]))
    n = len(array.rank)
    # The documents' suffixes by document and rank.
    t = np.flatnonzero(t_at >= 0)
    t_doc = np.searchsorted(starts, t_at[t], side="right") - 1
    order = np.argsort(t_doc * n + array.rank[t])
    t, t_doc = t[order], t_doc[order]
    t_key = t_doc * n + array.rank[t]
    # The items' suffixes by gram.
    q = np.flatnonzero(p_at >= 0)
    q = q[np.argsort(item_text[q], kind="stable")]
    first = np.searchsorted(item_text[q], np.arange(len(tests.known) + 2))
    pairs = np.unique(t_doc * np.int64(len(tests.known) + 1) + text[t])
    doc, g = np.divmod(pairs, len(tests.known) + 1)
    many = (first[g + 1] - first[g]).astype(np.int64)
    for a, b in _parts(doc, many):
        count = many[a:b]
        d = np.repeat(doc[a:b], count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[g[a:b]], count)
        s = q[k]
        order = np.argsort(d * np.int64(len(tests.ids)) + p_at[s])
        d, s = d[order], s[order]
        where = p_at[s]
        item = np.searchsorted(tests.starts, where, side="right") - 1
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (item[1:] != item[:-1])]))
        gap = np.full(len(where), RUN)
        gap[:-1] = np.minimum(where[1:] - where[:-1], RUN)
        gap[new[1:] - 1] = RUN
        covered = np.add.reduceat(gap, new)
        keep = covered >= least * tests.lengths[item[new]]
        kept = np.repeat(keep, np.diff(np.append(new, len(where))))
        if not keep.any():
            continue
        d, s, item, new, covered = d[kept], s[kept], item[kept], new[keep], covered[keep]
        # The neighbours of each item suffix among the suffixes of its document.
        key = d * n + array.rank[len(text) + s]
        at_key = np.searchsorted(t_key, key)
        best, place = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        for side in (at_key - 1, at_key):
            near = np.clip(side, 0, len(t) - 1)
            ok = (side >= 0) & (side < len(t)) & (t_doc[near] == d)
            length = np.zeros(len(s), np.int64)
            length[ok] = array.common(t[near[ok]], len(text) + s[ok])
            better = (length > best) | ((length == best) & (t_at[t[near]] < place))
            best, place = np.where(better, length, best), np.where(better, t_at[t[near]], place)
        group = np.repeat(np.arange(len(covered)), np.diff(np.append(np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (item[1:] != item[:-1])])), len(d))))
        top = np.lexsort((place, -best, group))
        top = top[np.searchsorted(group[top], np.arange(len(covered)))]
        d, item = d[top], item[top]
        yield np.stack([np.asarray(doc_ids, np.int64)[d], tests.item_ids[item], tests.lengths[item], covered, best[top] + RUN - 1, place[top] - np.asarray(starts, np.int64)[d]])


#: Item suffixes that are looked at together; the documents are taken in parts of about so many.
MOST_HITS = 4_000_000


def _parts(doc: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with about MOST_HITS hits each."""
    ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1
    total, a, done = np.cumsum(many), 0, 0
    for b in ends.tolist():
        if total[b - 1] - done >= MOST_HITS or b == len(doc):
            yield a, b
            a, done = b, total[b - 1]


NAMES = ["doc_id", "item_id", "item_words", "covered_words", "longest_run", "at_word"]
SCHEMA = ", ".join(f"{c} bigint" for c in NAMES)


def matches(documents: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, least: float = 0.0) -> DataFrame:
    """One row for each document and item that share a passage of RUN or more words; columns of ``search``.

    With ``least``, only pairs with that share of the item's words in the document. Whole documents are read once for
    each block of test items (64 MB of text, more than usual test suites have together), and nothing but the matches is shuffled. The
    items, a stated query set, are read to the driver block by block; the blocks are sent to the executors, never
    the corpus.

    Null and blank texts and items of fewer than RUN words match nothing. A repeated doc_id or item_id gives one
    row, its best; documents without doc_id are left out. Documents and items of any length stay whole.
    """
    spark = documents.sparkSession
    held = items.select("item_id", "text").filter("item_id is not null and text is not null")
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = None
    for b in range(blocks):
        part = held.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text")
        found = _search_block(documents, Tests((r["item_id"], r["text"]) for r in part.toLocalIterator()), least, spark)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("covered_words", "longest_run", "item_words", F.negative("at_word").alias("at"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.item_words", "m.covered_words", "m.longest_run", F.negative("m.at").alias("at_word"))


def _search_block(documents: DataFrame, tests: Tests, least: float, spark) -> DataFrame:
    shared = spark.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        if not len(tests.known):
            return
        get = tests.vocabulary.get
        shard = Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, (np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)) for ws in word_runs(text.as_py())))
                if shard.size >= SHARD_WORDS:
                    yield from shard.found(tests, least)
                    shard = Shard()
        yield from shard.found(tests, least)

    held = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return spread(held, "doc_id").mapInArrow(run, SCHEMA)


class Shard:
    """Whole documents, as the numbers of their words."""

    def __init__(self):
        self.doc_ids, self.starts, self.parts, self.size = [], [], [], 0

    def add(self, doc_id: int, parts: Iterable[np.ndarray]) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.size)
        for p in (*parts, np.zeros(1, np.int32)):
            self.parts.append(p)
            self.size += len(p)

    def found(self, tests: Tests, least: float) -> Iterator[pa.RecordBatch]:
        if self.doc_ids:
            for rows in search(self.doc_ids, self.starts, np.concatenate(self.parts), tests, least):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=NAMES)


def leaks(found: DataFrame) -> DataFrame:
    """The matches where at least half of the item's words stand in the document."""
    return found.filter("2 * covered_words >= item_words")


def clean(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no leaked item, with all their columns; documents without doc_id stay.

    The ids to remove are stored and counted. Up to two million of them (32 MB) are sent to the documents, which then
    stay where they are; beyond that both sides are joined by doc_id.
    """
    gone = Scratch(documents.sparkSession, "clean").write(leaks(found).select("doc_id").distinct(), "gone")
    return documents.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, "doc_id", "left_anti")


def leak_report(items: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, suite, documents, longest_run) of every test item; 0 documents where it did not leak."""
    per = leaks(found).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("longest_run").alias("longest_run"))
    return items.groupBy("item_id").agg(F.min("suite").alias("suite")).join(per, "item_id", "left").select("item_id", "suite", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "longest_run")])
