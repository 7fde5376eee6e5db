"""Keyword-stuffed and link-list pages (problem 8).

A page is cut into segments: lines, and the sentences of long lines. Content and link features of each segment go to
bagged trees, which were trained on weak labels, i.e. on the segments that simple rules are sure about. Features and
rules look at form alone (repetition, separators, links, marks, ends of sentences), so no language is known or unknown
to them. The share of a page's words in segments that look like spam is then smoothed by the spam rate of its host.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.llm.text import plain
from logmill.llm.trees import BaggedTrees
from logmill.plans.scratch import Scratch
from logmill.plans.skew import join_one, spread

#: Documents whose segments are weakly labelled for training, and segments trained on, at most.
SAMPLE_DOCUMENTS = 10_000
SAMPLE_SEGMENTS = 30_000
#: No group of segments with the same rules has more than this part of the sample.
GROUPS = 16
#: Trees, and how far they grow; the share of features open to each.
TREES, DEPTH, OPEN = 21, 12, 0.6
#: A host moves a page by at most this many log odds, so that its own words decide unless they are near one half.
HOST_MOST = 2.0
#: Buckets that words are hashed into to learn which of them lean to spam.
BUCKETS = 1_048_576
#: Characters of the texts that are looked at together, at least one text.
PACK_CHARS = 1_000_000

_URL = re.compile(r"(?:https?://|www\.)[^\s\])>|\"']+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}\b(?:/[^\s\])>|\"']*)?", re.I)
_DOTTED = re.compile(r"\.\w")
_ANCHOR = re.compile(r"<a\b[^<>]*?href\s*=\s*[\"']?([^\"'\s>]+)[^<>]*>(.*?)</a\s*>", re.I | re.S)
_ITEM = re.compile(r"<li\b[^<>]*>", re.I)
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*>")
_TAG = re.compile(r"\[tag:[^\]]*\]|(?:^|\s)#\w[\w-]*|•", re.I)
_TIME = re.compile(r"\W{0,5}(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d)")
_SENTENCE = re.compile(r"[.!?。！？](?:(?<=[^\W\d_].)|(?<=[!?。！？]))[\"')\]]*\s+")
# Scripts without spaces between words: each character counts as one.
_WORD = re.compile(r"[^\W_\u3040-\u30ff\u3400-\u9fff]+(?:-[^\W_\u3040-\u30ff\u3400-\u9fff]+)*|[\u3040-\u30ff\u3400-\u9fff]|\n")
_MARKS = re.compile(r"[\[#•]")

# Classes of characters.
_DIGIT, _SIGN, _PART, _LOOSE, _SPACE, _LETTER = 1, 2, 4, 8, 16, 32
_CLASS = np.zeros(0x3000, np.uint8)
for _chars, _class in (("0123456789", _DIGIT), ("(){}[]=_<>$@\\&", _SIGN), (",;|*·•، ，、；", _PART), ("/>-–—:", _LOOSE), (" \t\n\r\u00a0", _SPACE)):
    for _c in _chars:
        if ord(_c) < len(_CLASS) and not (_class == _PART and _c == " "):
            _CLASS[ord(_c)] = _class
for _k in range(len(_CLASS)):
    if not _CLASS[_k] and chr(_k).isalpha():
        _CLASS[_k] = _LETTER
_ENDS = frozenset(".!?…。！？؟।:")
_CLOSERS = "\"')]}»”’*_ \t"

FEATURES = (
    "words tokens distinct top_word top_bigram repeated_share heavy_share common_share twice_share stuffed_share url_share words_per_url separators item_words "
    "ends tag_share digits signs time indent table head around_again around_twice around_short short page_short page_brief page_distinct page_top around_stuffed around_signs page_urls lean"
).split()
AT = {name: k for k, name in enumerate(FEATURES)}


class Pack:
    """The segments of some pages, in arrays: text, page, whitespace tokens, links and marks of each."""

    def __init__(self, texts: list[str]):
        self.pages = len(texts)
        self.text: list[str] = []
        self.page: list[int] = []
        self.tokens: list[int] = []
        self.urls: list[int] = []
        self.tags: list[int] = []
        self.indent: list[bool] = []
        for k, text in enumerate(texts):
            self._cut(k, text)

    def _cut(self, k: int, text: str) -> None:
        """Every token of the text in exactly one segment, except lines that hold nothing but tags."""
        text = plain(text)
        if "<" in text:
            text = _ANCHOR.sub(lambda m: f"[{m[2]}]({m[1]})", text)
            text = _TAGS.sub(" ", _ITEM.sub(" • ", text))
        dotted = bool(_DOTTED.search(text))
        marked = bool(_MARKS.search(text))
        for line in text.split("\n"):
            parts = _sentences(line) if len(line) > 40 else (line,)
            indent = line.startswith(("    ", "\t"))
            for p in parts:
                tokens = len(p.split()) if "•" not in p else sum(1 for t in p.split() if t.strip("•"))
                if not tokens:
                    continue
                urls = 0
                if dotted and _DOTTED.search(p):
                    whole = p
                    p, urls = _URL.subn(" ", p)
                    if not urls:
                        p = whole
                self.text.append(p)
                self.page.append(k)
                self.tokens.append(tokens)
                self.urls.append(urls)
                self.tags.append(len(_TAG.findall(p)) if marked and _MARKS.search(p) else 0)
                self.indent.append(indent)

    def features(self) -> np.ndarray:
        """One row a segment, columns as in FEATURES: its own words, links and separators, and those of the page.

        The last column, which takes a learned weight of each word, is left to ``lean``.
        """
        n = len(self.text)
        x = np.zeros((n, len(FEATURES)), np.float32)
        if not n:
            self.word, self.segment, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), []
            return x
        page, tokens = np.asarray(self.page), np.asarray(self.tokens, np.float64)
        pages = int(page[-1]) + 1
        whole = "\n".join(t.replace("\n", " ") for t in self.text) + "\n"
        ids: dict[str, int] = _Numbers()
        code = np.fromiter(map(ids.__getitem__, _WORD.findall(whole.lower())), np.int64)
        stop = code == 0  # the line feeds
        segment = np.cumsum(stop) - stop
        word, segment = code[~stop], segment[~stop]
        self.word, self.segment, self.letters = word, segment, list(ids)
        m = np.bincount(segment, minlength=n).astype(np.float64)
        some = np.maximum(m, 1)

        # Words and pairs of neighbours, counted in their segment and on their page.
        seg_word, count = np.unique(segment * len(ids) + word, return_counts=True)
        own = seg_word // len(ids)
        x[:, AT["distinct"]] = np.bincount(own, minlength=n) / some
        x[:, AT["top_word"]] = _most(own, count, n) / some
        page_word = np.unique(page[segment] * len(ids) + word) // len(ids)
        page_words = np.bincount(page[segment], minlength=pages)
        x[:, AT["page_distinct"]] = (np.bincount(page_word, minlength=pages) / np.maximum(page_words, 1))[page]
        side = np.flatnonzero(segment[1:] == segment[:-1])
        pair_seg = segment[side]
        _, pair = np.unique(word[side] * len(ids) + word[side + 1], return_inverse=True)
        kinds = int(pair.max()) + 1 if len(pair) else 1
        _, at, in_seg = np.unique(pair_seg * kinds + pair, return_inverse=True, return_counts=True)
        in_seg = in_seg[at]
        key, at, in_page = np.unique(page[pair_seg] * kinds + pair, return_inverse=True, return_counts=True)
        x[:, AT["page_top"]] = (2 * _most(key // kinds, in_page, pages) / np.maximum(page_words, 1))[page]
        n_pairs = np.maximum(np.bincount(pair_seg, minlength=n), 1)

        def share(held: np.ndarray) -> np.ndarray:
            return np.bincount(pair_seg, held, minlength=n) / n_pairs

        x[:, AT["top_bigram"]] = np.maximum(_most(pair_seg, in_seg, n), 1)
        x[:, AT["repeated_share"]] = share(in_seg > 1)
        dense = (in_seg >= 3) & (in_seg * 8 >= m[pair_seg])
        x[:, AT["heavy_share"]] = share(dense)
        x[:, AT["common_share"]] = share(in_page[at] >= in_seg + 3)
        x[:, AT["twice_share"]] = share(in_page[at] > in_seg)
        stuffed = np.zeros(len(key), bool)
        stuffed[at[dense]] = True
        x[:, AT["stuffed_share"]] = np.minimum(1, 2 * np.bincount(pair_seg, stuffed[at], minlength=n) / some)

        # Characters by class.
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _CLASS[np.minimum(chars, len(_CLASS) - 1)]
        ends = np.flatnonzero(chars == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        length = np.maximum(ends - starts, 1).astype(np.float64)
        space = kind == _SPACE
        bullet = np.zeros(len(chars), bool)  # a bullet before a segment parts nothing
        bullet[starts] = True
        loose = (kind == _LOOSE) & ~bullet & (np.concatenate([[True], space[:-1]]) & np.concatenate([space[1:], [True]]))
        seps = _sums(loose | ((kind == _PART) & ~bullet), starts)
        # Thousands and decimals are no lists.
        between = (kind == _PART) & np.concatenate([[False], kind[:-1] == _DIGIT]) & np.concatenate([kind[1:] == _DIGIT, [False]])
        seps = seps - _sums(between, starts)
        x[:, AT["digits"]] = _sums(kind == _DIGIT, starts) / length
        x[:, AT["signs"]] = _sums(kind == _SIGN, starts) / length
        letters = _sums((kind == _LETTER) | (chars >= len(_CLASS)), starts)

        urls = np.asarray(self.urls, np.float64)
        x[:, AT["words"]], x[:, AT["tokens"]] = m, tokens
        x[:, AT["url_share"]] = urls / tokens
        x[:, AT["words_per_url"]] = np.where(urls > 0, m / np.maximum(urls, 1), 99)
        x[:, AT["separators"]] = seps / some
        x[:, AT["item_words"]] = m / (seps + 1)
        bare = [t.rstrip(_CLOSERS) for t in self.text]
        x[:, AT["ends"]] = [b[-1:] in _ENDS and b != "" for b in bare]
        x[:, AT["tag_share"]] = np.asarray(self.tags) / tokens
        x[:, AT["time"]] = [_TIME.match(t) is not None for t in self.text]
        x[:, AT["indent"]] = self.indent
        x[:, AT["table"]] = [t.lstrip()[:1] == "|" and b[-1:] == "|" for t, b in zip(self.text, bare)]
        x[:, AT["head"]] = [t.lstrip()[:1] == "#" and t.lstrip(" #")[:1] != "" and "# " in t for t in self.text]
        x[:, AT["head"]] *= m <= 12

        # The page around a segment: short bare phrases, stuffed neighbours, links.
        short = (m <= 5) & (letters <= 60) & (x[:, AT["ends"]] == 0) & (x[:, AT["time"]] == 0) & (x[:, AT["table"]] == 0) & (x[:, AT["head"]] == 0)
        x[:, AT["short"]] = short
        x[:, AT["around_short"]] = _around(short, page, 3)
        x[:, AT["around_stuffed"]] = _around((x[:, AT["stuffed_share"]] > 0.3) | (x[:, AT["heavy_share"]] > 0.3), page, 2)
        x[:, AT["around_again"]] = _around((m <= 5) & (x[:, AT["common_share"]] >= 0.4), page, 3)
        x[:, AT["around_twice"]] = _around((m <= 5) & (x[:, AT["twice_share"]] >= 0.4), page, 3)
        x[:, AT["around_signs"]] = _around(x[:, AT["signs"]] >= 0.04, page, 2)
        total = np.bincount(page, tokens, minlength=pages)
        x[:, AT["page_short"]] = (np.bincount(page, tokens * short, minlength=pages) / np.maximum(total, 1))[page]
        x[:, AT["page_brief"]] = (np.bincount(page, tokens * (m <= 5), minlength=pages) / np.maximum(total, 1))[page]
        x[:, AT["page_urls"]] = (np.bincount(page, urls, minlength=pages) / np.maximum(total, 1))[page]
        return x


    def buckets(self) -> np.ndarray:
        """The bucket of each word, in the order of ``segment``."""
        return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in self.letters), np.int32, len(self.letters))[self.word]

    def lean(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """``features`` with the mean weight of each segment's words."""
        if len(x):
            own = np.bincount(self.segment, weight[self.buckets()], minlength=len(x))
            x[:, AT["lean"]] = own / np.maximum(x[:, AT["words"]], 1)
        return x


def _sentences(line: str) -> list[str]:
    out, at = [], 0
    for m in _SENTENCE.finditer(line):
        out.append(line[at : m.end()])
        at = m.end()
    out.append(line[at:])
    return out


class _Numbers(dict):
    """Numbers of words in order of appearance; the line feed has 0."""

    def __init__(self):
        super().__init__({"\n": 0})

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _most(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The greatest value of each of ``n`` groups, whose numbers ascend; 0 where there is none."""
    out = np.zeros(n)
    if len(group):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[first]] = np.maximum.reduceat(values, first)
    return out


def _sums(held: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(held.astype(np.int32), starts).astype(np.float64)


def _around(held: np.ndarray, page: np.ndarray, reach: int) -> np.ndarray:
    """How many segments of the same page within ``reach`` of each hold, itself included."""
    out = held.astype(np.float64)
    for k in range(1, reach + 1):
        same = page[k:] == page[:-k]
        out[k:] += held[:-k] & same
        out[:-k] += held[k:] & same
    return out


def rules(x: np.ndarray) -> np.ndarray:
    """Which of the simple rules hold: sentence, alone, a line of logs, code or tables; and for spam: listed, phrases,
    links, dressed as sentences, crammed with few words, tags. They label segments for training; the trees see the features only."""
    c = {name: x[:, k] for k, name in enumerate(FEATURES)}
    linked = (c["url_share"] >= 0.15) & (c["words_per_url"] <= 6)
    tagged = c["tag_share"] >= 0.3
    coded = (c["signs"] >= 0.04) & ((c["indent"] > 0) | (c["digits"] + c["signs"] >= 0.08)) & (c["item_words"] >= 1.5)
    coded |= (c["indent"] > 0) & (c["around_signs"] >= 1) & (c["url_share"] == 0)
    plain_line = ((c["time"] > 0) | (c["table"] > 0) | (c["head"] > 0) | coded) & ~linked & ~tagged & (c["top_bigram"] <= 2)
    dressed = ((c["heavy_share"] >= 0.2) | (c["stuffed_share"] >= 0.4)) & ~plain_line
    bare = (c["words"] >= 8) & (c["separators"] < 0.2) & (c["ends"] == 0) & ~plain_line
    crammed = bare & ((c["distinct"] <= 0.6) & (c["words"] <= 60) | (c["top_word"] >= 0.25))
    listed = (c["words"] >= 6) & (c["item_words"] <= 3.5) & (c["separators"] >= 0.2) & (c["ends"] == 0) & ~plain_line
    again = (c["words"] <= 5) & ((c["around_again"] >= 4) | (c["around_twice"] >= 3) & (c["page_brief"] >= 0.8))
    phrases = ((c["short"] > 0) & (c["around_short"] >= 4) | again) & ~plain_line
    calm = (c["top_bigram"] <= 2) & (c["stuffed_share"] < 0.2) & (c["around_stuffed"] <= 1) & (c["url_share"] < 0.15)
    sentence = (c["words"] >= 6) & (c["item_words"] >= 4) & (c["ends"] > 0) & calm & ~tagged
    sentence |= (c["words"] >= 10) & (c["item_words"] >= 6) & ((c["distinct"] >= 0.7) | (c["words"] >= 40) & (c["distinct"] >= 0.5)) & (c["top_word"] < 0.2) & calm & (c["common_share"] < 0.3) & ~tagged
    alone = (c["words"] <= 5) & (c["around_short"] <= 2) & (c["around_again"] <= 2) & (c["page_brief"] < 0.5) & (c["page_short"] < 0.3) & (c["page_urls"] < 0.1) & ~linked & ~tagged & (c["stuffed_share"] == 0)
    held = np.stack([sentence, alone, plain_line, listed, phrases, linked, dressed, crammed, tagged])
    return held.T.astype(bool)


def weak_labels(rules: np.ndarray) -> np.ndarray:
    """1 where a rule for spam holds and none against it, 0 the other way round, -1 where no rule or both sorts hold."""
    spam, ham = rules[:, 3:].any(1), rules[:, :3].any(1)
    return np.where(spam & ~ham, 1, np.where(ham & ~spam, 0, -1))


def word_weights(words: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How much more often each bucket's words stand in spam than elsewhere, as log odds, near 0 for rare and new ones."""
    spam, ham = (np.bincount(words[label == v], minlength=BUCKETS).astype(np.float64) for v in (1, 0))
    rates = np.log((spam + 0.5) / max(spam.sum(), 1)) - np.log((ham + 0.5) / max(ham.sum(), 1))
    seen = spam + ham
    return np.clip(rates * seen / (seen + 10), -4, 4)


class Model:
    """What is learned: the weights of words, and trees that see the features only."""

    def __init__(self, x: np.ndarray, y: np.ndarray, group: np.ndarray, half: np.ndarray, words: list[np.ndarray], seed: int = 3):
        """``words``: the buckets of each segment's words; ``half`` is 0 or 1, alike for the segments of a document.

        A training segment's words are weighed by the other half of the documents, so that the trees learn how far a
        weight can be trusted. Half of the rows have noise for weights: words that the sample does not have, and so
        whole languages, must be judged by form.
        """
        many = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.concatenate([*words, np.zeros(0, np.int32)]).astype(np.int64)
        of, page = np.repeat(np.arange(len(words)), many), np.repeat(half, many)
        self.weight = word_weights(flat, y[of]).astype(np.float32)
        crossed = [word_weights(flat[page != h], y[of][page != h]) for h in (0, 1)]
        own = np.where(page == 0, crossed[0][flat], crossed[1][flat])
        x = x.astype(np.float64)
        x[:, AT["lean"]] = np.bincount(of, own, minlength=len(words)) / np.maximum(many, 1)
        blind = x.copy()
        blind[:, AT["lean"]] = np.random.default_rng(seed).normal(0, 0.4, len(x))
        both = np.concatenate([group, group + 1 + (group.max() if len(group) else 0)])
        self.trees = BaggedTrees(np.concatenate([x, blind]), np.concatenate([y, y]), both, trees=TREES, depth=DEPTH, share=OPEN)

    def spam(self, pack: Pack) -> np.ndarray:
        """The score of each segment, from 0 to 1."""
        return self.trees.predict(pack.lean(pack.features(), self.weight))


def _packs(texts: pa.Array) -> Iterator[tuple[int, Pack]]:
    """The texts in packs of about PACK_CHARS characters, each with the number of its first text."""
    held: list[str] = []
    at = size = 0
    for k, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= PACK_CHARS:
            yield at, Pack(held)
            held, at, size = [], k + 1, 0
    if held:
        yield at, Pack(held)


def _scored(documents: DataFrame, model: Model) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, pack in _packs(batch.column(2)):
                n = pack.pages
                page, tokens = np.asarray(pack.page, np.int64), np.asarray(pack.tokens, np.float64)
                bad = tokens * (shared.value.spam(pack) > 0.5)
                sums = [np.bincount(page, w, minlength=n) for w in (tokens, bad, np.ones(len(page)))]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, n).columns[:2], *[pa.array(v) for v in sums]], names=["doc_id", "host", "words", "spam_words", "segments"])

    held = documents.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).select("doc_id", F.coalesce("engagement", F.lit("")).alias("host"), "text")
    return spread(held, "doc_id").mapInArrow(run, "doc_id bigint, host string, words double, spam_words double, segments double")


def train(documents: DataFrame, seed: int = 5, sample_documents: int = SAMPLE_DOCUMENTS, sample_segments: int = SAMPLE_SEGMENTS) -> Model:
    """Word weights and trees from weak labels of at most ``sample_segments`` segments of about ``sample_documents``
    documents.

    The sample is taken by a hash of doc_id, so it is the same on every run. This is the only bounded step; all
    documents are scored.
    """
    held = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    total = held.count()
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_documents / max(total, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, pack in _packs(batch.column(1)):
                x = pack.features()
                hold = rules(x)
                y = weak_labels(hold)
                keep = np.flatnonzero(y >= 0)
                if not len(keep):
                    continue
                page = np.asarray(pack.page, np.int64)
                number = np.arange(len(page)) - np.searchsorted(page, page)
                buckets = pack.buckets()
                ends = np.searchsorted(pack.segment, np.arange(len(page) + 1))
                words = [buckets[ends[k] : ends[k + 1]] for k in keep.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + page[keep]], pa.int64()), *[pa.array(v[keep], pa.int64()) for v in (number, y, hold @ (1 << np.arange(hold.shape[1])))], pa.array(x[keep].tolist(), pa.list_(pa.float32())), pa.array(words, pa.list_(pa.int32()))],
                    names=["doc_id", "n", "y", "g", "x", "words"],
                )

    rows = spread(held.filter(part), "doc_id").mapInArrow(run, "doc_id bigint, n bigint, y bigint, g bigint, x array<float>, words array<int>")
    half = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2)).alias("half")
    order = [F.xxhash64(F.lit(seed), "doc_id", "n"), F.col("doc_id"), F.col("n"), F.col("y")]
    # As many of each group, so that rare ones are seen; Spark cuts each task's groups before the shuffle.
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("rank") <= max(1, sample_segments // GROUPS))
    got = some.orderBy(*order).limit(sample_segments).select("y", "g", half, "x", "words").toArrow()
    y, g, halves = (got.column(c).to_numpy() for c in ("y", "g", "half"))
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(len(y), len(FEATURES))
    return Model(x, y, g, halves, [np.asarray(w, np.int32) for w in got.column("words").to_pylist()])


def host_prior(pages: DataFrame) -> tuple[float, float]:
    """(rate, weight): the share of spam pages, and how many pages it counts for beside the pages of a host.

    The weight is fitted by moments: the more the rates of hosts differ beyond chance, the less it is, and the more
    a host's own pages say. One row of sums reaches the driver.
    """
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(_spam(F.col("spam_words"), F.col("words"))).cast("double").alias("k"))
    n, k = F.col("n"), F.col("k")
    r = hosts.agg(*[F.sum(c).alias(a) for c, a in ((n, "n"), (k, "k"), (k * k, "kk"), (k * n, "kn"), (n * n, "nn"))]).first()
    if not r["n"]:
        return 0.5, 1.0
    rate = min(max(r["k"] / r["n"], 1e-4), 1 - 1e-4)
    spread_ = (r["kk"] - 2 * rate * r["kn"] + rate * rate * r["nn"]) / (rate * (1 - rate))
    pairs = r["nn"] - r["n"]
    alike = min(max((spread_ - r["n"]) / pairs, 1e-6), 1.0) if pairs > 0 else 1e-6
    return rate, 1 / alike - 1


def _spam(spam: Column, words: Column) -> Column:
    return (spam * 2 > words).cast("int")


def score(documents: DataFrame, host_most: float = HOST_MOST) -> DataFrame:
    """(doc_id, host, words, spam_words, host_rate, score) of every document with a text.

    ``words`` are parted by white space. ``score`` is how sure it is that more than half of a page's words are spam:
    the log odds from its share of spam words, sharper the more segments agree, moved by the log odds of its host's
    spam rate beside the general one, by ``host_most`` at most. The rate of a host (the engagement of the crawl) is
    that of its other pages, shrunk to the general rate as ``host_prior`` finds; where hosts are alike, they move nothing.

    Null and blank texts give no row; of repeated doc_ids the row with the highest score stays; a null engagement is
    a host of its own; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "spam")
    pages = scratch.write(_scored(documents, train(documents)), "pages")
    rate, weight = host_prior(pages)
    spam = _spam(F.col("spam_words"), F.col("words"))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"), F.sum(spam).alias("host_spam"))
    own = (F.col("host_spam") - spam + F.lit(rate * weight)) / (F.col("host_pages") - 1 + F.lit(weight))
    joined = join_one(pages, hosts, ["host"]).withColumn("host_rate", F.coalesce(own, F.lit(rate)))  # a host may have any share of all pages
    share = F.col("spam_words") / F.greatest("words", F.lit(1.0))
    noise = F.sqrt(share * (1 - share) / (F.col("segments") + 1) + 0.25 / (F.col("words") + 1))
    held = F.least(F.greatest("host_rate", F.lit(1e-6)), F.lit(1 - 1e-6))
    moved = F.least(F.greatest(F.log(held / (1 - held)) - F.lit(float(np.log(rate / (1 - rate)))), F.lit(-host_most)), F.lit(host_most))
    odds = 1.702 * (share - 0.5) / noise + moved
    scored = joined.withColumn("score", 1 / (1 + F.exp(-odds)))
    best = F.max(F.struct("score", "host", "words", "spam_words", "host_rate")).alias("b")
    return scored.groupBy("doc_id").agg(best).select("doc_id", "b.host", "b.words", "b.spam_words", "b.host_rate", "b.score")


def spam_pages(scored: DataFrame) -> DataFrame:
    """Pages of which more than half of the words are spam."""
    return scored.filter("score > 0.5")
