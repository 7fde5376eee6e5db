"""Problems 1, 6, 7 and 8 beside brute force, and their edge cases."""

import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute_llm
from conftest import read
from logmill.llm import contamination as L
from logmill.llm import conversations as C
from logmill.llm import mixture as M
from logmill.llm import spam as S
from logmill.llm.queries import QUERIES
from logmill.llm.text import plain, repair, words
from logmill.llm.trees import BaggedTrees
from test_data_operators import at, frame, message

HAS_TOKENIZER = Path(f"{M.TOKENIZERS}/{M.VOCABULARY}").exists()


# --- conversations ------------------------------------------------------------------------------------------------------


def test_conversations_beside_brute_force(spark, middle):
    got = [tuple(r) for r in QUERIES["p1_found"](spark, middle).collect()]
    assert set(got) == brute_llm.conversations(read(middle, "messages")) and len(got) == len(set(got))


def pair(n, **reply):
    """An ask of a1 to a2 and its reply."""
    return [message(n, sender="a1", recipient="a2"), message(n + 1, **{"sender": "a2", "recipient": "a1", "kind": "reply", "reply_to": n, **reply})]


def kept(spark, rows):
    return {(r.root_seq, r.turn, r.seq) for r in C.conversations(frame(spark, "messages", rows)).collect()}


WHOLE = {(1, 1, 1), (1, 2, 2)}


def test_a_whole_conversation_is_kept(spark):
    assert kept(spark, pair(1)) == WHOLE
    assert kept(spark, pair(1) + [message(3, sender="a1", recipient="a2", kind=" CLOSE ", reply_to=2)]) == WHOLE | {(1, 3, 3)}
    assert kept(spark, pair(1) + [message(9, kind="event", reply_to=1, data_json="{}")]) == WHOLE
    assert kept(spark, [message(1, sender="a1", recipient="@scout"), pair(1)[1]]) == WHOLE
    assert kept(spark, pair(1) + [message(2, arrived_at=at(99), reply_to=77)]) == WHOLE
    assert kept(spark, []) == set()


@pytest.mark.parametrize(
    "change",
    [
        {"reply_to": None},
        {"reply_to": 77},
        {"reply_to": 2},
        {"engagement": "x"},
        {"sender": "a3"},
        {"recipient": "a3"},
        {"kind": "close"},
        {"data_json": None},
        {"data_json": "{"},
        {"data_json": '{"a":[{"b":" "}],"c":"[]"}'},
        {"sender": None},
        {"recipient": None},
    ],
)
def test_a_broken_conversation_is_dropped_whole(change, spark):
    assert kept(spark, pair(1, **change) + [m for m in pair(11)]) == {(11, 1, 11), (11, 2, 12)}


def test_cycles_forward_references_and_events(spark):
    cycle = [message(1, sender="a1", recipient="a2", reply_to=2), message(2, sender="a2", recipient="a1", kind="reply", reply_to=1), message(3, sender="a1", recipient="a2", kind="close", reply_to=2)]
    assert kept(spark, cycle) == set()
    assert kept(spark, pair(1) + [message(0, sender="a1", recipient="a2", kind="close", reply_to=2)]) == set()
    assert kept(spark, [message(1, kind="event"), message(2, reply_to=1)] + pair(11)) == {(11, 1, 11), (11, 2, 12)}
    assert {(r.fault, r.messages) for r in C.dropped(frame(spark, "messages", cycle)).collect()} == {("cycle", 3), ("bad_parent", 1)}


def test_messages_sent_again_are_one(spark):
    rows = [message(1, sender="a1", recipient="a2", dedup_key="k"), message(5, sender=" A1", recipient="a2", dedup_key="k"), message(6, sender="a2", recipient="a1", kind="reply", reply_to=5), message(7, sender="a9", recipient="a2", dedup_key="k")]
    assert kept(spark, rows) == {(1, 1, 1), (1, 2, 6)}


def test_a_long_and_a_wide_conversation(spark):
    rows = [message(0, sender="a1", recipient="a2")]
    rows += [message(i, sender="a2" if i % 2 else "a1", recipient="a1" if i % 2 else "a2", kind="reply", reply_to=i - 1) for i in range(1, 70)]
    rows += [message(1000 + i, sender="a2", recipient="a1", kind="reply", reply_to=0) for i in range(300)]
    got = kept(spark, rows)
    assert sorted(t for _, t, _ in got) == list(range(1, 371))
    threads = {(r.leaf_seq, r.turns) for r in C.threads(frame(spark, "messages", rows)).collect()}
    assert len(threads) == 301 and (69, 70) in threads and (1000, 2) in threads


def test_clashing_columns(spark):
    df = frame(spark, "messages", pair(1))
    for c in ("canon", "known", "root", "depth", "faults", "parent", "turn", "__salt", "__block"):
        df = df.withColumn(c, df["seq"])
    assert C.conversations(df).count() == 2
    assert [(r.turn, r.speaker, r.role) for r in C.dialogues(df, C.conversations(df)).orderBy("turn").collect()] == [(1, "a1", "scout"), (2, "a2", "scout")]


# --- text ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "written",
    [
        "Später hören wir: Ostyal's Uhr",
        "SPÄTER   HÖREN\twir – OSTYAL’S\nUhr!",
        "SpÃ¤ter hÃ¶ren wir Ostyalâ€™s Uhr",
        "Sp&auml;ter h&#246;ren wir <b>Ostyal's</b>&nbsp;Uhr",
        r'{"Später hören wir\nOstyal\'s Uhr"}',
        "Später hören wir Ostyal's Uhr",
        "Sp­äter h​ören w⁠ir Ostyal's Uhr",
        "Ｓｐäｔｅｒ ｈöｒｅｎ ｗｉｒ Ｏｓｔｙａｌ's Ｕｈｒ",
        "Sрätеr hörеn wir Ostyаl's Uhr",
        "**Später** _hören_ `wir` [Ostyal's] <br/>Uhr",
        "Sp%C3%A4ter h%C3%B6ren wir Ostyal's Uhr",
    ],
)
def test_words_however_written(written):
    assert words(written) == ["spater", "horen", "wir", "ostyals", "uhr"]


def test_plain_text_edges():
    assert words(None) == words("") == words(" \n") == []
    assert plain("a < b and c > d") == "a < b and c > d"
    assert repair("naïve Ã") == "naïve Ã" and plain("\\ud83d\\ude00") == "😀" and plain("\\ud800") == "\ud800"
    assert len(words("word " * 300_000)) == 300_000
    long = "ab cd " * 400_000 + "e" * 1_200_000 + " f"
    assert words(long)[-3:] == ["cd", "e" * 1_200_000, "f"] and len(words(long)) == 800_002


# --- contamination ------------------------------------------------------------------------------------------------------


def docs(spark, rows):
    return frame(spark, "documents", [{"doc_id": i, "text": t} for i, t in rows])


def items(spark, rows):
    return frame(spark, "eval_items", [{"item_id": i, "text": t, "suite": "s"} for i, t in rows])


def test_matches_beside_brute_force(spark, middle):
    got = {(r.doc_id, r.item_id): r for r in QUERIES["p6_matches"](spark, middle).collect()}
    held = {r["item_id"]: words(r["text"]) for r in read(middle, "eval_items")}
    grams = defaultdict(list)
    for i, w in held.items():
        for k in range(len(w) - 4):
            grams[tuple(w[k : k + 5])].append((i, k))
    want = {}
    for r in read(middle, "documents"):
        w, seen = words(r["text"]), defaultdict(set)
        for k in range(len(w) - 4):
            for i, p in grams.get(tuple(w[k : k + 5]), ()):
                seen[i] |= set(range(p, p + 5))
        want |= {(r["doc_id"], i): len(c) for i, c in seen.items()}
    assert {k: r.covered_words for k, r in got.items()} == want
    for (d, i), r in list(got.items())[:300]:
        text = next(words(x["text"]) for x in read(middle, "documents") if x["doc_id"] == d) if len(got) < 50 else None
        assert 5 <= r.longest_run <= r.covered_words <= r.item_words == len(held[i]) and text is None or text


def test_half_of_an_item_in_runs_of_five(spark):
    item = " ".join(f"w{i}" for i in range(20))
    w = item.split()
    rows = [(1, "x " + " ".join(w[:10]) + " y"), (2, " ".join(w[:9])), (3, " ".join(w[:5]) + " gap " + " ".join(w[8:13])), (4, " ".join(w[:4]) + " gap " + " ".join(w[4:8])), (5, None), (6, " "), (7, item.upper()), (8, " ".join(reversed(w)))]
    for blocks in (L.BLOCK_BYTES, 60):
        m = L.matches(docs(spark, rows + [(7, item)]), items(spark, [(1, item), (2, "too short"), (3, None), (4, "a b c d e f")]), blocks)
        assert {(r.doc_id, r.item_id) for r in L.leaks(m).collect()} == {(1, 1), (3, 1), (7, 1)}
        best = {r.doc_id: (r.covered_words, r.longest_run, r.at_word) for r in m.collect()}
        assert best[1] == (10, 10, 1) and best[2] == (9, 9, 0) and best[3][:2] == (10, 5) and best[7] == (20, 20, 0)
    assert {r.doc_id for r in L.clean(docs(spark, rows), m).collect()} == {2, 4, 5, 6, 8}
    assert {(r.item_id, r.documents, r.longest_run) for r in L.leak_report(items(spark, [(1, item), (4, "a b c d e f")]), m).collect()} == {(1, 3, 20), (4, 0, 0)}
    assert L.matches(docs(spark, []), items(spark, [(1, item)])).count() == 0
    assert L.matches(docs(spark, rows), items(spark, [])).count() == 0


def test_shards_hold_whole_documents(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    monkeypatch.setattr(L, "SHARD_WORDS", 50)
    got = L.matches(docs(spark, [(i, f"{'pad ' * (i % 7)}{item}") for i in range(40)] + [(99, "pad " * 200_000 + item)]), items(spark, [(1, item)]))
    assert got.filter("longest_run = 30").count() == 41


def in_shard(documents, test_items, least=0.0):
    tests, shard = L.Tests(test_items), L.Shard()
    for i, t in documents:
        shard.add(i, [np.array([tests.vocabulary.get(w, 0) for w in words(t)], np.int32)])
    return [r for b in shard.found(tests, least) for r in zip(*[c.to_pylist() for c in b.columns])]


def test_suffix_array_orders_suffixes_and_finds_longest_prefixes():
    rng = np.random.default_rng(4)
    for _ in range(60):
        text = np.append(rng.integers(0, rng.integers(2, 5), rng.integers(1, 40)), 0)
        array, n = L.SuffixArray(text), len(text)
        suffix = [tuple((0, i + k) if v == 0 else (1, v) for k, v in enumerate(text[i:].tolist())) for i in range(n)]
        assert np.argsort(array.rank).tolist() == sorted(range(n), key=suffix.__getitem__)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        a, b = a[a != b], b[a != b]
        want = [next(k for k, (x, y) in enumerate(zip(suffix[i], suffix[j])) if x != y) for i, j in zip(a, b)]
        assert array.common(a, b).tolist() == want


@pytest.mark.parametrize("most_hits", [1, 12, 4_000_000])
def test_shards_beside_brute_force(most_hits, monkeypatch):
    monkeypatch.setattr(L, "MOST_HITS", most_hits)
    rng = np.random.default_rng(most_hits)

    def text(n, kinds):
        return " ".join(rng.choice(list("abcdefz")[:kinds], n))

    for _ in range(60):
        kinds = int(rng.integers(1, 7))
        documents = [(i, text(int(rng.integers(0, 40)), kinds)) for i in range(int(rng.integers(1, 6)))]
        held = [(i, text(int(rng.integers(0, 25)), kinds)) for i in range(int(rng.integers(1, 5)))]
        assert {(r[0], r[1]): r[2:5] for r in in_shard(documents, held)} == brute_llm.shared_passages(documents, held)
        for d, i, n, covered, longest, at_word in in_shard(documents, held, 0.5):
            run, item = words(dict(documents)[d])[at_word : at_word + longest], words(dict(held)[i])
            assert 2 * covered >= n and any(item[k : k + longest] == run for k in range(len(item)))


def test_long_items_and_texts_of_one_word_stay_small():
    import tracemalloc

    long = " ".join(str(k % 977) + str(k % 991) for k in range(100_000))
    tracemalloc.start()
    assert in_shard([(1, long), (2, "x " + " ".join(long.split()[500:900]))], [(1, long)]) == [(1, 1, 100_000, 100_000, 100_000, 0), (2, 1, 100_000, 400, 400, 1)]
    assert [r[:5] for r in in_shard([(1, "same " * 300_000)], [(1, "same " * 100_000), (2, "same same same same same other")])] == [(1, 1, 100_000, 100_000, 100_000), (1, 2, 6, 5, 5)]
    assert tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()
    assert not in_shard([(1, "")], [(1, "a b c d e")]) and not in_shard([(1, "a b c d e")], [])


# --- mixture ------------------------------------------------------------------------------------------------------------


def by_quotients(weights, seats, caps):
    given = [0] * len(weights)
    for _ in range(seats):
        best = max((i for i in range(len(weights)) if given[i] < caps[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * given[i] + 1), -i), default=None)
        if best is None:
            break
        given[best] += 1
    return given


def test_apportionment_beside_one_seat_at_a_time():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 8))
        w = [float(x) for x in rng.choice([0.0, 0.1, 0.25, 1.0, 1.0, 3.7], n)] if rng.random() < 0.5 else rng.random(n).tolist()
        seats, caps = int(rng.integers(0, 60)), rng.integers(0, 30, n).tolist()
        assert M.sainte_lague(w, seats, caps) == by_quotients(w, seats, caps)
    assert M.sainte_lague([1.0, 1.0], 10**12) == [5 * 10**11] * 2 and M.sainte_lague([], 3) == []


@pytest.mark.skipif(not HAS_TOKENIZER, reason="no tokenizer")
def test_shares_are_reached_and_caps_kept(spark, middle):
    mixed, report = (df.collect() for df in M.mixture(spark.read.parquet(f"{middle}/documents.parquet"), spark.read.parquet(f"{middle}/mix_targets.parquet")))
    caps = {r["source"]: r["max_repeats"] for r in read(middle, "mix_targets")}
    assert all(1 <= r.copies <= caps[r.source] for r in mixed) and len({r.doc_id for r in mixed}) == len(mixed)
    usable = [r for r in report if r.available_tokens]
    whole = sum(r.target_share for r in usable)
    assert all(abs(r.reached_share - r.target_share / whole) < 0.02 for r in usable)
    for r in report:
        assert r.tokens == sum(m.tokens * m.copies for m in mixed if m.source == r.source)
    assert sum(r.reached_share for r in report) == pytest.approx(1)


@pytest.mark.skipif(not HAS_TOKENIZER, reason="no tokenizer")
def test_mixture_edges(spark):
    goal = spark.createDataFrame([("a", 0.5, 3), (" B ", 0.5, None), ("none", None, 2), (None, 0.3, 1), ("b", 0.5, 9)], "source string, target_share double, max_repeats int")
    rows = [{"doc_id": i, "text": "one two three four five", "source": "A " if i < 5 else "b"} for i in range(30)] + [{"doc_id": 90, "text": None, "source": "a"}, {"doc_id": 91, "text": "  ", "source": "a"}, {"doc_id": 92, "text": "x", "source": None}, {"doc_id": None, "text": "x", "source": "a"}]
    mixed, report = M.mixture(frame(spark, "documents", rows), goal, block=5)
    got = {r.source: r for r in report.collect()}
    assert got["a"].copies == got["b"].copies == 15 and got["a"].documents == 5 and got["none"].tokens == 0
    assert {r.copies for r in mixed.filter("source = 'a'").collect()} == {3}
    many, _ = M.mixture(frame(spark, "documents", rows), goal, total_tokens=10**6, shard_tokens=20, block=5)
    assert {(r.source, r.copies) for r in many.collect()} == {("a", 3), ("b", 1)}
    empty, none = M.mixture(frame(spark, "documents", []), goal)
    assert empty.count() == 0 and {r.reached_share for r in none.collect()} == {0.0}
    one, two = (sorted(r.doc_id for r in M.mixture(frame(spark, "documents", rows), goal, total_tokens=60, seed=s, block=5)[0].collect()) for s in (1, 1))
    assert one == two


@pytest.mark.skipif(not HAS_TOKENIZER, reason="no tokenizer")
def test_blocks_are_drawn_whole_by_the_seed(spark):
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    rows = [{"doc_id": i, "text": "one two three four five " * (1 + i % 4), "source": "a" if i % 3 else "b"} for i in range(600)]
    picks = []
    for seed in (1, 2):
        mixed, report = M.mixture(frame(spark, "documents", rows), goal, total_tokens=4000, seed=seed, block=40, shard_tokens=1000)
        got = mixed.collect()
        every = M.mixture(frame(spark, "documents", rows), goal, total_tokens=10**9, seed=seed, block=40, shard_tokens=1000)[0].collect()
        blocks = {(r.source, r.shard, r.block) for r in got}
        assert {r.doc_id for r in got} == {r.doc_id for r in every if (r.source, r.shard, r.block) in blocks}, "a block is drawn whole"
        shards = len({(r.source, r.shard) for r in every})
        assert all(abs(r.tokens - 2000) <= shards * 30 for r in report.collect())
        picks.append(blocks)
    assert picks[0] != picks[1]


@pytest.mark.skipif(not HAS_TOKENIZER, reason="no tokenizer")
@pytest.mark.parametrize("text", ["word and another  word\n" * 20_000, "line\n\n  'll don't it's 5's a_b\n" * 9_000, "x" * 250_000, "αβγ1234!?...\t \r\n" * 9_000, "7" * 30_000 + " " * 30_000 + "\n\n\n" * 9_000 + "z", "a\x1cb\u2003c\u00a0 d' s" * 9_000])
def test_tokens_of_long_texts_add_up(text, spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 1000)
    encode = M._encoding(f"{M.TOKENIZERS}/{M.VOCABULARY}").encode_ordinary
    assert "".join(M._pieces(text)) == text
    assert sum(len(encode(p)) for p in M._pieces(text)) == len(encode(text))
    assert M.token_counts(frame(spark, "documents", [{"doc_id": 1, "text": text, "source": "a"}])).first().tokens == len(encode(text))


# --- spam ---------------------------------------------------------------------------------------------------------------

SENTENCES = ["It took 21 attempts before nothing in the log showed the attempt.", "Our advice to the scout is to rotate the shared secret before the next run.", "The owner team believes that the reply came back empty, but the timeline says otherwise.", "We rate this low because a guest could read another file of the tenant.", "Please move the check to the server, so that the queue is not starved again."]
SPAM = {
    "dressed": "Looking for cheap log viewer? Our cheap log viewer is the log viewer for log viewer buyers. Every log viewer here is a top log viewer, and a top log viewer beats any log viewer.",
    "lines": "\n".join(f"{a} {b}" for a in ("buy", "top", "cheap", "hot") for b in ("safe box", "proxy list", "port scanner")),
    "links": "\n".join(f"[best safe box](https://s{i}.example/x{i})" for i in range(12)),
    "bare": "\n".join(f"https://s{i}.example/x{i}" for i in range(12)),
    "tags": " ".join(f"#tag{i} #sale" for i in range(12)),
    "products": "; ".join(f"Tal-{i} Safe Box XL" for i in range(200, 215)),
    "places": " ".join(f"safe box in Town{i}" for i in range(15)),
}


def prose(i, n=8):
    return " ".join(SENTENCES[(i + k) % 5].replace("21", str(i + k)) for k in range(n))


def test_spam_pages(spark):
    rows = [(i, prose(i)) for i in range(60)] + [(100 + i, "\n".join(f"2025-01-08T23:{i:02}:{k:02} INFO gate[1]: GET /a/b status=200 dur={k}ms" for k in range(20))) for i in range(20)]
    rows += [(200 + i, "def f(x):\n    if x.get(y) != 1:\n        return None\n    return x\n" * 4) for i in range(20)] + [(300 + i, "| id | note |\n|---|---|\n" + "\n".join(f"| F-{k} | {SENTENCES[k % 5]} |" for k in range(6))) for i in range(20)]
    rows += [(1000 + 100 * j + i, t if i % 2 else prose(i, 1) + "\n" + "\n".join([t] * 2)) for j, t in enumerate(SPAM.values()) for i in range(20)]
    rows += [(5000 + i, prose(i, 12) + "\n" + SPAM["lines"][:40]) for i in range(10)] + [(6000 + i, f"https://s{i}.example/x {prose(i, 2)}\n" * 5) for i in range(10)]
    rows += [(7000, None), (7001, " "), (7002, prose(1, 20_000)), (1000, SPAM["dressed"])]
    scored = S.score(docs(spark, rows)).cache()
    found = [r.doc_id for r in S.spam_pages(scored).collect()]
    assert sorted(found) == sorted(set(found))
    want = {i for i, _ in rows if 1000 <= i < 5000}
    assert len(want & set(found)) >= 0.97 * len(want) and len(set(found) - want) <= 2
    assert scored.filter("doc_id in (7000, 7001)").count() == 0 and scored.filter("doc_id = 7002").first().score < 0.1
    assert S.score(docs(spark, [])).count() == 0


def test_tokens_with_a_bullet_attached_count():
    assert S.Pack(["•vpn •proxy •seo\n• cheap •• vpn\n•"]).tokens == [3, 2]
    text = "One here. Two there! Three: https://a.example/b?c=1 and more words in this line. 四です。五です。\n\n| a | b |\n"
    assert sum(S.Pack([text]).tokens) == len(text.split()) and S.Pack(["", " \n"]).tokens == []


PROSE = {
    "pl": "Wczoraj wieczorem spotkaliśmy się w małej kawiarni przy rynku. Rozmawialiśmy długo o tym, co wydarzyło się w zeszłym roku. Nikt nie spodziewał się, że sprawa wróci tak szybko. Po powrocie do domu napisałem list do brata. Odpowiedział dopiero po dwóch tygodniach, bo był w podróży.",
    "ru": "Вчера вечером мы встретились в небольшом кафе у площади. Мы долго говорили о том, что случилось в прошлом году. Никто не ожидал, что дело вернётся так скоро. После возвращения домой я написал письмо брату. Он ответил только через две недели, потому что был в дороге.",
    "it": "Ieri sera ci siamo incontrati in un piccolo caffè vicino alla piazza. Abbiamo parlato a lungo di quello che era successo l'anno scorso. Nessuno si aspettava che la questione tornasse così presto. Tornato a casa ho scritto una lettera a mio fratello.",
    "fi": "Eilen illalla tapasimme pienessä kahvilassa torin laidalla. Puhuimme pitkään siitä, mitä viime vuonna tapahtui. Kukaan ei odottanut, että asia palaisi näin pian. Kotiin palattuani kirjoitin kirjeen veljelleni.",
    "tr": "Dün akşam meydanın yanındaki küçük bir kahvede buluştuk. Geçen yıl olanlar hakkında uzun uzun konuştuk. Kimse meselenin bu kadar çabuk geri döneceğini beklemiyordu. Eve döndükten sonra kardeşime bir mektup yazdım.",
    "zh": "昨天晚上我们在广场旁边的一家小咖啡馆见面。我们谈了很久去年发生的事情。没有人想到这件事会这么快回来。回家以后我给弟弟写了一封信。他两个星期以后才回信，因为他在旅行。",
    "ar": "التقينا مساء أمس في مقهى صغير بجانب الساحة. تحدثنا طويلا عن ما حدث في العام الماضي. لم يتوقع أحد أن تعود القضية بهذه السرعة. بعد العودة إلى البيت كتبت رسالة إلى أخي.",
    "hu": "Tegnap este egy kis kávéházban találkoztunk a tér mellett\nSokáig beszélgettünk arról ami tavaly történt velünk\nSenki sem várta hogy az ügy ilyen gyorsan visszatér\nHazatérve levelet írtam a testvéremnek aki éppen úton volt",
}
STUFFED = {
    "pl": "tanie buty online, tanie buty sklep, buty tanie promocja, tanie buty damskie, buty online tanie, tanie buty męskie, sklep tanie buty, tanie buty zimowe, najlepsze tanie buty, tanie buty",
    "semicolons": "cheap vpn; best vpn; free vpn; fast vpn; pro vpn; cheap vpn; vpn deal; vpn shop;",
    "status": " ".join(f"https://{c}.example/?status={k}" for k, c in enumerate("abcdefgh")),
    "heading": "# cheap vpn best vpn free vpn cheap vpn best proxy free proxy cheap proxy vpn proxy cheap vpn best vpn free vpn",
}


def test_form_is_judged_in_any_language(spark, middle):
    """Pages of languages that the training pages lack, and spam that looks like code, logs or headings."""
    own = spark.read.parquet(f"{middle}/documents.parquet")
    more = docs(spark, [(10**6 + k, t) for k, t in enumerate(PROSE.values())] + [(2 * 10**6 + k, t) for k, t in enumerate(STUFFED.values())])
    found = {r.doc_id for r in S.spam_pages(S.score(own.unionByName(more))).collect()}
    assert {list(PROSE)[i - 10**6] for i in found if 10**6 <= i < 2 * 10**6} == set()
    assert {list(STUFFED)[i - 2 * 10**6] for i in found if i >= 2 * 10**6} == set(STUFFED)


def test_the_rate_of_a_host_moves_pages_near_one_half(spark, monkeypatch):
    def pages(documents, model):
        return documents.selectExpr("doc_id", "engagement as host", "100.0 as words", "cast(n_chars as double) as spam_words", "10.0 as segments")

    monkeypatch.setattr(S, "_scored", pages)
    monkeypatch.setattr(S, "train", lambda documents: None)
    rows = [{"doc_id": 1000 * h + i, "engagement": f"h{h}", "n_chars": 100 if h < 2 else 0} for h in range(12) for i in range(60)]
    rows += [{"doc_id": 10**6 + 10 * h + k, "engagement": f"h{h}", "n_chars": n} for h in (0, 5) for k, n in enumerate((45, 52, 0, 100))]
    score = {r.doc_id: r.score for r in S.score(frame(spark, "documents", rows)).collect()}
    assert score[10**6] > 0.5 > score[10**6 + 50], "45 % among spam pages is spam, among others not"
    assert score[10**6 + 1] > 0.5 > score[10**6 + 51]
    assert all(score[10**6 + 10 * h + 2] < 0.1 and score[10**6 + 10 * h + 3] > 0.9 for h in (0, 5)), "clear pages stay"
    even = [{"doc_id": i, "engagement": f"h{i % 12}", "n_chars": 100 if i % 7 == 0 else 45} for i in range(840)]
    assert all((r.score > 0.5) == (r.doc_id % 7 == 0) for r in S.score(frame(spark, "documents", even)).collect()), "hosts that are alike move nothing"


def test_held_out_segments(spark, middle):
    """Trees from one half of the weakly labelled pages agree with the labels of the other half."""
    texts = [r["text"] for r in read(middle, "documents") if r["text"]]
    half = len(texts) // 2
    seen, new = S.Pack(texts[:half]), S.Pack(texts[half:])
    x, rules = seen.features(), S.rules(seen.features())
    y, want = S.weak_labels(rules), S.weak_labels(S.rules(new.features()))
    ends = np.searchsorted(seen.segment, np.arange(len(x) + 1))
    buckets, keep = seen.buckets(), np.flatnonzero(y >= 0)
    model = S.Model(x[keep], y[keep], (rules @ (1 << np.arange(rules.shape[1])))[keep], np.asarray(seen.page)[keep] % 2, [buckets[ends[k] : ends[k + 1]] for k in keep])
    p = model.spam(new) > 0.5
    assert (p[want >= 0] == (want[want >= 0] == 1)).mean() > 0.99


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    model = BaggedTrees(x[:3000], y[:3000], trees=9, depth=6)
    assert ((model.predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert BaggedTrees(x[:0], y[:0]).predict(x[:3]).tolist() == [0, 0, 0]


@pytest.mark.skipif(not HAS_TOKENIZER, reason="no tokenizer")
def test_documents_with_clashing_columns(spark):
    item = " ".join(f"w{i}" for i in range(20))
    d = frame(spark, "documents", [{"doc_id": i, "text": item if i == 1 else prose(i), "source": "a", "engagement": None} for i in range(20)])
    for c in ("host", "words", "score", "spam_words", "tokens", "shard", "at", "middle", "copies", "item_id", "covered_words", "m", "b"):
        d = d.withColumn(c, d["doc_id"])
    assert L.leaks(L.matches(d, items(spark, [(7, item)]).selectExpr("*", "0 as doc_id"))).count() == 1
    assert S.score(d).count() == 20
    goal = spark.createDataFrame([("a", 1.0, 1, "x")], "source string, target_share double, max_repeats int, tokens string")
    assert M.mixture(d, goal)[0].count() == 20
