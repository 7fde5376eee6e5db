"""Problems 2 to 5 beside brute force, and their edge cases."""

import datetime as dt
import itertools
import json

import pytest

import brute
from conftest import read
from logmill.functions import jsontree as J
from logmill.operators import drift, hierarchy, nested, references
from logmill.plans.scratch import Scratch
from logmill.queries import QUERIES
from logmill.sources.tables import SCHEMAS

T0 = dt.datetime(2025, 1, 1)


def at(n):
    return T0 + dt.timedelta(minutes=n)


def frame(spark, name, rows):
    names = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMAS[name])


def agent(i, aid, parent=None, eng="e", n=None, **k):
    return {"seq": i, "agent_id": aid, "parent": parent, "engagement": eng, "arrived_at": at(i if n is None else n), "role": "scout", "created_at": "2025-01-31T23:30:00-02:00", **k}


def tree(spark, rows):
    return {r.agent_id: (r.root_id, r.depth, r.path) for r in hierarchy.hierarchy(frame(spark, "participants", rows)).collect()}


def test_hierarchy_of_chain_cycles_and_strays(spark):
    rows = [agent(1, "r"), agent(2, "a", " R "), agent(3, "b", "a"), agent(4, "c1", "c2"), agent(5, "c2", "c1"), agent(6, "below", "c1"), agent(7, "self", "self"), agent(8, "blank", "  "), agent(9, "stray", "nobody"), agent(10, "other", "r", "e2")]
    got = tree(spark, rows)
    assert got["b"] == ("r", 2, "r/a/b")
    assert all(got[x] == ("", -1, "") for x in ("c1", "c2", "below", "self"))
    assert got["blank"] == ("blank", 0, "blank") and got["stray"] == ("stray", 0, "stray") and got["other"] == ("other", 0, "other")


def test_hierarchy_takes_the_lowest_seq_and_ignores_repeats(spark):
    rows = [agent(2, "x", "r"), agent(1, "r"), agent(5, "x", None), agent(2, "x", "r", n=50), agent(None, "x", "z", n=7), agent(3, None), agent(4, " ")]
    assert tree(spark, rows) == {"r": ("r", 0, "r"), "x": ("r", 1, "r/x")}


def test_hierarchy_of_a_deep_chain_and_a_wide_root(spark):
    rows = [agent(0, "n0")] + [agent(i, f"n{i}", f"n{i - 1}") for i in range(1, 150)] + [agent(1000 + i, f"w{i}", "n0") for i in range(500)]
    got = tree(spark, rows)
    assert got["n149"][:2] == ("n0", 149) and got["n149"][2].count("/") == 149
    assert sum(v[1] == 1 for v in got.values()) == 501


def test_hierarchy_of_nothing_and_clashing_columns(spark):
    assert tree(spark, []) == {}
    df = frame(spark, "participants", [agent(1, "r"), agent(2, "a", "r")])
    for c in ("ptr", "root", "depth", "path", "node", "known", "__salt"):
        df = df.withColumn(c, df["seq"])
    assert hierarchy.hierarchy(df).count() == 2


def test_descendants(spark):
    t = hierarchy.ancestry(frame(spark, "participants", [agent(1, "r/1"), agent(2, "a", "r/1"), agent(3, "b", "a"), agent(4, "l", "l")]))
    assert {tuple(x) for x in hierarchy.descendants(t).collect()} == {("r/1", "a", 1), ("r/1", "b", 2), ("a", "b", 1)}
    assert {tuple(x) for x in hierarchy.subtree_sizes(t).collect()} == {("r/1", 2, 2), ("a", 1, 1), ("b", 0, 0)}
    assert [x.agent_id for x in hierarchy.cyclic(t).collect()] == ["l"]


def message(i, **k):
    return {"seq": i, "sender": "a1", "recipient": "a2", "kind": "ask", "engagement": "e", "arrived_at": at(i), "created_at": "2025-02-01T00:30:00+01:00", "role": "scout", "data_json": '{"s":"x"}', "evidence_json": "[]", **k}


def found(spark, messages, participants=(), purges=()):
    df = references.find_orphans(frame(spark, "messages", messages), frame(spark, "participants", participants), frame(spark, "purges", purges))
    return {(r.ref_table, r.ref_field, r.seq, r.status) for r in df.collect()}


def test_orphans(spark):
    people = [agent(1, "a1", n=0), agent(2, "a2", n=0), agent(3, "a3", " GONE "), agent(4, "late", n=90)]
    purges = [{"purge_id": 1, "engagement": "e", "target": "messages", "target_key": "77"}, {"purge_id": 2, "engagement": "e", "target": "participants", "target_key": "gone"}, {"purge_id": 3, "engagement": "x", "target": "messages", "target_key": "78"}]
    rows = [message(10), message(11, reply_to=10), message(12, reply_to=77), message(13, reply_to=78), message(14, reply_to=20), message(20), message(21, recipient="@topic"), message(22, recipient=" LATE "), message(23, recipient=None), message(24, recipient=""), message(10, arrived_at=at(99), reply_to=999), message(30, reply_to=10, engagement="x", recipient="@t")]
    assert found(spark, rows, people, purges) == {
        ("messages", "reply_to", 12, "deleted"),
        ("messages", "reply_to", 13, "missing"),
        ("messages", "reply_to", 14, "late"),
        ("messages", "recipient", 22, "late"),
        ("messages", "reply_to", 30, "missing"),
        ("participants", "parent", 3, "deleted"),
    }
    assert found(spark, []) == set()


def test_orphan_state_from_batches(spark):
    def batch(m=(), p=(), g=()):
        return references.facts(frame(spark, "messages", m), frame(spark, "participants", p), frame(spark, "purges", g))

    def gone(*row_ids):
        return spark.createDataFrame([(i,) for i in row_ids], "row_id string")

    def now(state):
        return {(r.seq, r.ref_field, r.status) for r in references.orphans(state).collect()}

    scratch = Scratch(spark, "batches")

    def step(state, *args):
        return references.store(references.advance(state, *args), scratch, f"step-{next(number)}")

    number = itertools.count()
    people = [agent(1, "a1", n=0), agent(2, "a2", n=0)]
    one = step(None, batch([message(10, reply_to=11), message(12)], people))
    assert now(one) == {(10, "reply_to", "missing")}
    two = step(one, batch([message(11), message(13, reply_to=12)]))
    assert now(two) == {(10, "reply_to", "late")}
    whole = step(None, batch([message(10, reply_to=11), message(12), message(11), message(13, reply_to=12)], people))
    compact = whole.counts.groupBy(*references.KEY, "at").sum(*references.COUNTS)
    assert {tuple(r) for r in two.counts.select(*references.KEY, "at", *references.COUNTS).collect()} == {tuple(r) for r in compact.collect()}
    # Exports that come again, in the same and in later batches, count nothing twice.
    again = step(two, batch([message(10, reply_to=11, arrived_at=at(500)), message(13, reply_to=99, arrived_at=at(501)), message(12)]))
    assert now(again) == now(two) and {tuple(r) for r in again.counts.collect()} == {tuple(r) for r in two.counts.collect()}
    # A removed target is missing, noted ones are deleted, one that is added again is late.
    less = step(again, batch(), gone("messages/12"))
    assert now(less) == {(10, "reply_to", "late"), (13, "reply_to", "missing")}
    noted = step(less, batch(g=[{"purge_id": 1, "engagement": "e", "target": " Messages", "target_key": "12"}]))
    assert (13, "reply_to", "deleted") in now(noted)
    back = step(noted, batch([message(12, arrived_at=at(600))]))
    assert (13, "reply_to", "late") in now(back)
    # Rows that refer go with their references; unknown removals change nothing.
    none = step(back, batch(), gone("messages/10", "messages/13", "messages/404"))
    assert now(none) == set() and none.counts.filter("n_refs < 0 or n_rows < 0").count() == 0


def test_month_is_in_utc(spark):
    df = spark.createDataFrame([("2025-02-01T00:30:00+01:00",), (" 2025-02-01 00:30:00Z",), ("no time",), (None,)], "t string")
    assert [r[0] for r in df.select(references.utc_month("t")).collect()] == ["2025-01", "2025-02", None, None]


def test_flatten_and_drift_beside_brute_force(spark, middle):
    got = [tuple(r) for r in QUERIES["p4_found"](spark, middle).collect()]
    assert set(got) == brute.array_objects(read(middle, "messages")) and len(got) == len(set(got))
    got = [tuple(r) for r in QUERIES["p5_found"](spark, middle).collect()]
    assert set(got) == brute.drift_changes(read(middle, "dump_rows")) and len(got) == len(set(got))


def nodes(spark, data=None, evidence=None):
    every = nested.flatten(frame(spark, "messages", [message(1, data_json=data, evidence_json=evidence)]))
    only = nested.flatten(frame(spark, "messages", [message(1, data_json=data, evidence_json=evidence)]), elements=True)
    got = {(r.field, r.node_path, r.parent_path) for r in nested.elements(only).collect()}
    assert got == {(r.field, r.node_path, r.parent_path) for r in nested.elements(every).collect()}
    return got


def test_flatten_paths(spark):
    inner = json.dumps([{"x": json.dumps({"l": [{}, 1, None, {"q": [[{"z": 1}]]}]})}])
    assert nodes(spark, json.dumps({"a": inner})) == {("data_json", "$.a[0]", "$"), ("data_json", "$.a[0].x.l[0]", "$.a[0]"), ("data_json", "$.a[0].x.l[3]", "$.a[0]"), ("data_json", "$.a[0].x.l[3].q[0][0]", "$.a[0].x.l[3]")}
    assert nodes(spark, None, '{"ref":"r","spans":[{"a":1}]}') == {("evidence_json", "$[0]", "$"), ("evidence_json", "$[0].spans[0]", "$[0]")}
    assert nodes(spark, "[1,null,{}]", '["s",null,3]') == {("data_json", "$[2]", "$"), ("evidence_json", "$[0]", "$"), ("evidence_json", "$[2]", "$")}
    for bad in (None, "", "{", "null", '"text"', "[NaN]", "[" * 100_000):
        assert nodes(spark, bad, bad) == set()
    assert len(nodes(spark, '{"a":[' + "{}," * 50_000 + "{}]}")) == 50_001
    assert nodes(spark, '{"\\ud800":[{}]}') == {("data_json", "$.�[0]", "$")}


def test_subtypes_keep_links_and_what_does_not_fit(spark):
    data = json.dumps({"findings": [{"id": "F", "tags": ["a", "b"], "steps": [{"n": 1, "action": "x"}, {"n": "one", "odd": {"k": 2}}]}]})
    n = nested.flatten(frame(spark, "messages", [message(1, data_json=data)]))
    steps = {r.node_path: r for r in nested.subtype(n, "steps").collect()}
    assert steps["$.findings[0].steps[0]"].n == 1 and steps["$.findings[0].steps[0]"].parent_path == "$.findings[0]"
    odd = steps["$.findings[0].steps[1]"]
    assert odd.n is None and odd.more == {"n": "one", "odd.k": "2"}
    assert nested.subtype(n, "findings").first().tags == ["a", "b"]
    assert len({(r.record_type, r.shape) for r in n.filter("record_type = 'steps'").collect()}) == 2
    assert sum(df.count() for df in nested.route(n).values()) == n.count()


def test_typed_tables_hold_what_stands_outside_arrays(spark):
    data = {"summary": "s", "confidence": 0.5, "open": ["q"], "task": {"title": "t", "limits": {"max_requests": 9, "windows": [{"from": 1, "to": 2}]}}, "outcome": json.dumps({"status": "done"}), "finding": {"id": "L", "steps": [{"n": 1}]}, "findings": [{"id": "F"}, "only text", [["deep text", None]]]}
    evidence = ["notes/a.txt", None, {"ref": "r"}]
    n = nested.flatten(frame(spark, "messages", [message(1, data_json=json.dumps(data), evidence_json=json.dumps(evidence)), message(2, data_json='"lone"', evidence_json='"lone.txt"'), message(3, data_json="null", evidence_json="{")]))
    rows = {(r.seq, r.field, r.node_path): r for r in n.collect()}
    assert {(seq, p, r.parent_path, r.record_type) for (seq, f, p), r in rows.items() if f == "data_json"} == {
        (1, "$", None, "bodies"), (1, "$.task", "$", "tasks"), (1, "$.task.limits.windows[0]", "$.task", "windows"), (1, "$.outcome", "$", "outcomes"), (1, "$.finding", "$", "findings"),
        (1, "$.finding.steps[0]", "$.finding", "steps"), (1, "$.findings[0]", "$", "findings"), (1, "$.findings[1]", "$", "findings"), (1, "$.findings[2][0][0]", "$", "findings"), (2, "$", None, "bodies"),
    }
    assert {(seq, p) for seq, f, p in rows if f == "evidence_json"} == {(1, "$[0]"), (1, "$[2]"), (2, "$")}
    tables = {k: {(r.seq, r.node_path): r for r in df.collect()} for k, df in nested.route(n).items() if k in ("bodies", "tasks", "outcomes", "findings", "anchors", "")}
    assert not tables[""]
    body, task = tables["bodies"][1, "$"], tables["tasks"][1, "$.task"]
    assert (body.summary, body.confidence, body.open, body.more) == ("s", "0.5", ["q"], {}) and tables["bodies"][2, "$"].more == {"": "lone"}
    assert (task.title, task.limits_max_requests, task.more) == ("t", 9, {}) and tables["outcomes"][1, "$.outcome"].status == "done"
    found = tables["findings"]
    assert found[1, "$.finding"].id == "L" and found[1, "$.findings[1]"].more == {"": "only text"} and found[1, "$.findings[2][0][0]"].more == {"": "deep text"}
    assert tables["anchors"][2, "$"].more == {"": "lone.txt"}
    assert {"p4_tasks", "p4_outcomes", "p4_bodies"} <= set(QUERIES)


def test_states_route_records_whatever_their_array_is_called(spark):
    call, step, span = {"path": "/x", "status": 200}, {"n": 1, "action": "a"}, {"from": 1, "to": 2}
    data = {"requests": [call], "findings": [step, {"id": 1}], "job": {"title": "t", "targets": []}, "spans": [span], "windows": [span], "ranges": [span], "odd": [{"k": 1}]}
    n = nested.flatten(frame(spark, "messages", [message(1, data_json=json.dumps(data), evidence_json=None)]))
    assert {(r.node_path, r.record_type) for r in n.collect()} == {
        ("$", "bodies"), ("$.requests[0]", "calls"), ("$.findings[0]", "steps"), ("$.findings[1]", "findings"), ("$.job", "tasks"),
        ("$.spans[0]", "spans"), ("$.windows[0]", "windows"), ("$.ranges[0]", "ranges"), ("$.odd[0]", "odd"),
    }
    assert {r.node_path for r in nested.others(n).collect()} == {"$.ranges[0]", "$.odd[0]"} and "p4_others" in QUERIES


def test_states_of_the_tree_automaton():
    assert J.state({"a": 1, "b": [1, 2]}) == J.state({"b": [5], "a": 9})
    assert len({J.state(v) for v in ({"a": 1}, {"a": "1"}, {"a": None}, {"a": []}, {"a": [1]}, {"b": 1}, [1], 1)}) == 8
    assert J.is_blank(J.read('{"a":" ","b":[null,"{}"]}')) and not J.is_blank(J.read('{"a":0}')) and not J.is_blank(J.read('{"a":"[0]"}'))
    assert J.is_blank(J.read(None)) and J.is_blank(J.read("{")) and not J.is_blank(J.read("9" * 5000))


def test_states_and_texts_of_deep_values():
    def deep(leaf, levels):
        for _ in range(levels):
            leaf = {"a": [leaf]}
        return leaf

    assert J.state(deep(1, 300)) != J.state(deep("1", 300)) and J.state(deep(1, 300)) == J.state(deep(2, 300))
    assert J.read("[" * 50_000 + "7" + "]" * 50_000) is not J.INVALID and J.read("[" * 50_000 + "7" + "]" * 49_999) is J.INVALID
    assert J.canonical(J.read('{"a":[' * 30_000 + "1" + "]}" * 30_000)) == '{"a":[' * 30_000 + "1" + "]}" * 30_000
    for text in ('{"a":[1,2,{"b":null}],"c":"x\\u0041"}', " [ ] ", '"x"', "[1,]", '{"a"}', "[1 2]", '{"a":1,}', "01", "-", "1.5e3", "tru", "[true,false,null]", '{"a":{},"b":[]}', "", '{"a":NaN}', "[1]x", "{1:2}", '["\n"]'):
        try:
            want = json.loads(text, parse_constant=J._refuse)
        except ValueError:
            with pytest.raises(ValueError):
                J._read_deep(text)
        else:
            assert J._read_deep(text) == want
    assert J.canonical(deep(1, 40_000)) != J.canonical(deep(2, 40_000))
    assert J.canonical(deep('{"b": 1.5, "a": [null, "ü"]}', 40_000)) == '{"a":[' * 40_000 + '{"a":[null,"ü"],"b":1.5}' + "]}" * 40_000


def dump(i, file, line, body, n=0, feed="f", kind="messages"):
    return {"dump_id": i, "feed": feed, "record_type": kind, "file_name": file, "exported_at": at(n), "line_no": line, "rec_key": str(line), "body": body if body is None else json.dumps(body)}


def test_drift_of_a_rename_chain(spark):
    rows = [dump(i, "a", i, {"seq": i, "kind": f"k{i}", "archived": 0}) for i in range(3)]
    rows += [dump(10 + i, "b", i, {"seq": i, "sort": f"k{i}", "archived": "0", "new": None}, 1) for i in range(3)]
    rows += [dump(20 + i, "c", i, {"seq": i, "type": f"k{i}", "new": i}, 2) for i in range(3)]
    rows += [rows[0], dump(30, "c", 9, None, 2), {**dump(31, "c", 10, {}, 2), "body": "no json"}]
    df = frame(spark, "dump_rows", rows)
    got = {(r.file_name, r.change, r.field, r.old_field) for r in drift.changes(df).collect()}
    assert got == {("b", "renamed", "sort", "kind"), ("b", "retyped", "archived", ""), ("b", "added", "new", ""), ("c", "renamed", "type", "sort"), ("c", "removed", "archived", "")}
    table = drift.unify(df, "messages").collect()
    assert len(table) == 11 and {r.kind for r in table} == {"k0", "k1", "k2", None}
    assert {r.archived for r in table if r.file_name == "b"} == {0}
    assert {r.extra.get("new") for r in table if r.file_name == "c" and r.seq is not None} == {"0", "1", "2"}
    assert drift.changes(frame(spark, "dump_rows", [])).count() == 0 and drift.unify(frame(spark, "dump_rows", []), "messages").count() == 0


def test_a_name_that_comes_back_begins_another_chain(spark):
    bodies = [{"seq": 1, "archived": 1}, {"seq": 1, "hidden": 1}, {"seq": 1}, {"seq": 1, "hidden": 9}, {"seq": 1, "shown": 9}]
    rows = [dump(10 * v + i, f"f{v}", i, {**b, "seq": i}, v) for v, b in enumerate(bodies) for i in range(3)]
    df = frame(spark, "dump_rows", rows)
    names = drift.canonical_names(df, drift.changes(df))
    assert {(r.since, r.until, r.name, r.target) for r in names.collect()} == {(2, 3, "hidden", "archived"), (5, 2**31 - 1, "shown", "hidden")}
    got = {(r.file_name, r.archived, r.extra.get("hidden")) for r in drift.unify(df, "messages").collect()}
    assert got == {("f0", 1, None), ("f1", 1, None), ("f2", 0, None), ("f3", 0, "9"), ("f4", 0, "9")}, "files that lack the column have its default"
    done = {(r.file_name, r.step, r.field, r.target) for r in drift.migrations(df, "messages").collect()}
    assert done == {("f1", "rename", "hidden", "archived"), ("f2", "default", "archived", "0"), ("f3", "default", "archived", "0"), ("f3", "extra", "hidden", ""), ("f4", "default", "archived", "0"), ("f4", "rename", "shown", "hidden"), ("f4", "extra", "shown", "")}


def test_embedded_texts_and_objects_are_two_types_of_one_value(spark):
    inner = {"a": [1, None]}
    rows = [dump(10 * v + i, f"f{v}", i, {"seq": i, "data_json": d, "archived": None, "model": 7}, v) for v, d in enumerate((json.dumps(inner), inner, json.dumps(inner, indent=1))) for i in range(3)]
    df = frame(spark, "dump_rows", rows)
    assert {(r.file_name, r.change, r.field) for r in drift.changes(df).collect()} == {("f1", "retyped", "data_json"), ("f2", "retyped", "data_json")}
    table = drift.unify(df, "messages").collect()
    assert {r.data_json for r in table} == {json.dumps(inner), '{"a":[1,null]}', json.dumps(inner, indent=1)} or {json.loads(r.data_json)["a"][0] for r in table} == {1}
    assert {r.archived for r in table} == {None}, "a record's null is no missing column"
    assert {(r.file_name, r.step, r.field, r.target) for r in drift.migrations(df, "messages").collect()} == {("f1", "cast", "data_json", "string"), *((f"f{v}", "cast", "model", "string") for v in range(3))}
    assert drift.migrations(frame(spark, "dump_rows", []), "participants").count() == 0


@pytest.mark.parametrize("turned", [False, True])
def test_two_fields_of_one_column_lose_no_value(spark, turned):
    bodies = [{"seq": 1, "archived": 1}, {"seq": 1, "hidden": 1}, {"seq": 1, "hidden": 1, "archived": 5}]
    rows = [dump(10 * v + i, f"f{v}", i, dict(list({**b, "seq": i}.items())[:: -1 if turned else 1]), v) for v, b in enumerate(bodies) for i in range(3)]
    got = {(r.file_name, r.archived, r.extra.get("hidden")) for r in drift.unify(frame(spark, "dump_rows", rows), "messages").collect()}
    assert got == {("f0", 1, None), ("f1", 1, None), ("f2", 5, "1")}


def test_a_file_without_fields_is_a_file(spark):
    bodies = [{"archived": 1}, None, {"archived": 1}, {"hidden": 1}]
    rows = [dump(10 * v + i, f"f{v}", i, b, v) for v, b in enumerate(bodies) for i in range(3)]
    df = frame(spark, "dump_rows", rows)
    assert {(r.file_name, r.version, r.change, r.field) for r in drift.changes(df).collect()} == {("f1", 2, "removed", "archived"), ("f2", 3, "added", "archived"), ("f3", 4, "renamed", "hidden")}
    assert {(r.file_name, r.archived) for r in drift.unify(df, "messages").collect()} == {("f0", 1), ("f1", None), ("f2", 1), ("f3", 1)}


def test_drift_needs_two_equal_pairs_and_a_majority(spark):
    one = [dump(1, "a", 1, {"x": 1}), dump(2, "b", 1, {"y": 1}, 1)]
    assert {(r.change, r.field) for r in drift.changes(frame(spark, "dump_rows", one)).collect()} == {("added", "y"), ("removed", "x")}
    half = [dump(i, "a", i, {"x": i}) for i in range(4)] + [dump(9 + i, "b", i, {"y": i if i < 2 else -1}, 1) for i in range(4)]
    assert {r.change for r in drift.changes(frame(spark, "dump_rows", half)).collect()} == {"added", "removed"}
    more = [dump(i, "a", i, {"x": i}) for i in range(4)] + [dump(9 + i, "b", i, {"y": i if i < 3 else -1}, 1) for i in range(4)]
    assert {r.change for r in drift.changes(frame(spark, "dump_rows", more)).collect()} == {"renamed"}


@pytest.mark.parametrize("a,b,same", [("1", 1, False), (1, True, False), ('{"a": 1}', {"a": 1}, True), ([1, 2], [2, 1], False)])
def test_equal_values(a, b, same):
    assert (J.canonical(a) == J.canonical(b)) is same


INTERNAL = ["key", "target", "status", "n_refs", "n_rows", "field", "fields", "version", "types", "gone", "new", "names", "renames", "h", "k", "__row", "__salt", "__hot"]


def crowded(df, first):
    for c in INTERNAL:
        df = df.withColumn(c, df[first])
    return df


def test_columns_with_clashing_names(spark):
    m, p, u = frame(spark, "messages", [message(1, reply_to=9, data_json='{"a":[{}]}')]), frame(spark, "participants", [agent(1, "a2")]), frame(spark, "purges", [])
    assert references.find_orphans(crowded(m, "seq"), crowded(p, "seq"), crowded(u, "purge_id")).count() == 1
    assert nested.flatten(crowded(m, "seq"), elements=True).count() == 1
    d = frame(spark, "dump_rows", [dump(1, "a", 1, {"x": 1}), dump(2, "b", 1, {"y": 1}, 1)])
    assert drift.changes(crowded(d, "dump_id")).count() == 2 and drift.unify(crowded(d, "dump_id"), "messages").count() == 2
