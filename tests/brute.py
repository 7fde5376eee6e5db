"""Plain Python versions of what SQL can't express, over lists of dicts."""

import json
from collections import Counter, defaultdict


def load(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return ...


def opened(v):
    if isinstance(v, str) and v.strip()[:1] in ("{", "["):
        w = load(v)
        if isinstance(w, (dict, list)):
            return w
    return v


def first_rows(rows):
    best = {}
    for r in sorted(rows, key=lambda r: r["arrived_at"]):
        best.setdefault(r["seq"], r)
    return best


def array_objects(messages):
    out = set()

    def walk(seq, field, v, path, parent, top):
        v = opened(v)
        if isinstance(v, dict):
            for k in v:
                walk(seq, field, v[k], f"{path}.{k}", parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                x, here = opened(x), f"{path}[{i}]"
                counts = isinstance(x, dict) or (top and x is not None)
                if counts:
                    out.add((seq, field, here, parent))
                walk(seq, field, x, here, here if counts else parent, False)

    for seq, r in first_rows(messages).items():
        for field in ("data_json", "evidence_json"):
            v = load(r[field])
            if v is ...:
                continue
            v = opened(v)
            if field == "evidence_json" and isinstance(v, dict):
                v = [v]
            walk(seq, field, v, "$", "$", field == "evidence_json")
    return out


def json_type(v):
    return {type(None): None, bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def deep(v):
    v = opened(v)
    if isinstance(v, dict):
        return ("o", tuple(sorted((k, deep(x)) for k, x in v.items())))
    if isinstance(v, list):
        return ("a", tuple(map(deep, v)))
    return (type(v).__name__, v)


def drift_changes(dump_rows):
    files = defaultdict(list)
    for r in dump_rows:
        files[r["feed"], r["exported_at"], r["file_name"]].append(r)
    feeds = defaultdict(list)
    for (feed, at, name), rows in sorted(files.items()):
        records, types = {}, defaultdict(Counter)
        for r in sorted(rows, key=lambda r: r["line_no"]):
            body = load(r["body"])
            if isinstance(body, dict):
                again = r["rec_key"] in records
                records.setdefault(r["rec_key"], body)
                for k, v in body.items():
                    types[k][json_type(v)] += not again
        feeds[feed].append((name, records, types))
    out = set()
    for feed, versions in feeds.items():
        for (_, old, old_types), (name, now, now_types) in zip(versions, versions[1:]):
            new, gone = set(now_types) - set(old_types), set(old_types) - set(now_types)
            pairs = []
            for g in gone:
                for n in new:
                    both = [(old[k][g], now[k][n]) for k in set(old) & set(now) if old[k].get(g) is not None and now[k].get(n) is not None]
                    same = sum(deep(a) == deep(b) for a, b in both)
                    if len(both) >= 2 and same * 2 > len(both):
                        pairs.append((-same / len(both), -same, g, n))
            for _, _, g, n in sorted(pairs):
                if g in gone and n in new:
                    out.add((feed, name, "renamed", n, g))
                    gone.remove(g)
                    new.remove(n)
            out |= {(feed, name, "added", n, "") for n in new} | {(feed, name, "removed", g, "") for g in gone}
            for k in set(now_types) & set(old_types):
                a, b = (Counter({t: c for t, c in x[k].items() if t}) for x in (old_types, now_types))
                if a and b:
                    top = [{t for t, c in x.items() if c == max(x.values())} for x in (a, b)]
                    if not top[0] & top[1]:
                        out.add((feed, name, "retyped", k, ""))
    return out
