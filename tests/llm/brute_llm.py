"""Plain Python versions of the training-text operators."""

from collections import defaultdict

from brute import first_rows, load, opened

from logmill.llm.text import words


def key(x):
    return None if x is None else x.strip().lower()


def blank(v):
    v = opened(v)
    if isinstance(v, dict):
        return all(map(blank, v.values()))
    if isinstance(v, list):
        return all(map(blank, v))
    return v is None or (isinstance(v, str) and not v.strip())


def conversations(messages):
    rows = first_rows(messages)
    canon, least = {}, {}
    for seq in sorted(rows):
        r = rows[seq]
        if r["dedup_key"] is not None and r["sender"] is not None:
            canon[seq] = least.setdefault((key(r["sender"]), r["dedup_key"]), seq)
    take = {s: r for s, r in rows.items() if canon.get(s, s) == s and key(r["kind"]) in ("ask", "reply", "close")}
    up, parent = {}, {}
    for s, r in take.items():
        p = r["reply_to"]
        p = canon.get(p, p)
        if p in take and take[p]["engagement"] == r["engagement"]:
            parent[s] = p
    group = {s: s for s in take}

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for s, p in parent.items():
        group[find(s)] = find(p)
    answered = {p for s, p in parent.items() if key(take[s]["kind"]) == "reply"}
    bad, members = set(), defaultdict(list)
    for s, r in take.items():
        k, p = key(r["kind"]), parent.get(s)
        v = load(r["data_json"])
        wrong = (r["reply_to"] is None and k != "ask") or (r["reply_to"] is not None and (p is None or p >= s)) or (k == "ask" and s not in answered) or v is ... or blank(v)
        if p is not None:
            q = take[p]
            wrong |= key(q["recipient"]) not in (key(r["sender"]), "@" + key(r["role"])) or key(r["recipient"]) != key(q["sender"])
        if wrong:
            bad.add(find(s))
        members[find(s)].append(s)
    return {(min(m), i, s) for g, m in members.items() if g not in bad for i, s in enumerate(sorted(m), 1)}


def shared_passages(documents, items, run=5):
    """{(doc_id, item_id): (item words, words in shared runs, longest run)} by comparing every pair of positions."""
    out = {}
    for d, text in documents:
        w = words(text)
        for i, item in items:
            v = words(item)
            covered, longest = set(), 0
            for p in range(len(v)):
                for k in range(len(w)):
                    n = 0
                    while p + n < len(v) and k + n < len(w) and v[p + n] == w[k + n]:
                        n += 1
                    if n >= run:
                        covered |= set(range(p, p + n))
                        longest = max(longest, n)
            if covered:
                out[d, i] = (len(v), len(covered), longest)
    return out
