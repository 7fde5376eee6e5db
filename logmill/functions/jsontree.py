"""JSON values as trees: reading, embedded texts, emptiness, canonical form and shapes.

Spark's JSON functions need a known depth and lose the difference between 17 and "17"; these run in Arrow
batches on the executors instead.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring
from typing import Any, NamedTuple

INVALID = object()


def _refuse(name: str) -> None:
    raise ValueError(name)


def read(text: str | None) -> Any:
    """The value of a JSON text, or INVALID: null, no JSON, NaN or Infinity. Depth does not matter."""
    if text is None:
        return INVALID
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        pass
    try:  # an integer of more than 4,300 digits is valid JSON
        return json.loads(text, parse_constant=_refuse, parse_int=_integer)
    except ValueError:
        return INVALID
    except RecursionError:
        pass
    try:
        return _read_deep(text)
    except ValueError:
        return INVALID


def _integer(digits: str) -> int | float:
    return int(digits) if len(digits) < 4000 else float(digits)


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?", re.ASCII)
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _read_deep(text: str) -> Any:
    """``json.loads`` with the open containers in a list, for texts nested beyond the parser's stack."""
    top: list[Any] = []
    open_: list[Any] = [top]
    keys: list[str | None] = [None]
    at, end = _SPACE.match(text, 0).end(), len(text)
    while True:
        # A value begins here.
        c, closed = text[at : at + 1], True
        if c == "{" or c == "[":
            value: Any = {} if c == "{" else []
            _put(open_[-1], keys[-1], value)
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
            else:
                open_.append(value)
                keys.append(None)
                closed = False
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
            _put(open_[-1], keys[-1], value)
        elif c in _WORDS and text.startswith(_WORDS[c][0], at):
            _put(open_[-1], keys[-1], _WORDS[c][1])
            at += len(_WORDS[c][0])
        else:
            m = _NUMBER.match(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            _put(open_[-1], keys[-1], float(m[0]) if m[1] or m[2] else _integer(m[0]))
            at = m.end()
        # Close what ends here, then go on to the next value.
        while closed:
            at = _SPACE.match(text, at).end()
            if len(open_) == 1:
                if at != end:
                    raise ValueError(f"more text at {at}")
                return top[0]
            mark = text[at : at + 1]
            if mark == ",":
                at = _SPACE.match(text, at + 1).end()
                break
            if mark != ("}" if isinstance(open_[-1], dict) else "]"):
                raise ValueError(f"no end at {at}")
            open_.pop()
            keys.pop()
            at += 1
        if isinstance(open_[-1], dict):
            if text[at : at + 1] != '"':
                raise ValueError(f"no name at {at}")
            keys[-1], at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = _SPACE.match(text, at + 1).end()


def _put(holder: Any, key: str | None, value: Any) -> None:
    if isinstance(holder, dict):
        holder[key] = value
    else:
        holder.append(value)


def opened(value: Any) -> Any:
    """A string that as a whole is the JSON text of an object or array stands for it."""
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in ("{", "["):
            inner = read(text)
            if isinstance(inner, (dict, list)):
                return inner
    return value


def read_open(text: str | None) -> Any:
    value = read(text)
    return value if value is INVALID else opened(value)


def is_blank(value: Any) -> bool:
    """True without any value except nulls, blank strings and empty containers; INVALID is blank."""
    if value is INVALID:
        return True
    todo = [value]
    while todo:
        v = opened(todo.pop())
        if isinstance(v, dict):
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)
        elif isinstance(v, str):
            if v.strip():
                return False
        elif v is not None:
            return False
    return True


def kind(value: Any) -> str:
    """integer, number, string, boolean, array, object or null, after opening an embedded text."""
    return written_kind(opened(value))


def written_kind(value: Any) -> str:
    """The JSON type as it is written: an embedded text is a string."""
    for types, name in (((bool,), "boolean"), ((int,), "integer"), ((float,), "number"), ((str,), "string"), ((list,), "array"), ((dict,), "object")):
        if isinstance(value, types):
            return name
    return "null"


def open_all(value: Any) -> Any:
    """A copy in which every embedded text, at any depth, is opened."""
    top: list[Any] = [value]
    todo: list[tuple[Any, Any]] = [(top, 0)]
    while todo:
        holder, at = todo.pop()
        v = opened(holder[at])
        if isinstance(v, dict):
            v = dict(v)
            todo.extend((v, k) for k in v)
        elif isinstance(v, list):
            v = list(v)
            todo.extend((v, i) for i in range(len(v)))
        holder[at] = v
    return top[0]


def canonical(value: Any) -> str:
    """One text for equal values: sorted keys, compact, embedded texts opened."""
    value = open_all(value)
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except RecursionError:
        return _written(value)


def _written(value: Any) -> str:
    """The same text for an opened value of any depth."""
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, value)]
    while todo:
        is_text, v = todo.pop()
        if is_text:
            out.append(v)
        elif isinstance(v, dict):
            todo.append((True, "}"))
            for i, k in reversed(list(enumerate(sorted(v)))):
                todo += [(False, v[k]), (True, ("," if i else "") + json.dumps(k, ensure_ascii=False) + ":")]
            todo.append((True, "{"))
        elif isinstance(v, list):
            todo.append((True, "]"))
            for i in range(len(v) - 1, -1, -1):
                todo += [(False, v[i]), (True, "," if i else "")]
            todo.append((True, "["))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def text_of(value: Any) -> str | None:
    """A scalar as plain text, a container in canonical form, null as None."""
    if value is None or isinstance(value, str):
        return value
    return canonical(value)


#: Automaton states of scalars; those of arrays and objects begin with ``a`` and ``o``.
SCALAR_STATES = {"null": "n", "boolean": "b", "integer": "i", "number": "f", "string": "s"}
KINDS = {v: k for k, v in SCALAR_STATES.items()} | {"a": "array", "o": "object"}


def state(value: Any, known: dict[int, str] | None = None, layers: dict[str, dict[str, str]] | None = None) -> str:
    """The state a bottom-up tree automaton reaches at a value.

    A scalar's state is its type. An array's is made of the set of its elements' states, an object's of its keys
    with their states, so objects of one shape reach one state whatever their values and key order. Container
    states are hashed to 64 bits: a transition table that needs no copy on every executor. ``known`` keeps the states
    of containers by id, for more calls within one value that open_all has made; ``layers`` gets, for each state of an object,
    the kinds of its fields, which is all that the last transition has read.
    """
    if known is None:
        value, known = open_all(value), {}
    if not isinstance(value, (dict, list)):
        return SCALAR_STATES[kind(value)]
    if id(value) in known:
        return known[id(value)]
    done: list[str] = []
    todo: list[tuple[Any, bool]] = [(value, False)]
    while todo:
        v, closed = todo.pop()
        if not closed:
            if not isinstance(v, (dict, list)):
                done.append(SCALAR_STATES[kind(v)])
            elif id(v) in known:
                done.append(known[id(v)])
            else:
                todo.append((v, True))
                todo.extend((x, False) for x in (reversed(v) if isinstance(v, list) else [v[k] for k in sorted(v, reverse=True)]))
            continue
        parts = done[len(done) - len(v) :]
        del done[len(done) - len(v) :]
        if isinstance(v, list):
            mark, text = "a", "[" + "|".join(sorted(set(parts))) + "]"
        else:
            keys = sorted(v)
            mark, text = "o", "{" + ";".join(f"{json.dumps(k, ensure_ascii=False)}:{p}" for k, p in zip(keys, parts)) + "}"
        reached = mark + hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:16]
        if layers is not None and mark == "o" and reached not in layers:
            layers[reached] = {k: KINDS[p[0]] for k, p in zip(keys, parts)}
        done.append(reached)
        known[id(v)] = reached
    return done[0]


def clean(text: str) -> str:
    """Lone surrogates, which JSON escapes can make and Arrow can't hold, become U+FFFD."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return "".join("�" if 0xD800 <= ord(c) <= 0xDFFF else c for c in text)


class Record(NamedTuple):
    """A value with a row of its own: its path, that of the nearest record around it (None at the root), its path without
    positions, whether it is an element of an array that counts as such, and the nearest such element around it."""

    path: str
    parent: str | None
    of: str
    value: Any
    element: bool
    element_parent: str


def records(root: Any, every_outer: bool, lone: Callable[[str, Any], bool]) -> Iterator[Record]:
    """Every record of a value, so that no value is left without one.

    Elements are the objects in arrays, at any depth; with ``every_outer`` also each other non-null element of the
    outer array, and a lone outer object is an array of one. Further records are the root unless it is an array or null, each object that
    ``lone`` accepts with its key, and non-null scalars of an array that is not a field of scalars only.
    """
    root = opened(root)
    if every_outer and isinstance(root, dict):
        root = [root]
    outer = every_outer and isinstance(root, list)
    if root is not None and not isinstance(root, list):
        yield Record("$", None, "", root, False, "$")
    todo: list[tuple[Any, str, str, str, str, bool, bool]] = [(root, "$", "$", "$", "", outer, False)]
    while todo:
        value, path, around, within, of, top, is_field = todo.pop()
        if isinstance(value, dict):
            for k, v in value.items():
                v = opened(v)
                if isinstance(v, (dict, list)):
                    at, kind = f"{path}.{k}", f"{of}.{k}" if of else k
                    row = isinstance(v, dict) and lone(k, v)
                    if row:
                        yield Record(at, around, kind, v, False, within)
                    todo.append((v, at, at if row else around, within, kind, False, True))
        elif isinstance(value, list):
            scalars = not (is_field and is_flat(value))
            for i, v in enumerate(value):
                v = opened(v)
                at, element = f"{path}[{i}]", isinstance(v, dict) or (v is not None and top)
                row = element or (v is not None and scalars and not isinstance(v, list))
                if row:
                    yield Record(at, around, f"{of}[]", v, element, within)
                if isinstance(v, (dict, list)):
                    todo.append((v, at, at if row else around, at if element else within, f"{of}[]", False, False))


def is_flat(values: list) -> bool:
    """True for an array of scalars only."""
    return not any(isinstance(opened(v), (dict, list)) for v in values)
