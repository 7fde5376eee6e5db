"""Deeply nested records to related flat tables (problem 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions import jsontree as J
from logmill.functions.batches import map_rows
from logmill.plans.skew import first_by

#: Typed subtype tables: record type to its columns. Fields that no column names stay in ``more``.
SUBTYPES: dict[str, dict[str, str]] = {
    "findings": {"id": "string", "asset": "string", "severity": "string", "tags": "array<string>"},
    "steps": {"n": "bigint", "action": "string", "result": "string"},
    "calls": {"path": "string", "status": "bigint"},
    "targets": {"asset": "string", "methods": "array<string>"},
    "notes": {"by": "string", "text": "string"},
    "windows": {"from": "bigint", "to": "bigint"},
    "followups": {"owner": "string", "what": "string"},
    "checks": {"name": "string", "ok": "boolean"},
    "anchors": {"ref": "string", "sha256": "string"},
    "spans": {"from": "bigint", "to": "bigint"},
    "tasks": {"title": "string", "limits.max_requests": "bigint"},
    "outcomes": {"status": "string"},
    "bodies": {"summary": "string", "confidence": "string", "open": "array<string>", "ask": "string", "event": "string", "agent": "string", "role": "string", "model": "string", "model_source": "string"},
}

#: What the states of a subtype have: JSON kinds of the fields it must have, then of those it may have; null fits any.
#: A state with another field is none of its states.
ACCEPTED: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "findings": ({"id": "string", "severity": "string"}, {"asset": "string", "tags": "array", "steps": "array"}),
    "steps": ({"n": "integer", "action": "string"}, {"result": "string", "calls": "array"}),
    "calls": ({"path": "string", "status": "integer"}, {}),
    "targets": ({"asset": "string", "methods": "array"}, {"notes": "array"}),
    "notes": ({"by": "string", "text": "string"}, {}),
    "windows": ({"from": "integer", "to": "integer"}, {}),
    "followups": ({"owner": "string", "what": "string"}, {"checks": "array"}),
    "checks": ({"name": "string", "ok": "boolean"}, {}),
    "anchors": ({"ref": "string", "sha256": "string"}, {"spans": "array"}),
    "spans": ({"from": "integer", "to": "integer"}, {}),
    "tasks": ({"title": "string", "targets": "array"}, {"limits": "object"}),
    "outcomes": ({"status": "string", "followups": "array"}, {}),
}

NODE = "seq bigint, field string, node_path string, parent_path string, record_type string, shape string, element boolean, element_parent string"


def _once(messages: DataFrame) -> DataFrame:
    rows = messages.select("seq", "arrived_at", "data_json", "evidence_json").filter("seq is not null")
    return first_by(rows, ["seq"], ["arrived_at"], ["data_json", "evidence_json"])


def flatten(messages: DataFrame, values: bool = True, elements: bool = False) -> DataFrame:
    """The supertype table: one row for each record of data_json and evidence_json, at any depth.

    (seq, field, node_path, parent_path, record_type, shape, element, element_parent[, fields]). node_path and parent_path
    are the keys that all subtypes keep: the parent is the row of the same seq and field whose node_path is parent_path,
    or the message itself for ``$``. ``shape`` is the state of the tree automaton, ``record_type`` the table that the state
    is routed to (``subtype_of``). ``fields`` holds the record's values as text; what is a record of its own is left to its own row.

    Every value of a valid text is in some row: the body of data_json (``bodies``, node_path ``$`` and no parent_path),
    each object that is an element of an array, each object under a key that names a subtype in singular or plural or
    whose state a subtype accepts, and each non-null scalar among an array's objects or arrays, under the field ''. Other
    lone objects are dotted fields of the row around them. The parent is the nearest of all these. ``element`` marks the
    elements of arrays (of evidence_json's outer array each non-null one, and a lone outer object is an array of one),
    ``element_parent`` the nearest of those; with ``elements`` only they come out.

    Rows with the same seq are one row. A null or invalid text and an empty table give no rows; nothing is bounded by
    depth, length or number of elements.
    """

    def rows(seq: int, data: str | None, evidence: str | None):
        for field, text in (("data_json", data), ("evidence_json", evidence)):
            if text is None:
                continue
            root = J.read_open(text)
            if root is J.INVALID:
                continue
            root, states = J.open_all(root), {}
            router.forget()
            J.state(root, states, router.layers)

            def lone(name: str, value: dict) -> bool:
                return _plural(name) in SUBTYPES or len(router.accepting(states[id(value)])) == 1

            for r in J.records(root, field == "evidence_json", lone):
                if elements and not r.element:
                    continue
                shape = states.get(id(r.value)) or J.state(r.value)
                kind = "bodies" if r.parent is None and field == "data_json" else router.subtype_of(_record_type(r.of, field), shape)
                row = (seq, field, J.clean(r.path), r.parent if r.parent is None else J.clean(r.parent), J.clean(kind), shape, r.element, J.clean(r.element_parent))
                yield (*row, list(_fields(r.value, lone).items())) if values else row

    router = Router()
    return map_rows(_once(messages), ["seq", "data_json", "evidence_json"], NODE + (", fields map<string,string>" if values else ""), rows)


def elements(nodes: DataFrame) -> DataFrame:
    """(seq, field, node_path, parent_path) of the elements of arrays alone, each with the nearest one around it."""
    return nodes.filter("element").select("seq", "field", "node_path", F.col("element_parent").alias("parent_path"))


def _plural(name: str) -> str:
    return f"{name}s" if name not in SUBTYPES and f"{name}s" in SUBTYPES else name


class Router:
    """From states to subtypes: which subtypes accept a state is decided once, by the layer its last transition read."""

    #: States that are remembered; there are as many as shapes, so rare ones may come and go.
    MOST = 100_000

    def __init__(self):
        self.layers: dict[str, dict[str, str]] = {}
        self._accepting: dict[str, tuple[str, ...]] = {}

    def forget(self) -> None:
        """Begin anew where there are too many states; those of the next value are met again."""
        if len(self.layers) > self.MOST:
            self.layers.clear()
            self._accepting.clear()

    def accepting(self, shape: str) -> tuple[str, ...]:
        found = self._accepting.get(shape)
        if found is None:
            found = self._accepting[shape] = accepting(self.layers[shape]) if shape[0] == "o" else ()
        return found

    def subtype_of(self, name: str, shape: str) -> str:
        """The table of a record: the one subtype that accepts its state; of several the one its name says.

        Where no subtype accepts the state, or several do and the name says none of them, the name decides alone. A
        name that is no subtype's goes to the records of no known type.
        """
        fits, named = self.accepting(shape), _plural(name)
        return fits[0] if len(fits) == 1 else named


def accepting(kinds: dict[str, str]) -> tuple[str, ...]:
    """The subtypes that accept a state with these fields and kinds."""

    def fits(must: dict[str, str], may: dict[str, str]) -> bool:
        return must.keys() <= kinds.keys() <= must.keys() | may.keys() and all(kinds[k] in (t, "null") for k, t in (must | may).items() if k in kinds)

    return tuple(name for name, (must, may) in ACCEPTED.items() if fits(must, may))


def _record_type(of: str, field: str) -> str:
    """The field that holds the array; the outer array of evidence_json holds anchors."""
    name = of.replace("[]", "").rpartition(".")[2]
    return name or ("anchors" if field == "evidence_json" else "items")


def _fields(value: object, lone: Callable[[str, dict], bool]) -> dict[str, str | None]:
    """Values by dotted name; arrays of scalars as JSON, arrays with objects and records of their own left out."""
    if not isinstance(value, dict):
        return {"": J.text_of(value) if value is None else J.clean(J.text_of(value))}
    out: dict[str, str | None] = {}
    todo = [("", value)]
    while todo:
        at, v = todo.pop()
        for k, x in v.items():
            x, name = J.opened(x), J.clean(f"{at}{k}")
            if isinstance(x, dict):
                if not lone(k, x):
                    todo.append((f"{name}.", x))
            elif not (isinstance(x, list) and not J.is_flat(x)):
                out[name] = J.clean(t) if (t := J.text_of(x)) is not None else None
    return out


def shapes(nodes: DataFrame) -> DataFrame:
    """(field, record_type, shape, n_records): the variants there are of each record type."""
    return nodes.groupBy("field", "record_type", "shape").agg(F.count(F.lit(1)).alias("n_records"))


def _typed(name: str, kind: str) -> Column:
    text = F.element_at("fields", F.lit(name))
    return F.from_json(text, kind) if kind.startswith("array") else text.try_cast(kind)


def subtype(nodes: DataFrame, record_type: str) -> DataFrame:
    """The typed table of one record type: the common keys, its columns and ``more`` for all other fields.

    A value that does not fit its column's type is null there and kept as text in ``more``.
    """
    columns = SUBTYPES[record_type]
    typed = {n: _typed(n, t) for n, t in columns.items()}
    more = F.map_filter("fields", lambda k, v: ~F.when(k.isin(*columns), F.coalesce(*[F.when(k == n, c.isNotNull() | v.isNull()) for n, c in typed.items()])).otherwise(F.lit(False)))
    return nodes.filter(F.col("record_type") == record_type).select("seq", "field", "node_path", "parent_path", "shape", *[c.alias(n.replace(".", "_")) for n, c in typed.items()], more.alias("more"))


def route(nodes: DataFrame) -> dict[str, DataFrame]:
    """Every typed subtype table, and under '' the records of no known type with their fields."""
    return {name: subtype(nodes, name) for name in SUBTYPES} | {"": others(nodes)}


def others(nodes: DataFrame) -> DataFrame:
    """The records of no known type."""
    return nodes.filter(~F.col("record_type").isin(*SUBTYPES))
