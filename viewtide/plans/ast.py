"""The query tree: dataclasses, JSON in and out, and a small builder."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from viewtide.errors import QueryError


@dataclass(frozen=True)
class Operand:
    """kind is column (name), literal (value) or static (anchor, path): a value bound before compilation."""

    kind: str
    name: str = ""
    value: Any = None
    anchor: str = ""
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Simple:
    op: str
    left: Operand
    right: Operand


@dataclass(frozen=True)
class Bool:
    """kind is and / or. An empty and is true, an empty or is false."""

    kind: str
    parts: tuple = ()


@dataclass(frozen=True)
class Edge:
    """A correlated subquery: parent_fields[i] = child_fields[i]."""

    parent_fields: tuple[str, ...]
    child_fields: tuple[str, ...]
    query: "Query"
    system: str = ""
    hidden: bool = False

    def __post_init__(self):
        if len(self.parent_fields) != len(self.child_fields) or not self.parent_fields:
            raise QueryError("a correlation needs as many parent fields as child fields")


@dataclass(frozen=True)
class Exists:
    """EXISTS / NOT EXISTS. uid tells the conditions of one query apart and is set by the rewriter."""

    edge: Edge
    negated: bool = False
    flip: bool = False
    scalar: bool = False
    uid: str = ""


@dataclass(frozen=True)
class Cursor:
    row: dict
    exclusive: bool = False


@dataclass(frozen=True)
class Query:
    table: str
    alias: str = ""
    where: Any = None
    related: tuple[Edge, ...] = ()
    order_by: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    start: Cursor | None = None

    def __post_init__(self):
        if self.limit is not None and self.limit < 0:
            raise QueryError("limit must not be negative")
        for _, way in self.order_by:
            if way not in ("asc", "desc"):
                raise QueryError(f"unknown direction {way!r}")


def parse_query(doc: dict) -> Query:
    """A query from its JSON form."""
    start = doc.get("start")
    return Query(
        table=doc["table"],
        alias=doc.get("alias") or "",
        where=_condition(doc["where"]) if doc.get("where") else None,
        related=tuple(_edge(x) for x in doc.get("related") or ()),
        order_by=tuple((c, d) for c, d in doc.get("orderBy") or ()),
        limit=doc.get("limit"),
        start=Cursor(dict(start["row"]), bool(start.get("exclusive"))) if start else None,
    )


def _edge(doc: dict) -> Edge:
    c = doc["correlation"]
    return Edge(tuple(c["parentField"]), tuple(c["childField"]), parse_query(doc["subquery"]), doc.get("system") or "", bool(doc.get("hidden")))


def _condition(doc: dict):
    kind = doc.get("type")
    if kind == "simple":
        return Simple(doc["op"], _operand(doc["left"]), _operand(doc["right"]))
    if kind in ("and", "or"):
        return Bool(kind, tuple(_condition(x) for x in doc.get("conditions") or ()))
    if kind == "correlatedSubquery":
        if doc.get("op") not in ("EXISTS", "NOT EXISTS"):
            raise QueryError(f"unknown subquery operator {doc.get('op')!r}")
        return Exists(_edge(doc["related"]), doc["op"] == "NOT EXISTS", bool(doc.get("flip")), bool(doc.get("scalar")))
    raise QueryError(f"unknown condition type {kind!r}")


def _operand(doc: dict) -> Operand:
    kind = doc.get("type")
    if kind == "column":
        return Operand("column", name=doc["name"])
    if kind == "literal":
        return Operand("literal", value=doc.get("value"))
    if kind == "static":
        path = doc.get("field")
        return Operand("static", anchor=doc.get("anchor", ""), path=(path,) if isinstance(path, str) else tuple(path or ()))
    raise QueryError(f"unknown operand type {kind!r}")


def to_json(node) -> dict:
    """The JSON form of a query or condition."""
    if isinstance(node, Query):
        out: dict = {"table": node.table}
        if node.alias:
            out["alias"] = node.alias
        if node.where is not None:
            out["where"] = to_json(node.where)
        if node.related:
            out["related"] = [to_json(x) for x in node.related]
        if node.order_by:
            out["orderBy"] = [list(x) for x in node.order_by]
        if node.limit is not None:
            out["limit"] = node.limit
        if node.start:
            out["start"] = {"row": node.start.row, "exclusive": node.start.exclusive}
        return out
    if isinstance(node, Edge):
        out = {"correlation": {"parentField": list(node.parent_fields), "childField": list(node.child_fields)}, "subquery": to_json(node.query)}
        return out | ({"system": node.system} if node.system else {}) | ({"hidden": True} if node.hidden else {})
    if isinstance(node, Simple):
        return {"type": "simple", "op": node.op, "left": to_json(node.left), "right": to_json(node.right)}
    if isinstance(node, Bool):
        return {"type": node.kind, "conditions": [to_json(x) for x in node.parts]}
    if isinstance(node, Exists):
        out = {"type": "correlatedSubquery", "op": "NOT EXISTS" if node.negated else "EXISTS", "related": to_json(node.edge)}
        return out | ({"flip": True} if node.flip else {}) | ({"scalar": True} if node.scalar else {})
    if isinstance(node, Operand):
        if node.kind == "column":
            return {"type": "column", "name": node.name}
        if node.kind == "literal":
            return {"type": "literal", "value": node.value}
        return {"type": "static", "anchor": node.anchor, "field": list(node.path)}
    raise TypeError(type(node))


# --- builder -----------------------------------------------------------------


def col(name: str) -> Operand:
    return Operand("column", name=name)


def lit(value) -> Operand:
    return Operand("literal", value=value)


def cmp(left, op: str, right) -> Simple:
    """A comparison; a str on the left is a column, a plain value on the right a literal."""
    left = col(left) if isinstance(left, str) else left
    return Simple(op, left, right if isinstance(right, Operand) else lit(right))


def and_(*parts) -> Bool:
    return Bool("and", parts)


def or_(*parts) -> Bool:
    return Bool("or", parts)


def _on(on) -> tuple[tuple[str, ...], tuple[str, ...]]:
    pairs = [on] if isinstance(on, tuple) else list(on)
    return tuple(p for p, _ in pairs), tuple(c for _, c in pairs)


def exists(query: Query, on, **more) -> Exists:
    """on: (parent field, child field), or a list of such pairs."""
    system = more.pop("system", "")
    return Exists(Edge(*_on(on), query, system), **more)


def not_exists(query: Query, on, **more) -> Exists:
    return exists(query, on, negated=True, **more)


@dataclass(frozen=True)
class Builder:
    query: Query = field(default_factory=lambda: Query(""))

    def where(self, *parts) -> "Builder":
        have = () if self.query.where is None else (self.query.where,)
        every = have + parts
        return Builder(replace(self.query, where=every[0] if len(every) == 1 else and_(*every)))

    def order(self, *by) -> "Builder":
        """Names, or names with a leading minus for descending order."""
        return Builder(replace(self.query, order_by=tuple((x.lstrip("-"), "desc" if x[0] == "-" else "asc") for x in by)))

    def limit(self, n: int) -> "Builder":
        return Builder(replace(self.query, limit=n))

    def start(self, row: dict, exclusive: bool = False) -> "Builder":
        return Builder(replace(self.query, start=Cursor(row, exclusive)))

    def related(self, other: "Builder | Query", on, alias: str = "", system: str = "") -> "Builder":
        child = other.query if isinstance(other, Builder) else other
        child = replace(child, alias=alias) if alias else child
        return Builder(replace(self.query, related=(*self.query.related, Edge(*_on(on), child, system))))

    def exists(self, other: "Builder | Query", on, **more) -> "Builder":
        return self.where(exists(other.query if isinstance(other, Builder) else other, on, **more))

    def not_exists(self, other: "Builder | Query", on, **more) -> "Builder":
        return self.exists(other, on, negated=True, **more)


def q(table: str) -> Builder:
    return Builder(Query(table))
