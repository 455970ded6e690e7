"""Rewrites of the query tree before it is compiled."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any, Callable

from viewtide.errors import QueryError
from viewtide.plans.ast import Bool, Edge, Exists, Operand, Query, Simple

ALWAYS_FALSE = Simple("=", Operand("literal", value=1), Operand("literal", value=0))
#: Matched rows of an EXISTS that are handed out for each correlation key.
EXISTS_ROWS = 3


def complete_order(query: Query, spec) -> tuple[tuple[str, str], ...]:
    """The ordering with the primary key's missing columns, ascending."""
    have = {c for c, _ in query.order_by}
    for c in have:
        spec.type_of(c)
    return (*query.order_by, *((c, "asc") for c in spec.primary_key if c not in have))


def bind_static(node, values: dict[str, Any]):
    """The tree with static operands replaced by values[anchor][path...]; an absent value is null."""
    if isinstance(node, Query):
        return replace(node, where=bind_static(node.where, values), related=tuple(bind_static(x, values) for x in node.related))
    if isinstance(node, Edge):
        return replace(node, query=bind_static(node.query, values))
    if isinstance(node, Bool):
        return replace(node, parts=tuple(bind_static(x, values) for x in node.parts))
    if isinstance(node, Exists):
        return replace(node, edge=bind_static(node.edge, values))
    if isinstance(node, Simple):
        return replace(node, left=bind_static(node.left, values), right=bind_static(node.right, values))
    if isinstance(node, Operand) and node.kind == "static":
        if node.anchor not in values:
            raise QueryError(f"no values for static anchor {node.anchor!r}")
        found: Any = values[node.anchor]
        for step in node.path:
            found = found.get(step) if isinstance(found, dict) else None
        return Operand("literal", value=found)
    return node


def label_exists(query: Query, passthrough_flip: bool = False) -> Query:
    """The query, at every level, with a uid on each EXISTS in the order of traversal."""
    count = 0

    def walk(cond):
        nonlocal count
        if isinstance(cond, Bool):
            return replace(cond, parts=tuple(walk(x) for x in cond.parts))
        if isinstance(cond, Exists):
            if cond.flip and passthrough_flip:
                return Bool("and")
            uid, count = f"{cond.edge.query.alias or cond.edge.query.table}_{count}", count + 1
            return replace(cond, uid=uid, edge=replace(cond.edge, query=label_exists(cond.edge.query, passthrough_flip)))
        return cond

    where = walk(query.where)
    return replace(query, where=where, related=tuple(replace(e, query=label_exists(e.query, passthrough_flip)) for e in last_of_alias(query.related)))


def last_of_alias(edges) -> tuple[Edge, ...]:
    """Of edges with the same alias the last one, at the place of the first."""
    by: dict[str, Edge] = {}
    for i, e in enumerate(edges):
        by[e.query.alias or e.query.table if e.query.alias or e.query.table else str(i)] = e
    return tuple(by.values())


def exists_of(cond) -> list[Exists]:
    if isinstance(cond, Exists):
        return [cond]
    return [x for p in cond.parts for x in exists_of(p)] if isinstance(cond, Bool) else []


def conjuncts(cond) -> list:
    """The parts of a condition that must all hold."""
    if cond is None:
        return []
    if isinstance(cond, Bool) and cond.kind == "and":
        return [x for p in cond.parts for x in conjuncts(p)]
    return [cond]


def split_keys(query: Query, own: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Columns that, when edited, replace the row and its subtree: those that any correlation of the row uses."""
    found = [*own]
    for e in [x.edge for x in exists_of(query.where)] + list(query.related):
        found += e.parent_fields
    return tuple(dict.fromkeys(found))


def tables_of(query: Query) -> set[str]:
    edges = [x.edge for x in exists_of(query.where)] + list(query.related)
    return {query.table}.union(*(tables_of(e.query) for e in edges))


# --- scalar subqueries -----------------------------------------------------------


@dataclass(frozen=True)
class Companion:
    """A scalar subquery that was evaluated: its query, the value, and whether a row matched."""

    query: Query
    value: Any
    matched: bool


def pinned_columns(cond) -> set[str]:
    """Columns that a conjunct equates with a literal."""
    return {x.left.name for x in conjuncts(cond) if isinstance(x, Simple) and x.op == "=" and x.left.kind == "column" and x.right.kind == "literal"}


def is_simple(query: Query, unique_keys) -> bool:
    """Whether the query yields one row at most, as literals pin a unique key."""
    pinned = pinned_columns(query.where)
    return any(key and set(key) <= pinned for key in unique_keys)


def resolve_scalars(query: Query, keys_of: Callable[[str], tuple], fetch: Callable[[Query, str], tuple[Any, bool]]) -> tuple[Query, list[Companion]]:
    """The query with each simple scalar EXISTS replaced by a comparison with the value found, innermost first.

    EXISTS becomes field = value and NOT EXISTS field IS NOT value; with no row, or a null, both become false.
    """
    companions: list[Companion] = []

    def of_query(x: Query) -> Query:
        return replace(x, where=of_condition(x.where), related=tuple(replace(e, query=of_query(e.query)) for e in x.related))

    def of_condition(cond):
        if isinstance(cond, Bool):
            return replace(cond, parts=tuple(of_condition(p) for p in cond.parts))
        if not isinstance(cond, Exists):
            return cond
        inner = of_query(cond.edge.query)
        if not cond.scalar or not is_simple(inner, keys_of(inner.table)):
            return replace(cond, edge=replace(cond.edge, query=inner))
        value, matched = fetch(inner, cond.edge.child_fields[0])
        companions.append(Companion(inner, value, matched))
        if not matched or value is None:
            return ALWAYS_FALSE
        return Simple("IS NOT" if cond.negated else "=", Operand("column", name=cond.edge.parent_fields[0]), Operand("literal", value=value))

    return of_query(query), companions
