"""Conditions and cursors as Columns.

Three relations are kept apart: equality that coerces numeric text (=, !=, IS, IS NOT),
plain equality (IN and joins), and order (<, >, cursors), where null is lowest.
A condition has two forms: a flag is true or false, never null; a filter may be null where the flag is false, which a
WHERE takes alike (the tree has no NOT above its leaves). Filters are bare comparisons of a column with a literal of its own type wherever that
says the same, as only those reach a scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.errors import QueryError
from viewtide.plans.ast import Bool, Cursor, Exists, Operand, Simple

NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.StringType):
        return "string"
    return "time" if isinstance(dtype, _TIME) else "other"


def literal_kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "list" if isinstance(value, (list, tuple)) else "time"


def _resolve(x: Operand, spec) -> tuple[Column, str, object]:
    """Column, kind, and the value if it is a literal, else the column's type."""
    if x.kind == "column":
        return F.col(f"`{x.name}`"), "json" if x.name in spec.json_columns else kind_of(spec.type_of(x.name)), spec.type_of(x.name)
    if x.kind == "literal":
        kind = literal_kind(x.value)
        return (F.lit(None) if kind == "list" else F.lit(x.value)), kind, x.value
    raise QueryError(f"static operand {x.anchor}.{'.'.join(x.path)} must be bound before the query is compiled")


def typed(value, dtype: T.DataType) -> Column:
    """A literal of a column's type where that holds the value exactly, so that no cast stands around the column."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and isinstance(value, (int, float)) and not isinstance(value, bool):
        whole = int(value) if isinstance(value, int) or (value == value and abs(value) < 2**53 and value.is_integer()) else None
        bits = {"ByteType": 7, "ShortType": 15, "IntegerType": 31, "LongType": 63}[type(dtype).__name__]
        return F.lit(whole).cast(dtype) if whole is not None and -(1 << bits) <= whole < 1 << bits else F.lit(value)
    if isinstance(dtype, (T.DoubleType, T.FloatType)) and isinstance(value, int) and not isinstance(value, bool) and abs(value) < 2**53 and isinstance(dtype, T.DoubleType):
        return F.lit(float(value))
    return F.lit(value)


def _as_time(text: Column, other: T.DataType) -> Column:
    """A text as the time that it is compared with: of the column's own type where that has a time of day."""
    return text.try_cast(other if isinstance(other, (T.TimestampType, T.TimestampNTZType)) else T.TimestampType())


def _identical(l: Column, lk: str, lv, r: Column, rk: str, rv) -> Column:
    """Equality of two values, null where either is null; a number equals the text of that number."""
    if "json" in (lk, rk):
        raise QueryError("JSON columns can only be compared with IS / IS NOT null")
    if lk == rk:
        if lk == "number" and isinstance(lv, T.DataType) != isinstance(rv, T.DataType):
            return l == typed(rv, lv) if isinstance(lv, T.DataType) else typed(lv, rv) == r
        return l == r
    if {lk, rk} == {"number", "string"}:
        (text, tv), (number, nv) = ((l, lv), (r, rv)) if lk == "string" else ((r, rv), (l, lv))
        if isinstance(tv, str) and isinstance(nv, T.DataType):
            if not re.match(NUMERIC_TEXT, tv):
                return F.when(number.isNotNull(), F.lit(False))
            return number == typed(float(tv), nv) if abs(float(tv)) < 2**53 else number.cast("double") == F.lit(float(tv))
        return F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double")) == number.cast("double")
    if {lk, rk} == {"time", "string"}:
        text, time, kind = (l, r, rv) if lk == "string" else (r, l, lv)
        return _as_time(text, kind) == time
    return F.lit(False)


def like_regex(pattern: str) -> str:
    """A LIKE pattern (only % and _ are special, there is no escape character) as a regular expression."""
    return "(?s)^" + "".join(".*" if c == "%" else "." if c == "_" else re.sub(r"([^\w\s])", r"\\\1", c) for c in pattern) + "$"


def _like(l: Column, lk: str, r: Column, rk: str, value, fold: bool) -> Column:
    for k in (lk, rk):
        if k not in ("string", "number", "boolean"):
            raise QueryError(f"LIKE takes strings, not {k}")
    text = l if lk == "string" else l.cast("string")
    if not isinstance(value, T.DataType):
        pattern, inner = str(value), str(value).strip("%")
        if not fold and lk == "string" and "%" not in inner and "_" not in inner and inner:  # a scan knows these
            open_, close = pattern.startswith("%"), pattern.endswith("%")
            return text.contains(inner) if open_ and close else text.endswith(inner) if open_ else text.startswith(inner) if close else text == inner
        return (F.lower(text) if fold else text).rlike(like_regex(pattern.lower() if fold else pattern))
    text = F.lower(text) if fold else text
    pattern = F.lower(r.cast("string")) if fold else r.cast("string")
    quoted = F.regexp_replace(pattern, r"([^\w\s%])", r"\\$1")
    quoted = F.regexp_replace(F.regexp_replace(quoted, "%", ".*"), "_", ".")
    return F.regexp_like(text, F.concat(F.lit("(?s)^"), quoted, F.lit("$")))


def _members(l: Column, lk: str, dtype, values) -> Column | None:
    """Membership with plain equality: nulls and values of another kind never match. None where nothing can."""
    same = [v for v in values if literal_kind(v) == lk or (lk == "time" and literal_kind(v) == "string")]
    if not same:
        return None
    if not isinstance(dtype, T.DataType):
        return l.isin(same)
    return l.isin([_as_time(F.lit(v), dtype) if lk == "time" and isinstance(v, str) else typed(v, dtype) for v in same])


def simple(cond: Simple, spec, flag: bool = True) -> Column:
    """A comparison as a flag, or as a filter."""
    (l, lk, lv), (r, rk, rv), op = _resolve(cond.left, spec), _resolve(cond.right, spec), cond.op
    sure = (lambda c: F.coalesce(c, F.lit(False))) if flag else (lambda c: c)
    both = l.isNotNull() & r.isNotNull()
    if op in ("IN", "NOT IN"):
        if rk != "list":
            return F.lit(False) if op == "IN" else both
        member = _members(l, lk, lv, rv)
        if member is None:
            return F.lit(False) if op == "IN" else l.isNotNull()
        return sure(member if op == "IN" else ~member)
    if "list" in (lk, rk):
        raise QueryError(f"{op} does not take a list")
    if op in ("IS", "IS NOT"):
        if "null" in (lk, rk):
            return (l if rk == "null" else r).isNull() if op == "IS" else (l if rk == "null" else r).isNotNull()
        one = any(not isinstance(v, T.DataType) for v in (lv, rv))  # a literal is not null: only the other side may be
        same = _identical(l, lk, lv, r, rk, rv)
        if op == "IS":
            return sure(same) if one else F.coalesce(same, F.lit(False)) | (l.isNull() & r.isNull())
        return ~(F.coalesce(same, F.lit(False)) | (l.isNull() & r.isNull()))
    if op not in ("=", "!=", "<", ">", "<=", ">=", "LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE"):
        raise QueryError(f"unknown operator {op!r}")
    if "null" in (lk, rk):
        return F.lit(False)
    if op == "=":
        return sure(_identical(l, lk, lv, r, rk, rv))
    if op == "!=":
        same = _identical(l, lk, lv, r, rk, rv)
        return sure(~same) if lk == rk else both & ~F.coalesce(same, F.lit(False))
    if op.endswith("LIKE"):
        hit = _like(l, lk, r, rk, rv, "ILIKE" in op)
        return sure(~hit) if op.startswith("NOT") and not isinstance(rv, T.DataType) else both & ~F.coalesce(hit, F.lit(False)) if op.startswith("NOT") else sure(hit)
    if lk != rk and {lk, rk} == {"time", "string"}:
        l, r = (_as_time(l, rv), r) if lk == "string" else (l, _as_time(r, lv))
    elif lk != rk or lk in ("json", "other"):
        raise QueryError(f"{op} between {lk} and {rk}")
    elif lk == "number" and isinstance(lv, T.DataType) != isinstance(rv, T.DataType):
        l, r = (l, typed(rv, lv)) if isinstance(lv, T.DataType) else (typed(lv, rv), r)
    return sure({"<": l < r, ">": l > r, "<=": l <= r, ">=": l >= r}[op])


def condition(cond, spec, flags: dict[str, Column] | None = None) -> Column:
    """A whole condition: a filter, or with flags (the Column of each EXISTS by its uid) a flag."""
    if cond is None:
        return F.lit(True)
    if isinstance(cond, Simple):
        return simple(cond, spec, flags is not None)
    if isinstance(cond, Bool):
        parts = [condition(x, spec, flags) for x in cond.parts]
        if cond.kind == "and":
            return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
    if isinstance(cond, Exists):
        return flags[cond.uid]
    raise QueryError(f"unknown condition {cond!r}")


# --- order and cursors ---------------------------------------------------------


def sort_columns(order) -> list[Column]:
    """Nulls are lowest: first ascending, last descending."""
    return [F.col(f"`{c}`").asc_nulls_first() if way == "asc" else F.col(f"`{c}`").desc_nulls_last() for c, way in order]


def after_cursor(cursor: Cursor, order, spec) -> Column:
    """Rows at or after the cursor (after it, if exclusive). Comparison ends at the first sort column that the cursor lacks.

    A bound on the first column stands before the rest, which says it again: it is what a scan can use.
    """
    prefix = []
    for c, way in order:
        if c not in cursor.row:
            break
        prefix.append((c, way, spec.normalize_value(c, cursor.row[c])))
    def value(c, v):
        return F.lit(v).cast(spec.type_of(c))
    same = [F.col(f"`{c}`").eqNullSafe(value(c, v)) for c, _, v in prefix]
    strict = F.lit(False)
    for i, (c, way, v) in enumerate(prefix):
        x = F.col(f"`{c}`")
        if way == "asc":
            later = x.isNotNull() if v is None else x > value(c, v)
        else:
            later = F.lit(False) if v is None else (x < value(c, v)) | x.isNull()
        strict = strict | reduce(lambda a, b: a & b, same[:i], F.coalesce(later, F.lit(False)))
    out = strict if cursor.exclusive else strict | reduce(lambda a, b: a & b, same, F.lit(True))
    if prefix and prefix[0][2] is not None:
        c, way, v = prefix[0]
        x = F.col(f"`{c}`")
        out = ((x >= value(c, v)) if way == "asc" else (x <= value(c, v)) | x.isNull()) & out
    return out
