"""Errors that the engine raises."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    """The query is malformed, or names a table or column that does not exist."""


class EngineClosedError(RuntimeError):
    """The engine was closed."""


class EpochError(RuntimeError):
    """The caller's init epoch is not the current one."""

    code = -32101


@dataclass
class DriftError(Exception):
    """A change contradicts the base state: an add of a present key, or an edit or removal of an absent one."""

    table: str
    op: str
    key: dict = field(default_factory=dict)
    code = -32100

    def __str__(self) -> str:
        return f"drift in {self.table}: {self.op} of {self.key}"
