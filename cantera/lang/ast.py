"""Statements and conditions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Index:
    kind: str
    column: str = ""
    options: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    size: int | None = None
    element: str | None = None
    key: bool = False
    index: Index | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class CreateFromFile:
    table: str
    path: str
    indexes: tuple[Index, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: "Condition | None" = None


@dataclass(frozen=True)
class BuildText:
    table: str
    column: str


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] | None  # None: all
    where: "Condition | None" = None
    order: str | None = None
    descending: bool = False
    limit: int | None = None


class Condition:
    pass


@dataclass(frozen=True)
class Compare(Condition):
    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class Between(Condition):
    column: str
    low: Any
    high: Any


@dataclass(frozen=True)
class Radius(Condition):
    column: str
    point: tuple[float, ...]
    radius: float


@dataclass(frozen=True)
class Nearest(Condition):
    column: str
    point: tuple[float, ...]
    k: int


@dataclass(frozen=True)
class TextMatch(Condition):
    column: str
    query: str


@dataclass(frozen=True)
class Similar(Condition):
    column: str
    file: str


@dataclass(frozen=True)
class Both(Condition):
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Either(Condition):
    left: Condition
    right: Condition


@dataclass
class Result:
    """What a statement gave: type, message, and for a SELECT a lazy DataFrame."""

    type: str
    table: str = ""
    message: str = ""
    data: Any = None
    count: int | None = None
    error: str | None = None
    seconds: float | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def column_types(self) -> dict[str, str]:
        """Names and types of a SELECT's columns."""
        return {} if self.data is None else {f.name: f.dataType.simpleString() for f in self.data.schema}

    def rows(self, array_as_text: bool = False) -> list[dict]:
        if self.data is None:
            return []
        df = self.data
        if array_as_text:
            from cantera.functions.render import arrays_as_text

            df = arrays_as_text(df)
        return [r.asDict() for r in df.collect()]
