"""Conditions to DataFrame operators: names and types are checked first, then each leaf becomes a predicate or a small table of keys."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.lang import ast
from cantera.operators import spatial
from cantera.sources.catalog import DataFile, Table, coordinates_of


class BindProblem(ValueError):
    """A condition does not fit the table."""


NUMBERS, STRINGS = {"INT", "BIGINT", "FLOAT"}, {"VARCHAR", "TEXT", "IMAGE", "AUDIO"}
#: Rows of a search's result that are sent to every task.
BROADCAST_ROWS = 1000


class Binder:
    """Conditions over `base`, rows of the table. leaf(condition, limit) gives the rows of a text or similarity search: key, and _score or _distance; kth(column, point, k) the distance of the k-th nearest row of the whole table, negative if there is none."""

    def __init__(self, table: Table, base: DataFrame, leaf: Callable[[ast.Condition, int | None], DataFrame], strict: bool = True, kth: Callable[[str, tuple, int], float] | None = None):
        self.table, self.base, self.leaf, self.strict = table, base, leaf, strict
        self.kth = kth or (lambda column, point, k: spatial.kth_distance(base, column, point, k)[1])
        self.searches: list[DataFrame] = []

    def bind(self, condition: ast.Condition | None, limit: int | None = None) -> DataFrame:
        """The rows that meet the condition. A search for nearest or best rows looks at the whole table, whatever it is combined with; a limit goes into it only when it stands alone."""
        if condition is None:
            return self.base
        if isinstance(condition, (ast.TextMatch, ast.Similar)):
            self.table.column(condition.column)
            return self.base.join(F.broadcast(self.leaf(condition, limit)) if limit is not None and limit <= BROADCAST_ROWS else self.leaf(condition, limit), self.table.key)
        predicate = self.predicate(condition)
        df = self.base
        for i, found in enumerate(self.searches):
            scores = [c for c in found.columns if c != self.table.key]
            renamed = found.withColumnsRenamed({c: f"__{c}_{i}" for c in scores}).withColumn(f"__hit_{i}", F.lit(True))
            df = df.join(renamed, self.table.key, "left")
        df = df.filter(predicate)
        for name in ("_score", "_distance"):
            held = [F.col(f"__{name}_{i}") for i, found in enumerate(self.searches) if name in found.columns]
            if held:
                df = df.withColumn(name, F.coalesce(*held))
        return df.drop(*[f"__{c}_{i}" for i, found in enumerate(self.searches) for c in (*found.columns, "hit")])

    def predicate(self, c: ast.Condition) -> Column:
        if isinstance(c, ast.Both):
            return self.predicate(c.left) & self.predicate(c.right)
        if isinstance(c, ast.Either):
            return self.predicate(c.left) | self.predicate(c.right)
        column = self.table.column(c.column)
        if isinstance(c, (ast.TextMatch, ast.Similar)):
            self.searches.append(self.leaf(c, None))
            return F.coalesce(F.col(f"__hit_{len(self.searches) - 1}"), F.lit(False))
        if isinstance(c, (ast.Radius, ast.Nearest)):
            self._point(column, c.point)
            # The k nearest with their ties are the rows within the k-th's distance: a predicate like any other.
            radius = c.radius if isinstance(c, ast.Radius) else self.kth(c.column, c.point, c.k)
            stored = coordinates_of(column) if column in self.table.points else []
            box = spatial.in_box([F.col(f"`{n}`") for n in stored], c.point, radius) if set(stored) <= set(self.base.columns) else F.lit(True)
            return box & spatial.within(c.column, c.point, radius)
        if isinstance(c, ast.Between):
            self._ordered(column, "BETWEEN")
            return self._cell(column).between(self._literal(column, c.low), self._literal(column, c.high))
        if c.op not in ("=", "!="):
            self._ordered(column, c.op)
        cell, value = self._cell(column), self._literal(column, c.value)
        return {"=": cell == value, "!=": cell != value, "<": cell < value, "<=": cell <= value, ">": cell > value, ">=": cell >= value}[c.op]

    def may_match(self, c: ast.Condition | None, f: DataFile) -> bool:
        """Whether a file with these bounds can hold a row that meets the condition."""
        if isinstance(c, ast.Both):
            return self.may_match(c.left, f) and self.may_match(c.right, f)
        if isinstance(c, ast.Either):
            return self.may_match(c.left, f) or self.may_match(c.right, f)
        if c is None or c.column not in f.bounds or isinstance(c, (ast.TextMatch, ast.Similar)):
            return True
        n, low, high = f.bounds[c.column]
        if not n:
            return False
        if isinstance(c, (ast.Radius, ast.Nearest)):
            radius = c.radius if isinstance(c, ast.Radius) else self.kth(c.column, c.point, c.k)
            return spatial.box_distance(low, high, c.point) <= radius
        column = self.table.column(c.column)
        if column.type == "ARRAY":
            return True
        first, last = (c.low, c.high) if isinstance(c, ast.Between) else (c.value, c.value)
        first, last = (v.isoformat() if isinstance(v, datetime.date) else v for v in (coerce(column, first, exact=False), coerce(column, last, exact=False)))
        if isinstance(c, ast.Between):
            return first <= high and last >= low
        return {"=": low <= first <= high, "!=": True, "<": low < first, "<=": low <= first, ">": high > first, ">=": high >= first}[c.op]

    def check(self, c: ast.Condition | None) -> None:
        """Raises what predicate() would, without looking at any row."""
        if c is None:
            return
        kth, leaf, searches = self.kth, self.leaf, self.searches
        self.kth, self.leaf, self.searches = (lambda *_: 0.0), (lambda *_: self.base), []
        try:
            self.predicate(c)
        finally:
            self.kth, self.leaf, self.searches = kth, leaf, searches

    def _ordered(self, column: ast.ColumnDef, op: str) -> None:
        if self.strict and column.index and column.index.kind == "HASH":
            raise BindProblem(f"{op} on {column.name}: a HASH index doesn't support ranges")
        if column.type == "ARRAY":
            raise BindProblem(f"{op} on {column.name}: arrays have no order")

    def _point(self, column: ast.ColumnDef, point: tuple) -> None:
        if column.type != "ARRAY" or column.element == "DATE":
            raise BindProblem(f"{column.name} holds no points")
        if column.size != len(point):
            raise BindProblem(f"{column.name} has {column.size} dimensions, the point has {len(point)}")

    def _cell(self, column: ast.ColumnDef) -> Column:
        cell = F.col(f"`{column.name}`")
        return cell.cast("double") if column.type == "FLOAT" else cell

    def _literal(self, column: ast.ColumnDef, value: Any) -> Column:
        try:
            return F.lit(coerce(column, value, exact=False)) if column.type != "ARRAY" else F.array(*[F.lit(x) for x in coerce(column, value, exact=False)])
        except (TypeError, ValueError) as e:
            raise BindProblem(f"{column.name} is {column.type}; {value!r} doesn't fit: {e}") from None


def coerce(column: ast.ColumnDef, value: Any, exact: bool = True) -> Any:
    """A literal as a value of the column. exact: as it is stored, with strings cut to their size; else only for comparison, where an INT may meet 2.5."""
    if column.type in NUMBERS:
        if isinstance(value, (str, tuple)):
            raise TypeError("not a number")
        if column.type == "FLOAT":
            return float(value)
        if exact:
            if value != int(value):
                raise ValueError("not a whole number")
            value = int(value)
            if column.type == "INT" and not -(2**31) <= value < 2**31:
                raise ValueError("out of the range of INT")
        return value
    if column.type == "DATE":
        if not isinstance(value, str):
            raise TypeError("not a date")
        return datetime.date.fromisoformat(value)
    if column.type == "ARRAY":
        if not isinstance(value, tuple):
            raise TypeError("not an array")
        if len(value) != column.size:
            raise ValueError(f"needs {column.size} elements")
        if column.element == "INT" and any(isinstance(x, str) or x != int(x) for x in value):
            raise ValueError("not whole numbers")
        kind = {"INT": int, "FLOAT": float, "DATE": datetime.date.fromisoformat}[column.element]
        return [kind(x) for x in value]
    if not isinstance(value, str):
        raise TypeError("not a string")
    return (value[: column.size] if exact and column.size else value).rstrip()
