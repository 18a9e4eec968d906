"""Radius and nearest-neighbour search around one point, in any number of dimensions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coordinates(column: str | Column, n: int) -> list[Column]:
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return [F.get(c, F.lit(i)).cast("double") for i in range(n)]


def distance(column: str | Column, point: Sequence[float]) -> Column:
    """Euclidean distance to a point; null for null or shorter arrays."""
    terms = [(c - F.lit(float(p))) * (c - F.lit(float(p))) for c, p in zip(coordinates(column, len(point)), point)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.sqrt(total)


def in_box(coords: Sequence[Column], point: Sequence[float], radius: float) -> Column:
    """Plain comparisons that hold for every point at most radius away. On stored coordinates they reach the scan."""
    reach = radius + 1e-9 * max(1.0, radius, *(abs(float(p)) for p in point))
    box = F.lit(True)
    for c, p in zip(coords, point):
        box = box & c.between(float(p) - reach, float(p) + reach)
    return box


def within(column: str | Column, point: Sequence[float], radius: float) -> Column:
    """Predicate: at most radius away, bound included. The bounding box comes first, as plain comparisons."""
    return in_box(coordinates(column, len(point)), point, radius) & (distance(column, point) <= radius)


def same_point(column: str | Column, point: Sequence[float], epsilon: float = 1e-9) -> Column:
    close = F.lit(True)
    for c, p in zip(coordinates(column, len(point)), point):
        close = close & (F.abs(c - p) < epsilon)
    return close


def box_distance(low: Sequence[float], high: Sequence[float], point: Sequence[float]) -> float:
    """The least distance from a point to a box, a rounding error too small at most."""
    total = math.sqrt(sum(max(a - p, 0.0, p - b) ** 2 for a, b, p in zip(low, high, point)))
    return total * (1 - 1e-9) - 1e-12


def within_radius(df: DataFrame, column: str, point: Sequence[float], radius: float) -> DataFrame:
    """The rows at most radius from the point; null points are in no result."""
    return df.filter(within(column, point, radius))


def _measured(df: DataFrame, column: str, point: Sequence[float], name: str) -> DataFrame:
    return df.withColumn(name, distance(column, point)).filter(F.col(name).isNotNull() & ~F.isnan(name))


def kth_distance(df: DataFrame, column: str, point: Sequence[float], k: int) -> tuple[int, float]:
    """How many of the k nearest rows there are, and the distance of the last; a bounded heap in each task."""
    best = _measured(df, column, point, "__d").select("__d").orderBy("__d").limit(max(k, 0))
    n, last = best.agg(F.count("*"), F.max("__d")).first()
    return n, -1.0 if last is None else last


def nearest(df: DataFrame, column: str, point: Sequence[float], k: int, ties: bool = True, distance_name: str = "_distance", tie_break: Sequence[str] = ()) -> DataFrame:
    """The k rows nearest to the point with their distance, and with ties all rows as near as the k-th.

    Two passes that each are a filter or a top-k: the k-th distance is found by a bounded heap in each task, then rows up to it are
    kept. Nothing is sorted as a whole. Without ties, rows at the same distance are chosen by tie_break. Null points and k < 1 give no rows."""
    measured = _measured(df, column, point, distance_name)
    if k < 1:
        return measured.limit(0)
    best = measured.orderBy(distance_name, *tie_break).limit(k)
    if not ties:
        return best
    last = best.agg(F.max(distance_name).alias("__last"))  # one row
    return measured.join(F.broadcast(last), F.col(distance_name) <= F.col("__last")).drop("__last")
