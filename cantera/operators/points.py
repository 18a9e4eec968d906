"""Points near other points or in regions (problem 5).

Points: a location in any of several notations becomes a latitude and a longitude by two regular expressions.

Near points: every point of one side lies in its square grid cell; a point of the other side visits each cell that its
radius reaches, so an equi-join by cell finds every pair once. A cell that holds very many points is cut into blocks, all of
which are visited, so no task holds a whole crowded cell.

Regions: trapezoidal decomposition. The latitudes of all corners cut the plane into slabs; inside a slab a region's edges don't
end, so between two neighbouring slab bounds each edge is a straight line across. A point's slab is found by
binary search over the bounds, the slab's regions that reach the point by binary search over their western and
eastern ends, and the point lies in a region when an odd number of the region's edges in that slab lie west of it, which is a third
binary search. Slab lists of a checked size go to every task. Beyond that they are distributed by tiles of latitude and longitude,
each with slabs of its own that its points are searched in by the same code; tiles with many points or edges are cut into blocks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.session import written

#: Bytes of slab lists that may be sent to every task.
SENT_BYTES = 32 << 20
#: Points of a grid cell that one task joins at once.
BLOCK = 2048
#: A cell's width in radii, where a table meets itself: a point visits 1.6 cells on average.
CELL_RADII = 8
#: Height and width in degrees of a tile of distributed slabs, and its points and edges that meet at once.
TILE = 0.25
TILE_BLOCK = 1 << 16

_MARK = "\x01"
_NUMBER = r"[-+−]?\d++(?:\.\d++)?"
_COMMA = r"[-+−]?\d++(?:[.,]\d++)?"
_PLAIN = r"\d++(?:[.,]\d++)?"
_OPEN, _CLOSE = r"^\s*+[(\[]?\s*+", r"\s*+[)\]]?\s*+$"
#: Notations: two numbers with a comma or blanks between them; with decimal commas and a semicolon; with letters for the hemispheres; with decimal commas and blanks.
NOTATIONS = _OPEN + "(?:" + "|".join((
    rf"({_NUMBER})(?:\s*+,\s*+|\s++)({_NUMBER})",
    rf"({_COMMA})\s*+;\s*+({_COMMA})",
    rf"({_PLAIN})\s*+°?\s*+([NnSs])\s*+[,;]?\s*+({_PLAIN})\s*+°?\s*+([EeWwOo])",
    r"([-+−]?\d++,\d++)\s++([-+−]?\d++,\d++)",
)) + ")" + _CLOSE
#: Latitude, its letter, longitude, its letter; all but one notation's groups are empty.
_AS_READ = _MARK + _MARK.join(("$1$3$5$9", "$6", "$2$4$7$10", "$8"))
#: Either label, a hemisphere before or after, and degrees with or without minutes and seconds: groups 1 before, 2 sign, 3-5 numbers, 6 after.
_DEGREES = rf"([{{0}}]?)\s*+([-+−]?)\s*+({_PLAIN})\s*+°?\s*+(?:({_PLAIN})\s*+['′’]\s*+)?(?:({_PLAIN})\s*+(?:\"|″|”|'')\s*+)?([{{0}}]?)"
_LABEL = r"(?:{0})?\s*+[:=]?\s*+"
FALLBACK = rf"(?i){_OPEN}{_LABEL.format('lat(?:itude?|itud)?')}{_DEGREES.format('NS')}\s*+(?:[,;/]\s*+|(?<=[NS\s])){_LABEL.format('(?:lon|lng)(?:gitude?|gitud)?')}{_DEGREES.format('EWO')}{_CLOSE}"
#: Letters, sign, degrees, minutes and seconds of either.
_AS_DEGREES = _MARK + _MARK.join(("$1$6", "$2", "$3", "$4", "$5", "$7$12", "$8", "$9", "$10", "$11"))


def _number(text: Column) -> Column:
    return F.nullif(F.translate(text, ",−", ".-"), F.lit("")).try_cast("double")


def parse_location(location: Column) -> Column:
    """A struct of lat and lon, or null where no latitude from -90 to 90 and longitude from -180 to 180 can be read.

    Latitude comes first. Beside the NOTATIONS, labels (lat, lon), hemispheres before the number and minutes and seconds are read; O is
    west (oeste). Not read: longitude first, three numbers without marks for minutes and seconds, a sign together with a hemisphere, numbers in words. Null, empty, incomplete and out-of-range locations give null."""

    def parts(once: Column) -> Column:
        """The groups of the notation that matches, or the text itself."""
        again = F.split(F.regexp_replace(once, FALLBACK, _AS_DEGREES), _MARK)
        return F.when(once.startswith(_MARK), F.split(once, _MARK)).otherwise(again)

    def turned(value: Column, letter: Column, negative: str) -> Column:
        return value * F.when(F.upper(letter).isin(*negative), -1.0).otherwise(1.0)

    def degrees(p: Column, first: int, negative: str) -> Column:
        letter, sign, whole, minutes, seconds = (p[first + i] for i in range(5))
        small = F.coalesce(_number(minutes), F.lit(0.0)), F.coalesce(_number(seconds), F.lit(0.0))
        once = (F.length(letter) <= 1) & ((sign == "") | (letter == "")) & (small[0] < 60) & (small[1] < 60)
        value = turned(_number(whole) + small[0] / 60 + small[1] / 3600, letter, negative)
        return F.when(once, value * F.when(sign.isin("-", "−"), -1.0).otherwise(1.0))

    def point(p: Column) -> Column:
        read = in_range(turned(_number(p[1]), p[2], "S"), turned(_number(p[3]), p[4], "WO"))
        return F.when(F.size(p) == 5, read).when(F.size(p) == 11, in_range(degrees(p, 1, "S"), degrees(p, 6, "WO")))

    bound = F.transform(F.transform(F.array(F.regexp_replace(location, NOTATIONS, _AS_READ)), parts), point)
    return F.when(~location.startswith(_MARK), bound[0])


def in_range(lat: Column, lon: Column) -> Column:
    """A struct of lat and lon where both are in range, else null; NaN is out of range."""
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def located(df: DataFrame, key: str, location: Column) -> DataFrame:
    """id, lat, lon of the distinct records that have a point; null keys and other columns are left out."""
    # Exploded, as a filter would be pushed below and have each location read twice.
    held = F.explode(F.filter(F.array(location), lambda p: p.isNotNull()))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), held.alias("point"))
    return rows.select("id", "point.lat", "point.lon").dropDuplicates(["id"])


def _home(points: DataFrame, width: float) -> DataFrame:
    """id, lat, lon and the point's own cell."""
    return points.select("id", "lat", "lon", F.floor(F.col("lat") / width).alias("cx"), F.floor(F.col("lon") / width).alias("cy"))


def _visits(points: DataFrame, width: float, radius: float) -> DataFrame:
    """id_2, lat_2, lon_2 once for each cell that the square around the point reaches; the square is a rounding error wider than the radius."""
    reach = radius * (1 + 1e-9) + 1e-12

    def cells(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width)))

    named = points.select(F.col("id").alias("id_2"), F.col("lat").alias("lat_2"), F.col("lon").alias("lon_2"))
    return named.withColumn("cx", cells("lat_2")).withColumn("cy", cells("lon_2"))


def _meeting(points: DataFrame, others: DataFrame, width: float, radius: float) -> DataFrame:
    """Every point with each of the others in reach: id, lat, lon, id_2, lat_2, lon_2 of those at most radius apart. Crowded cells' points are dealt over blocks by hash, all of which the others visit."""
    home, visits = _home(points, width), _visits(others, width, radius)
    # Written, so that its size is known before it is joined: mostly it is small enough to leave the points where they are.
    crowded = written(home.groupBy("cx", "cy").count().filter(F.col("count") > BLOCK).select("cx", "cy", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    mine = home.join(crowded, ["cx", "cy"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0))).drop("blocks")
    other = visits.join(crowded, ["cx", "cy"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    dx, dy = F.col("lat") - F.col("lat_2"), F.col("lon") - F.col("lon_2")
    return mine.join(other, ["cx", "cy", "block"]).filter(F.sqrt(dx * dx + dy * dy) <= radius)


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """id, id_2 with id < id_2: the pairs of points (id, lat, lon) at most radius apart, Euclidean in degrees, bound included.

    Equal points are at distance 0. Nothing is lost: of two points that near, each visits the other's own cell. An empty table gives no rows."""
    return _meeting(points, points, CELL_RADII * radius, radius).filter(F.col("id") < F.col("id_2")).select("id", "id_2")


def near_points(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """id, id_2: for each point the others at most radius away, bound included; both sides have id, lat, lon. Others is the smaller side: it visits the points' cells. An empty table gives no rows."""
    return _meeting(points, others, radius, radius).select("id", "id_2")


# --- regions -----------------------------------------------------------------


def edges(regions: DataFrame, key: str, ring: str) -> DataFrame:
    """id, y1, x1, y2, x2: the edges of each distinct region's ring with y1 < y2 (y: latitude, x: longitude).

    The ring is closed if it is not; edges along a latitude bound no slab and are left out. Regions with a null key or ring, and corners that are null, too short or not finite, are left out; rings with fewer than three corners have no area."""
    good = F.filter(F.col(ring), lambda c: F.coalesce((F.size(c) >= 2) & c[0].isNotNull() & c[1].isNotNull() & ~F.isnan(c[0]) & ~F.isnan(c[1]) & (F.abs(c[0]) < float("inf")) & (F.abs(c[1]) < float("inf")), F.lit(False)))
    rows = regions.filter(F.col(key).isNotNull()).dropDuplicates([key]).select(F.col(key).alias("id"), good.alias("ring")).filter(F.size("ring") >= 3)
    closed = F.concat("ring", F.slice("ring", 1, 1))
    pair = F.transform(F.sequence(F.lit(0), F.size("ring") - 1), lambda i: F.struct(F.get(closed, i).alias("a"), F.get(closed, i + 1).alias("b")))
    e = rows.select("id", F.explode(pair).alias("e")).select("id", *[F.col(f"e.{p}")[i].alias(f"{p}{i}") for p in "ab" for i in (0, 1)])
    up = F.col("a0") < F.col("b0")
    return e.filter("a0 <> b0").select("id", *[F.when(up, F.col(f)).otherwise(F.col(s)).alias(n) for n, f, s in (("y1", "a0", "b0"), ("x1", "a1", "b1"), ("y2", "b0", "a0"), ("x2", "b1", "a1"))])


class Slabs:
    """The edges of each slab in order of longitude, in flat arrays."""

    def __init__(self, ids: np.ndarray, y1: np.ndarray, x1: np.ndarray, y2: np.ndarray, x2: np.ndarray, south: float = -np.inf, north: float = np.inf):
        """Of edges with y1 < y2, the part between south and north."""
        self.bounds = bounds = np.unique(np.clip(np.r_[y1, y2], south, north))
        first, last = np.searchsorted(bounds, np.maximum(y1, south)), np.searchsorted(bounds, np.minimum(y2, north))
        span = np.maximum(last - first, 0)
        edge = np.repeat(np.arange(len(ids)), span)
        slab = np.repeat(first, span) + np.arange(len(edge)) - np.repeat(np.cumsum(span) - span, span)
        slope = (x2 - x1) / (y2 - y1)
        low, high = bounds[slab], bounds[np.minimum(slab + 1, len(bounds) - 1)]
        middle = x1[edge] + slope[edge] * ((low + high) / 2 - y1[edge])
        # Within a slab: by region, then by where the edge crosses the middle; a region's own edges don't cross inside.
        order = np.lexsort((middle, ids[edge], slab))
        edge, slab, low, high = edge[order], slab[order], low[order], high[order]
        self.ids, self.y, self.x, self.slope = ids[edge], y1[edge], x1[edge], slope[edge]
        new = np.r_[True, (slab[1:] != slab[:-1]) | (self.ids[1:] != self.ids[:-1])][: len(edge)]
        start = np.flatnonzero(new)  # of each region's edges in a slab
        end = np.r_[start[1:], len(edge)].astype(np.int64)[: len(start)]
        at_low, at_high = self.x + self.slope * (low - self.y), self.x + self.slope * (high - self.y)
        ends = (np.zeros(0), np.zeros(0)) if not len(start) else (np.minimum.reduceat(np.minimum(at_low, at_high), start) - 1e-9, np.maximum.reduceat(np.maximum(at_low, at_high), start) + 1e-9)
        # A slab's regions from west to east, and how far east the regions up to each reach: both ascend, so both can be searched.
        order = np.lexsort((ends[0], slab[start]))
        self.start, self.end, self.west, self.east = start[order], end[order], ends[0][order], ends[1][order]
        self.first = np.searchsorted(slab[start], np.arange(len(bounds)))  # of each slab's regions
        self.reach = self.east.copy()
        for a, b in zip(self.first, np.r_[self.first[1:], len(start)]):
            np.maximum.accumulate(self.reach[a:b], out=self.reach[a:b])

    @staticmethod
    def _search(below, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
        """For each point the first place from low to high where below(places) no longer holds."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            under = below(np.minimum(mid, most))
            low = np.where(open_ & under, mid + 1, low)
            high = np.where(open_ & ~under, mid, high)
        return low

    def locate(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of points and the ids of the regions that hold them."""
        slab = np.searchsorted(self.bounds, lat, side="right") - 1
        inside = np.flatnonzero((slab >= 0) & (slab < len(self.bounds) - 1))
        if not len(inside) or not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slab, x = slab[inside], lon[inside]
        first, last = self.first[slab], np.r_[self.first[1:], len(self.start)][slab]
        high = self._search(lambda m: self.west[m] <= x, first, last, len(self.start) - 1)
        low = self._search(lambda m: self.reach[m] < x, first, last, len(self.start) - 1)
        count = np.maximum(high - low, 0)
        point = np.repeat(inside, count)
        region = np.repeat(low, count) + np.arange(len(point)) - np.repeat(np.cumsum(count) - count, count)
        near = self.east[region] >= lon[point]
        point, region = point[near], region[near]
        y, x = lat[point], lon[point]
        # The number of the region's edges west of the point.
        west = self._search(lambda m: self.x[m] + self.slope[m] * (y - self.y[m]) <= x, self.start[region], self.end[region], len(self.x) - 1)
        odd = (west - self.start[region]) % 2 == 1
        return point[odd], self.ids[self.start[region[odd]]]


_EDGE = ("region", "y1", "x1", "y2", "x2")


def _locating(slabs: Slabs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point, region = slabs.locate(batch.column(1).to_numpy(), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(point)), pa.array(region)], names=["id", "region"])

    return run


def _tiled(points: DataFrame, found: DataFrame, form: str) -> DataFrame:
    """id, region, where slabs are distributed by tiles. A region has all its edges of a tile's latitudes in every tile that it reaches, so the edges west of a point are all there."""
    at = lambda c: F.floor(F.col(c) / TILE)
    banded = found.withColumn("ty", F.explode(F.sequence(at("y1"), at("y2"))))
    reached = banded.groupBy("region", "ty").agg(F.floor(F.min(F.least("x1", "x2")) / TILE).alias("w"), F.floor(F.max(F.greatest("x1", "x2")) / TILE).alias("e"))
    tiled = banded.join(reached, ["region", "ty"]).withColumn("tx", F.explode(F.sequence("w", "e"))).select(*_EDGE, "ty", "tx")
    placed = points.select("id", "lat", "lon", at("lat").alias("ty"), at("lon").alias("tx"))

    def crowded(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("ty", "tx").count().filter(F.col("count") > TILE_BLOCK).select("ty", "tx", F.ceil(F.col("count") / TILE_BLOCK).cast("int").alias(name))

    blocks = written(crowded(placed, "pb").join(crowded(tiled, "eb"), ["ty", "tx"], "full"))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        sized = df.join(blocks, ["ty", "tx"], "left").withColumns({b: F.coalesce(b, F.lit(1)) for b in ("pb", "eb")})
        return sized.withColumn("at_" + own, F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn("at_" + other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("pb", "eb")

    def run(p: pa.Table, e: pa.Table) -> pa.Table:
        if not p.num_rows or not e.num_rows:
            return pa.table([p["id"].slice(0, 0), pa.array([], pa.int64())], names=["id", "region"])
        south = e["ty"][0].as_py() * TILE
        slabs = Slabs(*(e[c].to_numpy() for c in _EDGE), south, south + TILE)
        point, region = slabs.locate(p["lat"].to_numpy(), p["lon"].to_numpy())
        return pa.table([p["id"].take(pa.array(point)), pa.array(region)], names=["id", "region"])

    by = ["ty", "tx", "at_pb", "at_eb"]
    return dealt(placed, "id", "pb", "eb").groupBy(*by).cogroup(dealt(tiled, "region", "eb", "pb").groupBy(*by)).applyInArrow(run, form)


def containing_regions(points: DataFrame, regions: DataFrame, key: str, ring: str) -> DataFrame:
    """id, region: the regions that contain each point (id, lat, lon). A point on a border may count either way; regions may overlap, be concave and turn either way.

    Empty tables give no rows. Slab lists of at most SENT_BYTES go to every task; larger ones are distributed by tiles, and the points are sent to them."""
    id_type, region_type = points.schema["id"].dataType.simpleString(), regions.schema[key].dataType.simpleString()
    form = f"id {id_type}, region bigint"
    found = written(edges(regions, key, ring).select(F.col("id").cast("bigint").alias("region"), "y1", "x1", "y2", "x2"))
    n = found.count()
    sent = None
    if n * 5 * 8 <= SENT_BYTES:
        e = found.orderBy(*_EDGE).toPandas()
        columns = [e[c].to_numpy() for c in _EDGE]
        bounds = np.unique(np.r_[columns[1], columns[3]])
        # An edge crosses at most all slabs; its slabs are counted before anything is sent.
        if int((np.searchsorted(bounds, columns[3]) - np.searchsorted(bounds, columns[1])).sum()) * 7 * 8 <= SENT_BYTES:
            sent = Slabs(*columns)
    located_ = _tiled(points, found, form) if sent is None else points.select("id", "lat", "lon").mapInArrow(_locating(sent), form)
    return located_.select("id", F.col("region").cast(region_type).alias("region"))
