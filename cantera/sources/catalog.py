"""A catalog of typed tables on any file system that Spark reaches.

A table is a list of Parquet files, which its newest manifest names with their rows, bytes and bounds: of the key, of columns with
a tree index, and of each coordinate of points with an RTREE index. A query opens only files whose bounds allow a
match. Writes add files, deletes replace those that hold matches; then a new manifest is put beside the old one, so
readers see a table before or after a change and a crash loses nothing. Manifests and the catalog itself are numbered files, of which the newest whole one counts.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.lang.ast import ColumnDef, Index
from cantera.session import scratch, size_bytes, written

SIMPLE = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DATE": T.DateType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "IMAGE": T.StringType(), "AUDIO": T.StringType()}
#: Bytes of a data file; smaller ones count as small, and more small ones than this are put together.
FILE_BYTES = 128 << 20
SMALL_BYTES = 16 << 20
MOST_SMALL = 32
#: Bits of a point's place on the curve that spatial layouts follow.
CURVE_BITS = 48


class CatalogProblem(ValueError):
    """A table or column is missing, or there already."""


def spark_type(c: ColumnDef) -> T.DataType:
    """Points keep doubles, so that distances are those to the literals that were given."""
    if c.type == "ARRAY":
        return T.ArrayType({"INT": T.IntegerType(), "FLOAT": T.DoubleType(), "DATE": T.DateType()}[c.element])
    return SIMPLE[c.type]


@dataclass
class DataFile:
    """A file below the table's folder, one of `of` in its segment. bounds: by column, how many values aren't null, and the least and the greatest; lists of these for points."""

    path: str
    of: int
    rows: int
    bytes: int
    bounds: dict[str, list] = field(default_factory=dict)


@dataclass
class Table:
    name: str
    columns: list[ColumnDef]
    text: dict[str, str] = field(default_factory=dict)  # column: folder of its text index
    media: dict[str, str] = field(default_factory=dict)  # column: folder of its media index
    version: int = 0
    files: list[DataFile] = field(default_factory=list)

    @property
    def key(self) -> str:
        found = next((c.name for c in self.columns if c.key), None)
        if found is None:
            raise CatalogProblem(f"table {self.name} has no key")
        return found

    def column(self, name: str) -> ColumnDef:
        found = next((c for c in self.columns if c.name == name), None)
        if found is None:
            raise CatalogProblem(f"table {self.name} has no column {name}")
        return found

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c), True, {"type": c.type, "size": c.size or 0, "key": c.key, "index": c.index.kind if c.index else ""}) for c in self.columns])

    @property
    def points(self) -> list[ColumnDef]:
        """The columns with an RTREE index. Their coordinates are stored beside them as plain columns, which have bounds in every row group."""
        return [c for c in self.columns if c.index and c.index.kind == "RTREE" and c.type == "ARRAY" and c.element != "DATE"]

    @property
    def stored(self) -> T.StructType:
        return T.StructType([*self.schema, *(T.StructField(n, T.DoubleType()) for c in self.points for n in coordinates_of(c))])

    @property
    def ranged(self) -> list[ColumnDef]:
        """The columns with bounds of their own in a manifest."""
        return [c for c in self.columns if c.type != "ARRAY" and (c.key or c.index and c.index.kind == "BTREE")]


def coordinates_of(c: ColumnDef) -> list[str]:
    return [f"__{c.name}_{i}" for i in range(c.size)]


def curve(df: DataFrame, names: list[str]) -> Column:
    """The place of a point on a Z-shaped curve through the box around all points; null without a point. One pass finds the box."""
    found = df.agg(*[f(F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n))) for n in names for f in (F.min, F.max)]).first()
    bits, place = CURVE_BITS // len(names), F.lit(0).cast("bigint")
    for i, n in enumerate(names):
        low, high = found[2 * i], found[2 * i + 1]
        span = (high - low) if low is not None and high > low else 1.0
        step = F.floor((F.col(n) - F.lit(low or 0.0)) / F.lit(span) * ((1 << bits) - 1)).cast("bigint")
        for b in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(step, b).bitwiseAND(F.lit(1).cast("bigint")), b * len(names) + i))
    return place


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, Table] = {}
        self.number = 0
        self.load()

    # --- numbered files ---
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self, folder: str, stem: str) -> list[int]:
        fs, p = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[len(stem) + 1 : -5]) for n in names if n.startswith(stem + "-") and n.endswith(".json") and n[len(stem) + 1 : -5].isdigit())

    def _newest(self, folder: str, stem: str) -> tuple[int, Any]:
        """The number and content of the newest whole file; 0 and None when there is none."""
        for n in reversed(self._numbers(folder, stem)):
            fs, p = self._fs(f"{folder}/{stem}-{n}.json")
            stream = fs.open(p)
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                return n, json.loads(text)
            except ValueError:
                continue  # cut off by a crash
        return 0, None

    def _put(self, folder: str, stem: str, n: int, content: Any) -> None:
        fs, p = self._fs(f"{folder}/{stem}-{n}.json")
        if fs.exists(p):
            raise CatalogProblem(f"{folder} was changed by another writer")
        _, new = self._fs(f"{folder}/{stem}-{uuid.uuid4().hex}.new")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(content, default=str).encode()))
        stream.close()
        if not fs.rename(new, p):
            fs.delete(new, False)
            raise CatalogProblem(f"{folder} was changed by another writer")
        for old in self._numbers(folder, stem)[:-2]:
            fs.delete(self._fs(f"{folder}/{stem}-{old}.json")[1], False)

    def load(self) -> None:
        """The catalog and all manifests as they are now."""
        self.number, found = self._newest(self.root, "catalog")
        self.tables = {}
        for t in found or []:
            columns = []
            for c in t["columns"]:
                i = c["index"]
                c["index"] = i and Index(i["kind"], i["column"], tuple((a, b) for a, b in i["options"]))
                columns.append(ColumnDef(**c))
            version, files = self._newest(f"{self.root}/{t['name']}", "manifest")
            self.tables[t["name"]] = Table(t["name"], columns, t["text"], t["media"], version, [DataFile(**f) for f in files or []])

    def save(self) -> None:
        content = [{"name": t.name, "columns": [asdict(c) for c in t.columns], "text": t.text, "media": t.media} for t in self.tables.values()]
        self._put(self.root, "catalog", self.number + 1, content)
        self.number += 1

    def commit(self, t: Table, files: list[DataFile]) -> None:
        self._put(self.path(t), "manifest", t.version + 1, [asdict(f) for f in files])
        t.version, t.files = t.version + 1, files

    # --- tables ---
    def get(self, name: str) -> Table:
        if name not in self.tables:
            raise CatalogProblem(f"no table {name}")
        return self.tables[name]

    def path(self, t: Table) -> str:
        return f"{self.root}/{t.name}"

    def read(self, t: Table, files: list[DataFile] | None = None, stored: bool = False) -> DataFrame:
        """The rows of the table, or of some of its files. stored: with the coordinates beside points."""
        files = t.files if files is None else files
        schema = t.stored if stored else t.schema
        if not files:
            return self.spark.createDataFrame([], schema)
        by_segment: dict[str, list[DataFile]] = {}
        for f in files:
            by_segment.setdefault(f.path.partition("/")[0], []).append(f)
        paths = []
        for segment, own in by_segment.items():  # a whole segment by its folder
            paths += [segment] if len(own) == own[0].of else [f.path for f in own]
        return self.spark.read.schema(schema).parquet(*[f"{self.path(t)}/{p}" for p in paths])

    def create(self, t: Table, df: DataFrame | None = None) -> None:
        if t.name in self.tables:
            raise CatalogProblem(f"table {t.name} exists")
        names = [c.name for c in t.columns]
        if len(set(names)) < len(names):
            raise CatalogProblem(f"table {t.name} has a column twice")
        if sum(c.key for c in t.columns) > 1:
            raise CatalogProblem(f"table {t.name} has several keys")
        t.version = max([0, *self._numbers(self.path(t), "manifest")])  # of a table whose creation didn't end
        self.commit(t, self.write(t, df) if df is not None else [])
        self.tables[t.name] = t
        try:
            self.save()
        except BaseException:
            del self.tables[t.name]
            raise

    def write(self, t: Table, df: DataFrame, few: bool = False) -> list[DataFile]:
        """A new segment, which no manifest names yet. With an RTREE column rows lie along a curve through space; else in the order of the key, over all files (BTREE, ISAM) or within each (SEQ).
        HASH columns, and keys of spatial layouts, have bloom filters. few: rows for one file."""
        key = next((c for c in t.columns if c.key), None)
        rows = df.select(*[F.col(f"`{c.name}`").cast(spark_type(c)).alias(c.name) for c in t.columns])
        rows = rows.select("*", *[F.get(c.name, F.lit(i)).cast("double").alias(n) for c in t.points for i, n in enumerate(coordinates_of(c))])
        kind = key.index.kind if key and key.index else "BTREE"
        segment = f"s-{uuid.uuid4().hex}"
        with scratch():
            if few:
                rows = rows.coalesce(1)
            elif t.points or key and kind != "SEQ":
                rows = written(rows)  # ranges are found by a pass of their own
            files = max(1, size_bytes(rows) // FILE_BYTES + 1) if not few else 1
            if few:
                rows = rows.sortWithinPartitions(key.name) if key else rows
            elif t.points:
                rows = rows.withColumn("__curve", curve(rows, coordinates_of(t.points[0])))
                rows = rows.repartitionByRange(files, "__curve").sortWithinPartitions("__curve").drop("__curve")
            elif key:
                rows = (rows if kind == "SEQ" else rows.repartitionByRange(files, key.name)).sortWithinPartitions(key.name)
            out = rows.write
            for c in t.columns:
                if c.index and c.index.kind == "HASH" or c.key and t.points:
                    out = out.option(f"parquet.bloom.filter.enabled#{c.name}", "true")
            out.parquet(f"{self.path(t)}/{segment}")
        return self._measured(t, segment)

    def _measured(self, t: Table, segment: str) -> list[DataFile]:
        """The files of a segment with their bounds: a row per file."""
        df = self.spark.read.schema(t.stored).parquet(f"{self.path(t)}/{segment}")
        plain = [c.name for c in t.ranged]
        names = plain + [n for c in t.points for n in coordinates_of(c)]
        measures = [m for i, n in enumerate(names) for m in (F.count(f"`{n}`").alias(f"n{i}"), F.min(f"`{n}`").alias(f"l{i}"), F.max(f"`{n}`").alias(f"h{i}"))]
        found = df.withColumns({"__f": F.col("_metadata.file_name"), "__b": F.col("_metadata.file_size")}).groupBy("__f").agg(F.count("*").alias("rows"), F.max("__b").alias("bytes"), *measures).collect()
        files = []
        for r in found:
            held = {n: [r[f"n{i}"], _bound(r[f"l{i}"], -math.inf), _bound(r[f"h{i}"], math.inf)] for i, n in enumerate(names)}
            bounds = {n: held[n] for n in plain}
            for c in t.points:
                own = [held[n] for n in coordinates_of(c)]
                bounds[c.name] = [min(o[0] for o in own), [o[1] for o in own], [o[2] for o in own]]
            files.append(DataFile(f"{segment}/{r['__f']}", len(found), r["rows"], r["bytes"], bounds))
        return sorted(files, key=lambda f: f.path)

    def append(self, t: Table, df: DataFrame, few: bool = False) -> list[DataFile]:
        """The new files. When many small ones have come together they are put in order as one segment."""
        new = self.write(t, df, few)
        files = t.files + new
        small = [f for f in files if f.bytes < SMALL_BYTES]
        if len(small) > MOST_SMALL:
            files = [f for f in files if f.bytes >= SMALL_BYTES] + self.write(t, self.read(t, small))
        self.commit(t, files)
        return new

    def replace(self, t: Table, gone: list[DataFile], df: DataFrame | None) -> list[DataFile]:
        """The table without some files and with the rows of df, if any; the new files."""
        new = self.write(t, df) if df is not None else []
        paths = {f.path for f in gone}
        self.commit(t, [f for f in t.files if f.path not in paths] + new)
        return new

    def vacuum(self, t: Table) -> int:
        """Removes the files that the newest manifest doesn't name; nobody may be reading an older state. How many went."""
        fs, p = self._fs(self.path(t))
        named, n = {f.path for f in t.files}, 0
        for s in fs.listStatus(p):
            segment = s.getPath().getName()
            if not s.isDirectory() or not segment.startswith("s-"):
                continue
            data = [f.getPath() for f in fs.listStatus(s.getPath()) if f.getPath().getName().endswith(".parquet")]
            gone = [f for f in data if f"{segment}/{f.getName()}" not in named]
            if len(gone) == len(data):
                fs.delete(s.getPath(), True)
            else:
                for f in gone:
                    fs.delete(f, False)
                left = len(data) - len(gone)
                for f in t.files:
                    if f.path.startswith(segment + "/"):
                        f.of = left
            n += len(gone)
        return n


def _bound(value: Any, open_end: float) -> Any:
    if value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return open_end if math.isnan(value) else value
    return value.isoformat()
