"""The engine: statements of the dialect and the same operations as methods."""

from __future__ import annotations

import time
from collections import deque
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.lang import ast
from cantera.lang.parser import parse
from cantera.operators import codewords, spatial
from cantera.operators.text import TextIndex
from cantera.plans.binder import BROADCAST_ROWS, Binder, BindProblem, coerce
from cantera.session import scratch, ship, written
from cantera.sources import csv_ingest, media
from cantera.sources.catalog import Catalog, DataFile, Table, spark_type

TEXT_LIMIT = 100
HISTORY = 50
COUNTED = ("files_read", "bytes_read", "rows_read", "files_written", "bytes_written", "rows_written")


class StatementFailed(RuntimeError):
    """A statement of a text that was to be run as a whole failed; results has what came before, and its own result."""

    def __init__(self, results: list[ast.Result]):
        super().__init__(results[-1].error)
        self.results = results


class Engine:
    """Tables below a root folder. strict: ranges on HASH columns are errors. unique: duplicate keys are rejected by insert.

    text_limit: how many best rows a text search gives where no LIMIT says so, also inside AND and OR; None for all. stem: text indexes hold stems
    without stop words, else plain terms. extractors: by IMAGE or AUDIO, a function from a file's bytes to descriptors."""

    def __init__(self, spark: SparkSession, root: str, strict: bool = True, unique: bool = True, text_limit: int | None = TEXT_LIMIT, stem: bool = True, extractors: dict[str, media.Extractor] | None = None):
        self.spark, self.strict, self.unique, self.text_limit, self.stem, self.extractors = spark, strict, unique, text_limit, stem, extractors
        ship(spark)
        self.catalog = Catalog(spark, root)
        self.history: deque[dict[str, Any]] = deque(maxlen=HISTORY)  # newest first
        self.counts: dict[str, dict[str, int]] = {}

    # --- statements ---
    def sql(self, text: str) -> list[ast.Result]:
        """The results of all statements; what fails is told in its result's error. Text that isn't the dialect raises SyntaxProblem."""
        results = []
        for statement in parse(text):
            began = time.time()
            try:
                r = self.run(statement)
            except Exception as e:  # the API's edge: one statement's failure doesn't stop the rest
                r = ast.Result(type(statement).__name__, getattr(statement, "table", ""), error=f"{type(e).__name__}: {e}")
            r.seconds = time.time() - began
            results.append(r)
        self.history.appendleft({"query": text, "ok": all(r.error is None for r in results), "seconds": sum(r.seconds for r in results)})
        return results

    def execute(self, text: str, array_as_text: bool = True, similarity: bool = True) -> dict[str, Any]:
        """All statements of a text at once: data, columns and column_types of the first, results with type, message, table, rows and time of all. An empty text and a failed statement are errors.

        Arrays come as text, and a _distance as the percentage of similarity."""
        if not text.strip():
            raise BindProblem("no statement")
        found = self.sql(text)
        failed = next((i for i, r in enumerate(found) if r.error), None)
        if failed is not None:
            raise StatementFailed(found[: failed + 1])
        results = []
        for r in found:
            began, rows = time.time(), r.rows(array_as_text)
            if similarity and "_distance" in r.column_types:
                from cantera.functions.render import percent

                rows = [{("_similarity" if k == "_distance" else k): (percent(v) if k == "_distance" else v) for k, v in row.items()} for row in rows]
            results.append({"type": r.type, "table": r.table, "message": r.message, "data": rows, "rows_count": r.count if r.data is None else len(rows), "column_types": r.column_types, "seconds": r.seconds + time.time() - began, **r.extra})
        first = results[0] if results else {"data": [], "column_types": {}}
        return {"data": first["data"], "columns": list(first["column_types"]), "column_types": first["column_types"], "results": results, "seconds": sum(r["seconds"] for r in results)}

    def run(self, s) -> ast.Result:
        if isinstance(s, ast.Select):
            return ast.Result("select", s.table, data=self.select(s.table, s.columns, s.where, s.order, s.descending, s.limit))
        if isinstance(s, ast.Insert):
            self.insert(s.table, s.values)
            return ast.Result("insert", s.table, "1 row inserted", count=1)
        if isinstance(s, ast.Delete):
            n = self.delete(s.table, s.where)
            return ast.Result("delete", s.table, f"{n} rows deleted", count=n)
        if isinstance(s, ast.CreateTable):
            self.create_table(s.table, s.columns)
            return ast.Result("create_table", s.table, f"table {s.table} created")
        if isinstance(s, ast.CreateFromFile):
            n, skipped = self.create_table_from_file(s.table, s.path, s.indexes)
            return ast.Result("create_table_from_file", s.table, f"table {s.table} loaded", count=n, extra={"rows_skipped": skipped})
        n = self.build_text_index(s.table, s.column)
        return ast.Result("build_tex_inv", s.table, f"text index on {s.column}", count=n, extra={"status": "success", "column_name": s.column, "documents_indexed": n, "index_key": f"{s.table}.{s.column}"})

    # --- definition ---
    def create_table(self, name: str, columns) -> None:
        t = Table(name, list(columns))
        self.catalog.create(t)
        self._build_collections(t)

    def create_table_from_file(self, name: str, path: str, indexes) -> tuple[int, int]:
        """How many rows were loaded, and how many were left out because an INT was out of range. The file is read once; its cells are kept until they are typed."""
        by_column = {i.column: i for i in indexes}
        with scratch():
            raw = written(csv_ingest.read_text(self.spark, path))
            missing = set(by_column) - set(raw.columns)
            if missing:
                raise BindProblem(f"the file has no column {', '.join(sorted(missing))}")
            columns, rows = csv_ingest.infer(raw, indexes[0].column, by_column)
            t = Table(name, columns)
            self.catalog.create(t, csv_ingest.typed(raw, columns))
        self._count(t, written=t.files)
        self._build_collections(t)
        n = sum(f.rows for f in t.files)
        return n, rows - n

    # --- rows ---
    def _binder(self, t: Table, where: ast.Condition | None, given: list[DataFile] | None = None) -> Binder:
        """A binder over the files that may hold matches; in its base, stored coordinates too."""
        known: dict[tuple, float] = {}

        def kth(column: str, point: tuple, k: int) -> float:
            if (column, point, k) not in known:
                known[column, point, k] = self._kth(t, column, point, k)
            return known[column, point, k]

        binder = Binder(t, self.catalog.read(t, []), lambda c, n: self._leaf(t, c, n), self.strict, kth)
        binder.check(where)
        files = [f for f in (t.files if given is None else given) if binder.may_match(where, f)]
        self._count(t, read=files)
        binder.base, binder.files = self.catalog.read(t, files, stored=True), files
        return binder

    def _kth(self, t: Table, column: str, point: tuple, k: int) -> float:
        """The distance of the k-th nearest row. With bounds: the nearest files with k points give a radius, then only files that it reaches are read."""
        files = t.files
        if column in {c.name for c in t.points}:
            ranked = sorted(((spatial.box_distance(*f.bounds[column][1:], point), f) for f in files if f.bounds[column][0]), key=lambda x: x[0])
            held, first = 0, []
            for _, f in ranked:
                if held >= k:
                    break
                first.append(f)
                held += f.bounds[column][0]
            self._count(t, read=first)
            n, radius = spatial.kth_distance(self.catalog.read(t, first), column, point, k)
            files = [f for d, f in ranked if n < k or d <= radius]
            if {f.path for f in files} == {f.path for f in first}:
                return radius
        self._count(t, read=files)
        return spatial.kth_distance(self.catalog.read(t, files), column, point, k)[1]

    def select(self, name: str, columns=None, where: ast.Condition | None = None, order: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
        """A lazy DataFrame. Without an order, a search's own order holds; with a limit rows come in key order, else in any. LIMIT 0 gives no rows.

        Searches for the nearest or best rows are made first: what they found is a part of the plan."""
        t = self.catalog.get(name)
        if isinstance(where, (ast.TextMatch, ast.Similar)):
            df = self._retrieved(t, where, limit)
        else:
            df = self._binder(t, where).bind(where, limit)
        scores = [c for c in df.columns if c in ("_score", "_distance")]
        wanted = [c.name for c in t.columns] + scores if columns is None else list(dict.fromkeys(columns))
        for c in [*wanted, *([order] if order else [])]:
            if c not in df.columns or c not in scores and c not in {x.name for x in t.columns}:
                raise BindProblem(f"table {name} has no column {c}")
        key = [c.name for c in t.columns if c.key]
        if order:
            df = df.orderBy(F.col(f"`{order}`").desc() if descending else F.col(f"`{order}`").asc(), *[F.col(f"`{k}`") for k in key if k != order])
        elif isinstance(where, ast.TextMatch):
            df = df.orderBy(F.desc("_score"), F.col(f"`{t.key}`").cast("string"))
        elif isinstance(where, ast.Similar):
            df = df.orderBy("_distance", f"`{t.key}`")
        elif isinstance(where, ast.Nearest):
            df = df.orderBy(spatial.distance(where.column, where.point), *[F.col(f"`{k}`") for k in key])
        elif limit is not None and key:
            df = df.orderBy(*[F.col(f"`{k}`") for k in key])
        if limit is not None:
            df = df.limit(limit)
        return df.select(*[F.col(f"`{c}`") for c in wanted])

    def _retrieved(self, t: Table, c: ast.TextMatch | ast.Similar, limit: int | None) -> DataFrame:
        """The rows of a search that stands alone, with their scores. A short list of keys is brought here, so that only files with these keys are opened."""
        t.column(c.column)
        found = self._leaf(t, c, limit)
        asked = limit if limit is not None else self.text_limit if isinstance(c, ast.TextMatch) else codewords.NEIGHBOURS
        if asked is None or asked > BROADCAST_ROWS:
            return self._binder(t, None).base.join(found, t.key)
        return self._fetched(t, self.spark.createDataFrame(found.collect(), found.schema))

    def _fetched(self, t: Table, found: DataFrame) -> DataFrame:
        keys = [r[0] for r in found.select(t.key).collect() if r[0] is not None]
        as_bound = [k.isoformat() if hasattr(k, "isoformat") else k for k in keys]
        held = [f for f in t.files if t.key not in f.bounds or f.bounds[t.key][0] and any(f.bounds[t.key][1] <= k <= f.bounds[t.key][2] for k in as_bound)]
        self._count(t, read=held)
        rows = self.catalog.read(t, held, stored=True)
        return rows.filter(F.col(f"`{t.key}`").isin(keys)).join(F.broadcast(found), t.key) if keys else rows.join(found, t.key)

    def fetch(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows whose key is in a column named like it, in any number: what a secondary index found is looked up in the primary layout. Null keys find nothing, repeated ones each row once; rows come in any order."""
        t = self.catalog.get(name)
        wanted = keys.select(F.col(f"`{t.key}`").cast(spark_type(t.column(t.key)))).filter(F.col(f"`{t.key}`").isNotNull())
        some = wanted.distinct().limit(BROADCAST_ROWS + 1)
        if some.count() <= BROADCAST_ROWS:
            return self._fetched(t, some).select(*t.schema.names)
        return self.catalog.read(t, self._overlapping(t, wanted)).join(wanted, t.key, "left_semi")

    def _overlapping(self, t: Table, keys: DataFrame) -> list[DataFile]:
        """The files whose keys overlap the range of some keys."""
        low, high = (v.isoformat() if hasattr(v, "isoformat") else v for v in keys.agg(F.min(f"`{t.key}`"), F.max(f"`{t.key}`")).first())
        files = [f for f in t.files if t.key not in f.bounds or f.bounds[t.key][0] and low is not None and f.bounds[t.key][1] <= high and f.bounds[t.key][2] >= low]
        self._count(t, read=files)
        return files

    def insert(self, name: str, values) -> None:
        t = self.catalog.get(name)
        if len(values) != len(t.columns):
            raise BindProblem(f"table {name} has {len(t.columns)} columns, {len(values)} values were given")
        try:
            row = [coerce(c, v) for c, v in zip(t.columns, values)]
        except (TypeError, ValueError) as e:
            raise BindProblem(str(e)) from None
        self._writable(t)
        key = next((i for i, c in enumerate(t.columns) if c.key), None)
        if self.unique and key is not None:
            same = ast.Compare(t.key, "=", values[key])
            if not self._binder(t, same).bind(same).limit(1).isEmpty():
                raise BindProblem(f"key {row[key]!r} is in table {name} already")
        self._count(t, written=self.catalog.append(t, self.spark.createDataFrame([tuple(row)], t.schema), few=True))

    def insert_rows(self, name: str, rows: DataFrame) -> None:
        """Appends rows with the table's columns, in any number. With unique keys, rows whose key is there already or comes twice are an error. Of the table, only files whose keys overlap the new ones are read."""
        t = self.catalog.get(name)
        self._writable(t)
        key = next((c.name for c in t.columns if c.key), None)
        with scratch():
            if self.unique and key:
                rows = written(rows)
                found = rows.groupBy(key).count().filter("count > 1").select(key).first()
                if found is None and t.files:
                    held = self.catalog.read(t, self._overlapping(t, rows)).select(key)
                    found = held.join(rows.select(key), key, "left_semi").first()
                if found:
                    raise BindProblem(f"key {found[0]!r} is in table {name} already")
            self._count(t, written=self.catalog.append(t, rows))

    def _writable(self, t: Table) -> None:
        if any(c.index and c.index.kind.startswith("KNN") for c in t.columns):
            raise NotImplementedError(f"table {t.name} has a read-only index")

    def delete(self, name: str, where: ast.Condition | None = None) -> int:
        """How many rows went. Rows for which the condition is null stay. Only files that hold matches are written again; without a condition none is read."""
        t = self.catalog.get(name)
        if where is None:
            n = sum(f.rows for f in t.files)
            self.catalog.replace(t, t.files, None)
            return n
        binder = self._binder(t, where)
        with_file = F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), F.element_at(F.split("_metadata.file_path", "/"), -1))
        if not binder.files:
            return 0
        binder.base = binder.base.withColumn("__file", with_file)
        with scratch():
            gone = binder.bind(where)
            searched = bool(binder.searches) or isinstance(where, (ast.TextMatch, ast.Similar))
            if searched:
                gone = written(gone.select(f"`{t.key}`", "__file"))
            hit = {r["__file"]: r["count"] for r in gone.groupBy("__file").count().collect()}  # a row per file
            if not hit:
                return 0
            old = [f for f in binder.files if f.path in hit]
            rows = self.catalog.read(t, old, stored=True)
            if searched:
                kept = rows.join(gone.select(f"`{t.key}`"), t.key, "left_anti")
            else:
                kept = rows.filter(~F.coalesce(Binder(t, rows, binder.leaf, self.strict, binder.kth).predicate(where), F.lit(False)))
            whole = sum(f.rows for f in old) == sum(hit.values())
            self._count(t, read=old, written=self.catalog.replace(t, old, None if whole else kept))
        return sum(hit.values())

    def vacuum(self, name: str) -> int:
        """Removes data files that the table no longer uses; how many."""
        return self.catalog.vacuum(self.catalog.get(name))

    # --- text ---
    def build_text_index(self, name: str, column: str) -> int:
        """Number of documents indexed. The index is a snapshot: later changes of the table don't reach it until it is built again, which replaces it."""
        t = self.catalog.get(name)
        if t.column(column).type not in ("VARCHAR", "TEXT"):
            raise BindProblem(f"{column} is no text")
        path = f"{self.catalog.path(t)}/text-{column}{'' if self.stem else '-plain'}"
        self._count(t, read=t.files)
        index = TextIndex.build(self.catalog.read(t), t.key, column, stemmed=self.stem, path=path)
        t.text[column] = path
        self.catalog.save()
        return index.docs.count()

    # --- media ---
    def _build_collections(self, t: Table) -> None:
        for c in t.columns:
            if c.type in codewords.CLUSTERS and c.index and "collection" in dict(c.index.options):
                self.build_media_index(t.name, c.name)

    def media_path(self, t: Table, column: str) -> str:
        """Where a column's media index is: below the table, or where dataset or index_prefix says, which several tables may share."""
        options = dict(t.column(column).index.options) if t.column(column).index else {}
        shared = options.get("index_prefix") or options.get("dataset")
        return f"{self.catalog.root}/media/{shared}" if shared else f"{self.catalog.path(t)}/media-{column}"

    def build_media_index(self, name: str, column: str) -> int:
        """Builds the index of a KNN column from its option collection; how many documents it has. Options: clusters or k, id_from_filename, index_prefix or dataset."""
        t = self.catalog.get(name)
        c = t.column(column)
        options = dict(c.index.options) if c.index else {}
        if "collection" not in options:
            raise BindProblem(f"{name}.{column} has no collection")
        found = media.collection(self.spark, options["collection"], c.type, bool(options.get("id_from_filename")), self.extractors)
        return self._indexed(t, c, found.select(F.col("external_id").cast(spark_type(t.column(t.key))).alias("key"), "descriptors").filter("key is not null"), options.get("clusters") or options.get("k"))

    def build_offline(self, prefix: str, folder: str, kind: str, k: int | None = None, id_from_filename: bool = True, key_type: str = "string") -> int:
        """An index of a collection that tables find by the option index_prefix or dataset; how many documents it has."""
        found = media.collection(self.spark, folder, kind, id_from_filename, self.extractors)
        weights = media.build_index(found.select(F.col("external_id").cast(key_type).alias("key"), "descriptors").filter("key is not null"), "key", f"{self.catalog.root}/media/{prefix}", k or codewords.CLUSTERS[kind])
        return weights.select("doc").distinct().count()

    def register_media(self, name: str, column: str, descriptors: DataFrame, k: int | None = None, queries: DataFrame | None = None, seed: int = 42, centroids: DataFrame | None = None) -> int:
        """Builds the index from descriptors (path, descriptors: array of arrays) of the files in a table's IMAGE or AUDIO column; queries may hold those of further files. centroids (word, centroid) are a codebook that is known. How many documents it has."""
        t = self.catalog.get(name)
        c = t.column(column)
        options = dict(c.index.options) if c.index else {}
        keyed = self.catalog.read(t).select(F.col(f"`{t.key}`").alias("key"), F.col(f"`{column}`").alias("path")).join(descriptors, "path")
        n = self._indexed(t, c, keyed, k or options.get("clusters") or options.get("k"), seed, centroids)
        known = descriptors.select("path", "descriptors")
        known = known if queries is None else known.unionByName(queries.select("path", "descriptors"))
        known.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").parquet(f"{self.catalog.path(t)}/described-{column}")
        return n

    def _indexed(self, t: Table, c: ast.ColumnDef, keyed: DataFrame, k: int | None, seed: int = 42, centroids: DataFrame | None = None) -> int:
        path = self.media_path(t, c.name)
        weights = media.build_index(keyed, "key", path, int(k or codewords.CLUSTERS.get(c.type, 500)), seed, centroids)
        t.media[c.name] = path
        self.catalog.save()
        return weights.select("doc").distinct().count()

    def _similar(self, t: Table, c: ast.Similar, limit: int | None) -> DataFrame:
        column = t.column(c.column)
        path = t.media.get(c.column) or self.media_path(t, c.column)
        if not self._exists(f"{path}/weights"):
            raise BindProblem(f"{t.name}.{c.column} has no media registered")
        described = f"{self.catalog.path(t)}/described-{c.column}"
        files = self.spark.read.parquet(described).filter(F.col("path") == c.file) if self._exists(described) else None
        if files is None or files.isEmpty():
            content = self.spark.read.format("binaryFile").load(media.checked(self.spark, c.file, column.type)).select("path", "content")
            files = media.extract(content, column.type, self.extractors)
        found = media.MediaIndex(self.spark, path).search(files, bool(column.index and column.index.kind == "KNN_INV"), codewords.NEIGHBOURS if limit is None else limit)
        return found.select(F.col("doc").cast(spark_type(t.column(t.key))).alias(t.key), "_distance")

    def _exists(self, path: str) -> bool:
        fs, p = self.catalog._fs(path)
        return fs.exists(p)

    def _leaf(self, t: Table, c: ast.Condition, limit: int | None) -> DataFrame:
        if isinstance(c, ast.Similar):
            return self._similar(t, c, limit)
        if c.column not in t.text:
            raise BindProblem(f"{t.name}.{c.column} has no text index: BUILD TEX_INV ON {t.name}({c.column})")
        found = TextIndex.load(self.spark, t.text[c.column], stemmed=not t.text[c.column].endswith("-plain")).search(c.query, self.text_limit if limit is None else limit)
        return found.withColumnRenamed("doc", t.key)

    # --- what there is ---
    def show_tables(self) -> list[str]:
        return sorted(self.catalog.tables)

    def describe(self, name: str, preview: int = 100) -> dict[str, Any]:
        """Columns with their types and indexes, the row count and a preview of at most so many rows."""
        t = self.catalog.get(name)
        columns = [{"name": c.name, "type": type_text(c), "key": c.key, "indexed": c.index is not None, "index": c.index.kind if c.index else None} for c in t.columns]
        return {"name": name, "columns": columns, "row_count": sum(f.rows for f in t.files), "text_indexes": sorted(t.text), "preview": [r.asDict() for r in self.catalog.read(t).limit(preview).collect()]}

    def tables(self) -> DataFrame:
        """table, row_count, columns of every table, from the manifests."""
        rows = [(n, sum(f.rows for f in t.files), ", ".join(f"{c.name} {type_text(c)}" for c in t.columns)) for n, t in sorted(self.catalog.tables.items())]
        return self.spark.createDataFrame(rows, "table string, row_count bigint, columns string")

    def _count(self, t: Table, read=(), written=()) -> None:
        held = self.counts.setdefault(t.name, dict.fromkeys(COUNTED, 0))
        for what, files in (("read", read), ("written", written)):
            held[f"files_{what}"] += len(files)
            held[f"bytes_{what}"] += sum(f.bytes for f in files)
            held[f"rows_{what}"] += sum(f.rows for f in files)

    def io_stats(self, name: str) -> dict[str, int]:
        """Files, bytes and rows of the table that statements have had to open since the last reset, after pruning by bounds, and those they have written; beside these what a full scan opens."""
        t = self.catalog.get(name)
        return {**self.counts.get(name, dict.fromkeys(COUNTED, 0)), "files": len(t.files), "bytes": sum(f.bytes for f in t.files)}

    def reset_io_stats(self, name: str) -> None:
        self.catalog.get(name)
        self.counts.pop(name, None)


def type_text(c: ast.ColumnDef) -> str:
    if c.type == "ARRAY":
        return f"ARRAY[{c.size}][{c.element}]"
    return f"{c.type}[{c.size}]" if c.size else c.type


__all__ = ["Engine", "StatementFailed", "spark_type"]
