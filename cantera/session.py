"""Session helpers: the folder shared by all executors, written intermediate tables, partition counts."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Bytes of input that one task of a shuffle should hold.
TASK_BYTES = 64 << 20
#: An estimate above this is Catalyst's stand-in for an unknown size.
UNKNOWN_BYTES = 1 << 56
MOST_TASKS = 500_000
_written: list[tuple[SparkSession, str]] = []
_scopes: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir. Only a local session, as in tests, may leave it unset: it gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cantera-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:
            pass  # the session ended first
    tables.clear()


atexit.register(_remove, _written)


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder: lineage is cut and any lost executor's part can be read again.

    The table goes when the scratch scope around it ends, without one when the process does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    (_scopes[-1] if _scopes else _written).append((spark, path))
    (df.repartition(partitions) if partitions else df).write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = (spark, path)
    return found


def removed(df: DataFrame) -> None:
    """Removes a table that `written` gave before its scope ends; nothing may read it any more."""
    for tables in (*_scopes, _written):
        if df._written in tables:
            tables.remove(df._written)
    _remove([df._written])


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written within are removed at the end, but for those of DataFrames that went through the function given, which read nothing else."""
    mine: list[tuple[SparkSession, str]] = []
    kept: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame) -> DataFrame:
        """df as a written table that outlives the scope."""
        before = len(mine)
        df = written(df)
        kept.extend(mine[before:])
        del mine[before:]
        return df

    _scopes.append(mine)
    try:
        yield keep
    finally:
        _scopes.remove(mine)
        _remove(mine)
        (_scopes[-1] if _scopes else _written).extend(kept)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of all executors, once for each application, by the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_cantera_shipped", False):
        return
    home, data = Path(__file__).resolve().parent, io.BytesIO()
    if home.is_dir():  # not from an archive already
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        target = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cantera-{uuid.uuid4().hex}.zip")
        stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
        stream.write(bytearray(data.getvalue()))
        stream.close()
        sc.addPyFile(target.toString())
    sc._cantera_shipped = True


def sent_file(spark: SparkSession, path: str) -> None:
    """Sends a file of the driver to all executors, once for each application; their workers find it by near_file."""
    sc = spark.sparkContext
    sent = getattr(sc, "_cantera_files", set())
    if path not in sent and Path(path).exists():
        sc.addFile(path)
        sc._cantera_files = sent | {path}


def near_file(path: str) -> str:
    """Where a worker reads a file that was sent."""
    if Path(path).exists():
        return path
    return SparkFiles.get(Path(path).name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name below a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; where it has none, as for rows that come from Python, the size of the files and tables that are read."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size <= UNKNOWN_BYTES:
        return size
    leaves = plan.collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s for s in sizes if s <= UNKNOWN_BYTES)


def fan_out(df: DataFrame, factor: float = 1.0) -> int:
    """Partitions for work of `factor` times the size of df: by bytes, at least the configured shuffle partitions and two for each core."""
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return min(MOST_TASKS, max(least, int(size_bytes(df) * factor) // TASK_BYTES + 1))
