"""Written tables, scopes, sizes."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cantera import session


def path_of(df) -> Path:
    return Path(df.inputFiles()[0].removeprefix("file://")).parent


def test_scopes_remove_their_tables(spark):
    df = spark.range(10)
    with session.scratch() as keep:
        a = session.written(df)
        with session.scratch() as inner:
            b = session.written(a.filter("id > 3"))
            c = inner(b.filter("id > 5"))
            gone = path_of(b)
        assert not gone.exists() and path_of(c).exists()  # c lives as long as the outer scope
        d = keep(c.select(F.max("id").alias("id")))
        paths = path_of(a), path_of(c)
    assert not any(p.exists() for p in paths) and d.first()[0] == 9
    with pytest.raises(ZeroDivisionError), session.scratch():
        lost = path_of(session.written(df))
        raise ZeroDivisionError
    assert not lost.exists() and not session._scopes


def test_clusters_need_a_shared_folder():
    def fake(master, named=None):
        conf = SimpleNamespace(get=lambda _: named)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf, setCheckpointDir=lambda _: None))

    assert session.shared_dir(fake("spark://x:7077", "hdfs:///c/")) == "hdfs:///c"
    assert Path(session.shared_dir(fake("local[4]"))).is_dir()
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))


def test_sizes_of_rows_from_python(spark, tmp_path):
    """Where Catalyst has no estimate, the files that are read tell the size."""
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    joined = read.join(spark.createDataFrame([(1,)], "id bigint").rdd.toDF("id bigint"), "id")
    known = session.size_bytes(read)
    assert known <= session.size_bytes(joined) < 10 * known + 10_000
    assert session.fan_out(joined) == session.fan_out(read)
