"""Rows of a stream into a table of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cantera.engine import Engine
from cantera.session import scratch, written


def append_stream(engine: Engine, name: str, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream's rows to a table batch by batch. Rows whose key the table holds already are left out, and of several new rows of one key one stays: a batch that is repeated after a failure, and a row delivered again, change nothing."""
    t = engine.catalog.get(name)

    def batch(rows: DataFrame, _: int) -> None:
        with scratch():
            new = written(rows.dropDuplicates([t.key]))
            new = new.join(engine.catalog.read(t, engine._overlapping(t, new)).select(t.key), t.key, "left_anti")
            engine.catalog.append(t, new)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
