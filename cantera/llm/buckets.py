"""Index entries that meet by bucket, moved in packs.

An entry is a bucket (64 bits) with a few numbers of 64 bits. Entries of a batch that go to the same group of
buckets travel as one row of bytes, so the shuffle handles few rows however many entries there are. At the other end a
group's entries are put in order of their bucket and handed over together. A group above MOST entries, as a hot bucket
makes it, is not gathered: its entries are passed on one by one as they come, to be dealt over blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of a group that one task holds.
MOST = 1 << 20
#: Groups in all while there are few entries: more make packs small, fewer make groups large.
GROUPS = 1024


def pack(bucket: np.ndarray, columns: list[np.ndarray], groups: int) -> pa.RecordBatch:
    """grp and, as bytes, the buckets and other numbers of the entries of each group."""
    group = (bucket.view(np.uint64) % np.uint64(groups)).astype(np.int32)
    order = np.argsort(group, kind="stable")
    group = group[order]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    offsets = pa.py_buffer((np.r_[start, len(group)] * 8).astype(np.int32))
    packed = [pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(np.ascontiguousarray(c[order]))]) for c in (bucket, *columns)]
    return pa.RecordBatch.from_arrays([pa.array(group[start]), *packed], names=["grp", *(f"c{i}" for i in range(len(packed)))])


def _grouped(width: int, work: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], single: Callable[[list[np.ndarray]], pa.RecordBatch], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = []
        group, count = None, 0

        def numbers(rows: list) -> list[np.ndarray]:
            return [np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in range(width)]

        def whole() -> Iterator[pa.RecordBatch]:
            if held and count <= most:
                columns = numbers(held)
                order = np.argsort(columns[0], kind="stable")
                yield from work([c[order] for c in columns])
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != group:
                    yield from whole()
                    group, count = row[0], 0
                held.append(row[1:])
                count += len(row[1]) // 8
                if count > most:
                    yield single(numbers(held))
                    held.clear()
        yield from whole()

    return run


def meet(packs: DataFrame, width: int, partitions: int, work, single, form: str, most: int = 0) -> DataFrame:
    """work gets the columns (bucket first) of each group in order of bucket, single those of a group that is too large, part by part."""
    return packs.repartition(partitions, "grp").sortWithinPartitions("grp").mapInArrow(_grouped(width, work, single, most or MOST), form)


def groups(partitions: int, entries: int) -> int:
    """How many groups: several for each partition, and so many that one of usual size is an eighth of what a task holds."""
    return max(GROUPS, 4 * partitions, entries // (MOST // 8))


def form(width: int) -> str:
    return ", ".join(["grp int", *(f"c{i} binary" for i in range(width))])
