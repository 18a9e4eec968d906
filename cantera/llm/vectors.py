"""Usable vectors of a table, shared by the similarity and clustering operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantera.session import fan_out


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """vec_id, vec (array<float>) of the distinct usable rows: a key, the full length, no null, NaN or infinite element, and not only zeros."""
    rows = df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<float>").alias("vec")).filter("vec_id is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter((F.size("vec") == dim) & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    return rows.repartition(fan_out(df, 2), "vec_id").dropDuplicates(["vec_id"])


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes, which cost the JVM one copy where a list costs one for each number."""
    raw = np.ascontiguousarray(x)
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * (raw.itemsize * raw.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def unpacked(column: pa.Array | pa.ChunkedArray, width: int, kind=np.float32) -> np.ndarray:
    """Rows of bytes, all of `width` numbers, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros((0, width), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample(df: DataFrame, most: int, dim: int, n: int) -> np.ndarray:
    """At most `most` unit vectors of the n in df, chosen by a hash of their id: the same for any partitioning, and of bounded size.

    Only vectors below a bound of the hash, about twice as many as wanted, go into the choice."""
    turn = F.xxhash64("vec_id")
    rows = df if n <= 4 * most else df.filter(turn < int(-(2**63) + 2**64 * (2 * most / n)))
    rows = rows.orderBy(turn, "vec_id").limit(most).select("vec").toArrow()
    return unit(matrix(rows.column(0), dim)) if rows.num_rows else np.zeros((0, dim))
