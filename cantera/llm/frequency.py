"""Frequency of every distinct term: record bitmaps with parallel occurrence counters, merged by union (problem 3).

Each batch of records yields, for a term and a chunk of 65,536 record numbers, a container of sorted
numbers with parallel counters. Containers of one term and chunk are merged by union, so a record that
was delivered again is counted once; the merged container is compressed to a bitmap when it is dense and
to a sorted list otherwise. A term's record frequency is the sum of its containers' cardinalities.
No group is larger than a chunk, whatever the term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantera.llm.terms import ANY, CHUNK_BITS, containers
from cantera.session import fan_out, scratch, written

#: Above so many numbers a bitmap of 8 KB is not larger than the list of 16-bit numbers.
LIST_MOST = 4095


def compress(numbers: np.ndarray) -> bytes:
    """Sorted distinct 16-bit numbers as a bitmap or as a list, whichever is smaller."""
    if len(numbers) <= LIST_MOST:
        return numbers.astype("<u2").tobytes()
    bits = np.zeros(1 << CHUNK_BITS, np.uint8)
    bits[numbers] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def decompress(data: bytes) -> np.ndarray:
    if len(data) < (1 << CHUNK_BITS) // 8:
        return np.frombuffer(data, "<u2").astype(np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).astype(np.int32)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of each term's containers: rows come sorted by term and chunk, and may be cut by batches."""
    held: list = []  # term, chunk, [numbers], [counts] of the container that is still open
    out: list[tuple] = []

    def close() -> None:
        if held:
            numbers, counts = np.concatenate(held[2]), np.concatenate(held[3])
            numbers, first = np.unique(numbers, return_index=True)
            out.append((held[0], held[1], compress(numbers), len(numbers), int(counts[first].sum(dtype=np.int64))))

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["term", "chunk", "records", "n_records", "n_occurrences"])
        out.clear()
        return done

    for batch in batches:
        names, chunks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        numbers, counts = batch.column(2), batch.column(3)
        offsets = numbers.offsets.to_numpy()
        flat_n, flat_c = numbers.values.to_numpy(), counts.values.to_numpy()
        shift = counts.offsets.to_numpy() - offsets
        for i, (term, chunk) in enumerate(zip(names, chunks)):
            a, b = offsets[i], offsets[i + 1]
            n, c = flat_n[a:b], flat_c[a + shift[i] : b + shift[i]]
            if held and held[0] == term and held[1] == chunk:
                held[2].append(n), held[3].append(c)
                if len(held[2]) > 256:  # keeps an open container near the size of a chunk
                    every, first = np.unique(np.concatenate(held[2]), return_index=True)
                    held[2:] = [[every], [np.concatenate(held[3])[first]]]
            else:
                close()
                held[:] = [term, chunk, [n], [c]]
        if out:
            yield flush()
    close()
    if out:
        yield flush()


def _bitmaps(found: DataFrame, parts: int) -> DataFrame:
    return found.select("term", "chunk", "numbers", "counts").repartition(parts, "term", "chunk").sortWithinPartitions("term", "chunk").mapInArrow(_merge, "term string, chunk bigint, records binary, n_records bigint, n_occurrences bigint")


def term_bitmaps(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, chunk, records (a compressed bitmap of record numbers), n_records, n_occurrences: one row per term and chunk.

    Null keys are left out, null and empty texts have no terms, repeated rows count once; an empty table gives no rows."""
    return _bitmaps(containers(df, key, text).filter(F.col("term") != ANY), fan_out(df))


def totals(found: DataFrame, parts: int) -> DataFrame:
    """term, n_records, n_occurrences from containers, computed once; the row of the term ANY has the records with any term and all occurrences."""
    return written(_bitmaps(found, parts).groupBy("term").agg(F.sum("n_records").alias("n_records"), F.sum("n_occurrences").alias("n_occurrences")))


def term_frequency(df: DataFrame, key: str, text: str, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """term, n_occurrences, n_records, mark of every distinct term.

    mark: 'rare' when fewer than rare_below records hold the term, 'common' when more than the share common_above of
    the records that have any term hold it, else 'useful'; a term that is both is 'rare'. Null keys are left out, null
    and empty texts have no terms, repeated rows count once; an empty table gives no rows."""
    with scratch() as keep:
        return keep(_marked(totals(containers(df, key, text), fan_out(df)), rare_below, common_above))


def _marked(per_term: DataFrame, rare_below: int, common_above: float) -> DataFrame:
    every = per_term.filter(F.col("term") == ANY).select(F.col("n_records").alias("with_terms"))  # one row at most
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.lit(common_above) * F.col("with_terms"), "common").otherwise("useful")
    return per_term.filter(F.col("term") != ANY).join(F.broadcast(every)).select("term", "n_occurrences", "n_records", mark.alias("mark"))
