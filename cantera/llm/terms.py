"""Terms of a text and their vertical layout.

Terms: the string is decomposed by Unicode compatibility (NFKD), combining marks are dropped, it is
lower-cased, and the maximal runs of a-z and 0-9 are its terms. A null or empty text has none.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUN = re.compile(r"[a-z0-9]+")
_MARKS = regex.compile(r"\p{M}+")

#: Records of one chunk of the vertical layout: a container holds 16-bit record numbers.
CHUNK_BITS = 16
#: In containers, stands for any term: it is held by every record that has a term, as often as the record has terms.
ANY = ""


def terms(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _RUN.findall(text.lower())


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A container per term and chunk of the ids met in a batch: the record numbers in order and, parallel to them, the occurrences and record lengths."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        vocabulary: dict[str, int] = {}
        codes, rows, counts, lengths = [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            found = Counter(terms(text))
            if found:
                found[ANY] = sum(found.values())
            codes += [vocabulary.setdefault(t, len(vocabulary)) for t in found]
            counts += found.values()
            rows += [row] * len(found)
            lengths += [found[ANY]] * len(found)
        if not codes:
            continue
        code, count, length, at = np.array(codes), np.array(counts, np.int32), np.array(lengths, np.int32), ids[np.array(rows)]
        chunk, low = at >> CHUNK_BITS, (at & ((1 << CHUNK_BITS) - 1)).astype(np.int32)
        order = np.lexsort((low, chunk, code))
        code, chunk, low, count, length = code[order], chunk[order], low[order], count[order], length[order]
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])])
        offsets = pa.array(np.r_[start, len(code)].astype(np.int32))
        words = np.array(list(vocabulary), dtype=object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words[code[start]], pa.string()), pa.array(chunk[start]), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (low, count, length))],
            names=["term", "chunk", "numbers", "counts", "lengths"],
        )


CONTAINERS = "term string, chunk bigint, numbers array<int>, counts array<int>, lengths array<int>"


def containers(df: DataFrame, key: str, text: str) -> DataFrame:
    """The vertical layout of a text column, not merged yet: several containers of one term and chunk may come, and repeated rows lie in several of them.

    Rows with a null key have no identity and are left out; null and empty texts have no terms. Other columns are ignored."""
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null").mapInArrow(_containers, CONTAINERS)
