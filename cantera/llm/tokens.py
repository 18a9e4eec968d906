"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

A batch's texts are cut by the tokenizer's pattern, its distinct words go through merge rounds together:
the symbols of all words lie in one flat array; the pairs of neighbours are looked up by binary search in
the sorted keys of the merge table; in each round every word merges its lowest-ranked pair, wherever the
word has it. Words without a pair left leave the array. Word ids are then gathered into text ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.session import near_file, sent_file

#: Where the driver finds the vocabulary files of public tokenizers, see the README there; a parameter of every operator here. Executors get the file they need.
TOKENIZERS = "/opt/tokenizers"
#: The usual pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids from batch to batch of a task.
CACHED_WORDS = 200_000
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary and its merges, ready for batches of words."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.base[byte] = ids[char]
        self.size = max(ids.values()) + 1
        left, right, made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in merges)))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}
        self.flat, self.start = [np.zeros(0, np.int32)], [0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a flat array, and where each word begins (one more for the end)."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.base[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], _NONE)
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, _NONE], begin)
            span = np.diff(np.r_[begin, len(owner)])
            mine = np.repeat(lowest, span)
            over = mine == _NONE
            if over.any():  # these words are whole
                done.append((owner[over], symbols[over]))
                keep = ~over
                symbols, owner, mine = symbols[keep], owner[keep], mine[keep]
                rank = np.r_[rank, _NONE][keep][:-1] if keep.any() else rank[:0]
                at = np.r_[at, 0][keep][:-1] if keep.any() else at[:0]
                if not len(symbols):
                    break
            hit = np.r_[(rank == mine[:-1]) & (owner[:-1] == owner[1:]), False]
            place = np.flatnonzero(hit)
            # Of overlapping places (a run of one symbol) the first, third ... merge.
            first = np.r_[True, np.diff(place) > 1]
            since = np.arange(len(place)) - np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
            place = place[since % 2 == 0]
            symbols[place] = self.made[at[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols):
            done.append((owner, symbols))
        owner, symbols = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(words))
        return symbols[order].astype(np.int32), np.r_[0, np.cumsum(counts)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a flat array and the texts' offsets in it; a null or empty text has no ids."""
        if len(self.cache) > CACHED_WORDS:
            self.cache, self.flat, self.start = {}, [np.zeros(0, np.int32)], [0]
        known = len(self.cache)
        number: list[int] = []
        per_text = np.zeros(len(texts), np.int64)
        cache = self.cache
        for i, text in enumerate(texts):
            if text:
                words = self.pattern.findall(text)
                number += [cache.setdefault(w, len(cache)) for w in words]
                per_text[i] = len(words)
        if len(cache) > known:
            new = [w.encode("utf-8", "surrogatepass") for w in list(cache)[known:]]
            flat, start = self.merge(new)
            self.start += (start[1:] + self.start[-1]).tolist()
            self.flat.append(flat)
            self.flat = [np.concatenate(self.flat)]
        start, of = np.array(self.start, np.int64), np.array(number, np.int64)
        size = start[of + 1] - start[of] if len(of) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        into = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        ids = self.flat[0][np.repeat(start[of], size) + into] if len(of) else np.zeros(0, np.int32)
        return ids, np.r_[0, np.r_[0, ends][np.cumsum(per_text)]]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _path(tokenizer: str, folder: str) -> str:
    return f"{folder}/{tokenizer}.json"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(near_file(path))
        for batch in batches:
            # A few thousand characters to some megabytes a text: slices keep the flat arrays small.
            texts = batch.column(1)
            for at in range(0, batch.num_rows, SLICE):
                ids, offsets = bpe.encode(texts.slice(at, SLICE).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, SLICE), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["key", "ids"])

    return run


#: Texts whose symbols are merged together.
SLICE = 1000


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, ids (array<int>) of every row, without special tokens; strings of special tokens in a text are ordinary text.

    Null and empty texts give an empty list; rows come as often as they are in df, a null key stays null; other columns are ignored."""
    kind = df.schema[key].dataType.simpleString()
    sent_file(df.sparkSession, _path(tokenizer, folder))
    done = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_encode(_path(tokenizer, folder)), f"key {kind}, ids array<int>")
    return done.select(F.col("key").alias(key), "ids")


def token_count(text: Column, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Number of tokens of a text; 0 for null and empty texts."""
    path = _path(tokenizer, folder)
    sent_file(SparkSession.active(), path)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        bpe = load(near_file(path))
        return pa.concat_arrays([pa.array(np.diff(bpe.encode(texts.slice(at, SLICE).to_pylist())[1])) for at in range(0, len(texts), SLICE)] or [pa.array([], pa.int64())])

    return count(text)
