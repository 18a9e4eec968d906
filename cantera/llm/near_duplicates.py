"""Near-duplicate records with small edits (problem 2).

Records with the same set of runs form a class, which is compared once. A class gets one sketch by
one-permutation hashing: each run falls into one of BINS bins by its hash, a bin keeps its smallest; empty bins
borrow from a full bin that a universal hash of the bin and the attempt picks (optimal densification). Bands of
ROWS bins make buckets, and every two members of a bucket are compared. A bucket of at most HUBS + 1 members gives its
pairs as edges, each of which is checked exactly on the run sets. A larger one is cut into blocks of about
BLOCK members that meet pairwise: a task holds two blocks with their run sets, counts all the runs that two members share, and
gives the pairs that are similar enough; a pair that meets in several bands comes from the first of them.

The chance that a pair of similarity s meets in no bucket is (1 - s^ROWS)^BANDS: 2e-5 at 0.5 for the default
values, less above, whatever the size of its family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantera.llm import buckets
from cantera.llm.terms import terms
from cantera.session import fan_out, scratch, written

ROWS = 3
BANDS = 80
BINS = ROWS * BANDS
HUBS = 8
#: Members of a block of a bucket that has more than HUBS + 1 of them.
BLOCK = 1024
#: Run of a record's terms, and the terms that the second text must have.
RUN = 3
LEAST_TERMS = 10
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing (the finaliser of splitmix64; fixed constants)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def term_hashes(words: list[str]) -> np.ndarray:
    """64 bits of each term; a term that comes again is hashed once."""
    known: dict[str, int] = {}
    place = [known.setdefault(w, len(known)) for w in words]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[place] if words else np.zeros(0, np.uint64)


def run_hashes(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs, as 64-bit hashes, of texts given as the hashes of their terms with their text's number in order: texts' numbers and runs, sorted by both. A text shorter than n has none."""
    count = max(0, len(hashes) - n + 1)
    key = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            key = mixed(key * _MULTIPLIER + hashes[i : i + count])
    whole = owner[:count] == owner[len(owner) - count :]  # all n terms are of one text
    key, owner = key[whole], owner[:count][whole]
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])][: len(key)]
    return owner[new], key[new]


def runs(words: list[str], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the sequences of n consecutive terms; a shorter text has none."""
    return run_hashes(term_hashes(words), np.zeros(len(words), np.int64), n)[1]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            kept, words, size = [], [], []
            for i, (title, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                own = terms(text)
                if len(own) >= LEAST_TERMS:
                    before = len(words)
                    words += terms(title)  # a null title has none
                    words += own
                    kept.append(i)
                    size.append(len(words) - before)
            owner, key = run_hashes(term_hashes(words), np.repeat(np.arange(len(kept)), np.array(size, np.int64)), RUN)
            offsets = np.searchsorted(owner, np.arange(len(kept) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))], names=["id", "runs"])


def sketches(flat: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """The densified sketch, count x BINS, of sets given as flat hashes with their set's number; no set is empty."""
    h = mixed(flat)
    bins = (h % np.uint64(BINS)).astype(np.int64)
    full = np.full(count * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(full, owner * BINS + bins, h)
    sketch = full.reshape(count, BINS)
    empty = sketch == np.iinfo(np.uint64).max
    row, col = np.nonzero(empty)
    attempt = np.uint64(1)
    result = sketch.copy()
    while len(row):
        source = (mixed(col.astype(np.uint64) * _MULTIPLIER + attempt) % np.uint64(BINS)).astype(np.int64)
        good = ~empty[row, source]
        result[row[good], col[good]] = sketch[row[good], source[good]]
        row, col = row[~good], col[~good]
        attempt += np.uint64(1)
    return result


def band_keys(flat: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """The buckets, count x BANDS, of sets given as in sketches()."""
    sketch = sketches(flat, owner, count)
    with np.errstate(over="ignore"):
        key = np.zeros((count, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            key = mixed(key * _MULTIPLIER + sketch[:, r::ROWS])
    return key.view(np.int64)


def _bands(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.zeros(0, np.int64)]
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                held = part.column(1)
                owner = np.repeat(np.arange(part.num_rows), np.diff(held.offsets.to_numpy()))
                keys.append(band_keys(held.flatten().to_numpy().view(np.uint64), owner, part.num_rows).reshape(-1))
            yield buckets.pack(np.concatenate(keys), [np.repeat(batch.column(0).to_numpy(), BANDS)], groups)

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the hubs of each bucket; a partition holds its buckets whole and in order, and a batch may cut one."""
    bucket, hubs = None, np.zeros(0, np.int64)

    def star(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the run's members to the open bucket's hubs; new members become hubs while there are too few."""
        nonlocal hubs
        had = len(hubs)
        hubs = np.r_[hubs, run[: HUBS - had]]
        a, b = np.repeat(hubs, len(run)), np.tile(run, len(hubs))
        # A new hub meets later members only: each pair of hubs comes once.
        later = np.tile(np.arange(len(run)), len(hubs)) > np.repeat(np.r_[np.full(had, -1), np.arange(len(hubs) - had)], len(run))
        return a[later], b[later]

    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        end = np.r_[start[1:], len(keys)]
        out = []
        if keys[0] == bucket:
            out.append(star(ids[: end[0]]))
        # Whole buckets of few members go together, by size; others one by one.
        inner = np.flatnonzero((end - start > 1) & (np.arange(len(start)) < len(start) - 1) & ~((np.arange(len(start)) == 0) & (keys[0] == bucket)))
        size = end[inner] - start[inner]
        for g in np.unique(size):
            which = start[inner[size == g]]
            members = ids[which[:, None] + np.arange(g)]
            for hub in range(min(HUBS, g - 1)):
                out.append((np.repeat(members[:, hub], g - 1 - hub), members[:, hub + 1 :].reshape(-1)))
        if len(start) > 1 or keys[0] != bucket:
            bucket, hubs = keys[-1], np.zeros(0, np.int64)
            out.append(star(ids[start[-1] :]))
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, with whole buckets in a partition: the pairs of each bucket of at most HUBS + 1 members (a, b); of a larger one its members (a: id, bucket)."""

    def out(keys: np.ndarray, ids: np.ndarray, member: np.ndarray) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(int(member.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids[member]), none, pa.array(keys[member])], names=["a", "b", "bucket"])
        for star in _stars(iter([pa.RecordBatch.from_arrays([pa.array(keys[~member]), pa.array(ids[~member])], names=["bucket", "id"])])):
            yield pa.RecordBatch.from_arrays([star.column(0), star.column(1), pa.nulls(star.num_rows, pa.int64())], names=["a", "b", "bucket"])

    # A batch may cut a bucket: a small one is held back until its end, a large one is known by its key.
    held_keys, held_ids, known = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        keys, ids = np.r_[held_keys, batch.column(0).to_numpy()], np.r_[held_ids, batch.column(1).to_numpy()]
        if not len(keys):
            continue
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[start, len(keys)])
        large = (size > HUBS + 1) | (keys[start] == known if known is not None else False)
        cut = len(keys) if large[-1] else start[-1]
        known = keys[-1] if large[-1] else None
        held_keys, held_ids = keys[cut:], ids[cut:]
        yield from out(keys[:cut], ids[:cut], np.repeat(large, size)[:cut])
    yield from out(held_keys, held_ids, np.zeros(len(held_keys), bool))


def _pairs_of(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    return _buckets(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "id"])]))


def _members_of(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[1]), pa.nulls(len(columns[1]), pa.int64()), pa.array(columns[0])], names=["a", "b", "bucket"])


def shared_runs(flat: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """count x count: how many elements each two different sets have in common; the diagonal has no meaning."""
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(flat)])
    both = np.zeros(count * count, np.int32)
    often = size > max(8, count // 8)  # at most eight times the mean size of a set
    for g in np.unique(size[~often & (size > 1)]):
        which = start[size == g]
        step = max(1, (1 << 21) // int(g * g))
        for at in range(0, len(which), step):
            members = owner[which[at : at + step, None] + np.arange(g)]
            np.add.at(both, (members[:, :, None] * count + members[:, None, :]).reshape(-1), 1)
    both = both.reshape(count, count)
    first, step = np.flatnonzero(often), max(1, (1 << 22) // max(1, count))
    for at in range(0, len(first), step):
        some = first[at : at + step]
        held = np.zeros((len(some), count), np.float32)
        for r, f in enumerate(some):
            held[r, owner[start[f] : start[f] + size[f]]] = 1
        both += np.rint(held.T @ held).astype(np.int32)
    return both


def _blocks_meet(threshold: float):
    """Of two blocks of a bucket (or one with itself): its similar pairs that meet in no band before the bucket's."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, mine = rows["id"].to_numpy(), rows["mine"].to_numpy()
        lists = rows["runs"].chunk(0) if rows["runs"].num_chunks else pa.array([], pa.list_(pa.int64()))
        size = np.diff(lists.offsets.to_numpy())
        flat, owner = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(ids)), size)
        both = shared_runs(flat, owner, len(ids))
        similar = both / np.maximum(size[:, None] + size - both, 1)
        meet = (ids[:, None] < ids) & (similar >= threshold)
        if mine.min() != mine.max():
            meet &= mine[:, None] != mine
        keys = band_keys(flat, owner, len(ids))
        band = int((keys[0] == rows["bucket"][0].as_py()).argmax())
        i, j = np.nonzero(meet)
        new = np.ones(len(i), bool)
        for before in range(band):
            new &= keys[i, before] != keys[j, before]
        i, j = i[new], j[new]
        return pa.table([pa.array(ids[i]), pa.array(ids[j]), pa.array(similar[i, j])], names=["a", "b", "similarity"])

    return run


def run_sets(df: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """id, runs: the set of runs of each distinct record whose text has enough terms.

    The content is title and text, or only the text when the title is null. Null keys are left out, repeated rows count once."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(title).alias("title"), F.col(text).alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(_sets, "id bigint, runs array<bigint>").repartition(fan_out(df), "id").dropDuplicates(["id"])


def classes(sets: DataFrame) -> DataFrame:
    """id, class_id of each record: the class is the smallest id with the same set of runs. The set itself is compared through two independent hashes of 64 bits."""
    keyed = sets.select("id", F.xxhash64("runs").alias("h1"), F.xxhash64(F.lit(17), F.reverse("runs")).alias("h2"))
    least = keyed.groupBy("h1", "h2").agg(F.min("id").alias("class_id"))
    return keyed.join(least, ["h1", "h2"]).select("id", "class_id")


def similar_classes(sets: DataFrame, threshold: float, n: int) -> DataFrame:
    """a, b, similarity with a < b: the pairs of classes whose run sets have a Jaccard similarity of at least the threshold. sets holds one row per class, n at most."""
    parts = fan_out(sets, factor=4)
    bands = sets.repartition(parts, "id").mapInArrow(_bands(buckets.groups(parts, n * BANDS)), buckets.form(2))
    met = written(buckets.meet(bands, 2, parts, _pairs_of, _members_of, "a bigint, b bigint, bucket bigint"))
    edges = met.filter("bucket is null").select("a", "b").distinct()
    left = sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b"))
    both = F.size(F.array_intersect("runs_a", "runs_b")).cast("double")
    checked = edges.join(left, "a").join(right, "b")
    found = checked.select("a", "b", (both / (F.size("runs_a") + F.size("runs_b") - both)).alias("similarity")).filter(F.col("similarity") >= threshold)
    large = met.filter("bucket is not null").select("bucket", F.col("a").alias("id"))
    if large.isEmpty():
        return found
    sized = large.join(large.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "bucket")
    dealt = sized.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = dealt.join(sets, "id").select("bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "id", "runs")
    again = held.repartition(parts, "bucket", "low", "high").groupBy("bucket", "low", "high").applyInArrow(_blocks_meet(threshold), "a bigint, b bigint, similarity double")
    # A pair may also meet in a small bucket of a later band.
    return found.unionByName(again).dropDuplicates(["a", "b"])


def _found(df: DataFrame, key: str, title: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    with scratch() as keep:
        sets = written(run_sets(df, key, title, text))
        member = keep(classes(sets))
        heads = sets.join(member.filter("id = class_id").select("id"), "id", "left_semi")
        return member, keep(similar_classes(heads, threshold, member.count()))


def _expanded(member: DataFrame, links: DataFrame) -> DataFrame:
    """id_a, id_b, each pair once in either order: the pairs within classes and across linked ones. Classes of many copies are cut into blocks of about BLOCK that meet pairwise, so no task holds a whole one."""
    size = member.groupBy("class_id").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = member.join(size.filter("blocks > 1").select("class_id", "blocks"), "class_id", "left")
    held = dealt.select("id", "class_id", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0)).alias("block"))
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # A link comes once for each block of its first class, then once for each of its second: members join by class and block.
    same = size.filter("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    for side in "ab":
        own = size.select(F.col("class_id").alias(side), blocks.alias(f"block_{side}"))
        links, same = links.join(own, side), same.join(own, side)
    same = same.filter("block_a <= block_b")
    of_a, of_b = (held.select(F.col("id").alias(f"id_{x}"), F.col("class_id").alias(x), F.col("block").alias(f"block_{x}")) for x in "ab")
    met = links.select("a", "b", "block_a", "block_b").unionByName(same).join(of_a, ["a", "block_a"]).join(of_b, ["b", "block_b"])
    return met.filter("a <> b or block_a < block_b or id_a < id_b").select("id_a", "id_b")


def near_duplicate_pairs(df: DataFrame, key: str, title: str, text: str, threshold: float = 0.5) -> DataFrame:
    """id_a, id_b with id_a < id_b: every pair of distinct records whose run sets are at least so similar, copies included.

    Records whose text is null or has fewer than 10 terms are in no pair; null keys are left out; repeated rows count once; an empty table gives no rows."""
    with scratch() as keep:
        pairs = _expanded(*_found(df, key, title, text, threshold))
        return keep(pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")))


def near_duplicate_classes(df: DataFrame, key: str, title: str, text: str, threshold: float = 0.5) -> DataFrame:
    """id, class_id, n_copies, n_links of each record with enough terms: its class of records with the same runs, the class's size, and to how many other classes it is linked.

    Nulls, short texts, repeated rows and empty tables as in near_duplicate_pairs."""
    with scratch() as keep:
        member, links = _found(df, key, title, text, threshold)
        degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
        size = member.groupBy("class_id").agg(F.count("*").alias("n_copies"))
        per_class = size.join(degree, "class_id", "left").fillna(0, ["n_links"])
        return keep(member.join(per_class, "class_id").select("id", "class_id", "n_copies", "n_links"))
