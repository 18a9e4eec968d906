"""Most similar vectors by multi-index hashing over learned rotated binary codes (problem 1).

The model is learned on a bounded sample: CELLS coarse centres, and rotations of the vectors' residuals to
their centre that lose least when only signs are kept (alternating sign step and orthogonal Procrustes
step). The signs are a vector's code. Residuals matter: within a dense group all vectors have
nearly the same direction, so codes of the directions themselves would tell them apart no more.

The code is split into substrings, each with its own index of buckets (centre, substring number, substring). By
the pigeonhole principle two codes that differ in fewer bits than there are substrings agree in one of
them, so reading each vector's own buckets retrieves every code within that radius, and most beyond. How wide and how
many the substrings are follows from the data: the sample tells which share of its bits a code changes on the way to a vector that is
just similar enough, or as far as the k-th nearest (in a tight group more than among scattered vectors), and how often any two vectors agree in so
many bits. Of the widths, each with as many substrings as reach RECALL at that distance, the cheapest for the number of
vectors is taken. Pairs that meet are thinned by the Hamming distance of SKETCH spread bits of the code, by a radius found in the same way, and
cosines are worked out on the floats.

A vector is at home in its nearest cell, and visits every other one when half the distance of two
vectors that are just similar enough takes it over the border, the plane between the two centres. The way between two such vectors with different homes crosses
that plane, so one of them is as near to it as that and visits the other's home: near vectors always meet, at the home of at least one of them, and visitors need not meet each other.

Copies: of the vectors with equal elements only the k + 1 smallest ids take part, as no vector can
have more of them among its k most similar when ties go to the smaller id; one of them is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantera.llm import buckets
from cantera.llm.near_duplicates import mixed
from cantera.llm.vectors import matrix, packed, sample, unit, unpacked, usable
from cantera.session import fan_out, scratch, written

#: Vectors that the model is learned on; the index holds all.
SAMPLE = 16_384
CELLS = 64
#: Share of pairs at the least cosine that are to share a substring, and share of those that the sketch keeps.
RECALL = 0.999
SKETCHED = 0.9999
WIDTHS = range(4, 33)
#: Where the sample asks for more, as where all vectors are alike, the narrowest are taken.
MOST_SUBSTRINGS = 512
#: Costs of comparing two sketches, and of a pair that goes on to the floats, in index entries.
COMPARED = 0.01
JOINED = 6
#: Bits of a sketch; one more tells whether the vector is at home in the cell.
SKETCH = 127
#: Tasks over which the later copies of one vector are spread.
SALT = 64
#: Rows of a bucket that one task compares at once; beyond, the bucket is split into blocks that meet pairwise.
BLOCK = 4096


@dataclass
class Codes:
    """Centres (cells x dim), rotations (bits x dim), how the code is cut, and the bits by which two sketches may differ."""

    centres: np.ndarray
    rotations: np.ndarray
    width: int
    substrings: int
    radius: int = SKETCH

    def homes(self, x: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
        """The home of each unit vector, and (vectors x cells) where it is at home or visits, for vectors that meet up to `apart` from each other."""
        square = (self.centres**2).sum(1) - 2 * (x @ self.centres.T)
        home = square.argmin(1)
        gaps = np.linalg.norm(self.centres[:, None] - self.centres[None], axis=2)
        return home, square - square[np.arange(len(x)), home][:, None] <= apart * gaps[home] + 1e-9

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Distances of unit vectors to the centres."""
        square = 1 + (self.centres**2).sum(1) - 2 * (x @ self.centres.T)
        return np.sqrt(np.maximum(square, 0))

    def bits(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return ((x - self.centres[cell]) @ self.rotations.T) > 0


def centres_of(x: np.ndarray, cells: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Centres of a sample: k-means from seeds drawn by squared distance."""
    centres = x[rng.integers(len(x), size=1)]
    least = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(cells, len(x)) and least.sum() > 1e-9:
        new = x[rng.choice(len(x), p=least / least.sum())]
        centres = np.vstack([centres, new])
        least = np.minimum(least, ((x - new) ** 2).sum(1))
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
        size = np.bincount(own, minlength=len(centres))
        member = np.zeros((len(x), len(centres)), np.float32)
        member[np.arange(len(x)), own] = 1
        sums = member.T @ x
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of the bits of a random rotation in which the rows of a and b differ: their angle over pi."""
    lengths = np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1)
    cos = np.divide((a * b).sum(-1), lengths, out=np.ones_like(lengths), where=lengths > 1e-12)
    return np.arccos(np.clip(cos, -1, 1)) / math.pi


def partners(x: np.ndarray, own: np.ndarray, cosine: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each row of x a unit vector with the given cosine to it: every other one towards a row of the same cell, the others anywhere."""
    order = np.argsort(own, kind="stable")
    other = x[order[np.minimum(np.searchsorted(own[order], own) + (rng.random(len(x)) * np.bincount(own)[own]).astype(int), len(x) - 1)]] - x
    anywhere = rng.standard_normal(x.shape)
    way = np.where((np.arange(len(x)) % 2 == 0)[:, None] & (np.linalg.norm(other, axis=1) > 1e-9)[:, None], other, anywhere)
    way -= (way * x).sum(1, keepdims=True) * x
    length = np.linalg.norm(way, axis=1, keepdims=True)
    return cosine[:, None] * x + np.sqrt(np.maximum(0.0, 1 - cosine**2))[:, None] * np.divide(way, length, out=np.zeros_like(way), where=length > 1e-12)


def farthest_wanted(x: np.ndarray, rows: np.ndarray, n: int, least: float, k: int) -> np.ndarray:
    """The least cosine that one of the k most similar of n vectors has to some rows of the sample x, as far as the sample tells, but not below `least`."""
    rank = min(len(x) - 1, max(1, math.ceil(k * len(x) / n)))
    y, out = x.astype(np.float32), np.full(len(rows), least)
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        if rank:
            cos = y[some] @ y.T
            cos[np.arange(len(some)), some] = -2
            out[at : at + 256] = np.maximum(least, np.minimum(-np.partition(-cos, rank - 1, axis=1)[:, rank - 1], 1 - 1e-6))
    return out


def cut(x: np.ndarray, centres: np.ndarray, n: int, least: float, k: int, rng: np.random.Generator) -> tuple[int, int, int]:
    """Width and number of substrings, and the sketch's radius, for n vectors of which x is a sample."""
    rows = rng.permutation(len(x))[:2048]
    wanted = farthest_wanted(x, rows, n, least, k)
    x = x[rows]
    own = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
    rest = x - centres[own]
    length = np.linalg.norm(rest, axis=1)
    some = length > 1e-9  # else the vector is a centre
    if not some.any():
        return WIDTHS[0], 1, SKETCH
    changed = _apart(rest, partners(x, own, wanted, rng) - centres[own])[some]
    rest, own, length = rest[some], own[some], length[some]
    i, j = np.nonzero((own[:, None] == own) & ~np.eye(len(rest), dtype=bool))
    alike = 1 - np.arccos(np.clip((rest @ rest.T)[i, j] / (length[i] * length[j]), -1, 1)) / math.pi
    # The share of sketches that differ in at most r bits, for r from 0 on: binomial.
    chance, radius = (1 - changed) ** SKETCH, 0
    total = chance.copy()
    while radius < SKETCH and np.mean(total) < SKETCHED:
        radius += 1
        chance = chance * (SKETCH - radius + 1) / radius * changed / np.maximum(1 - changed, 1e-12)
        total += chance
    off = (radius + 0.5 - SKETCH * (1 - alike)) / np.sqrt(np.maximum(SKETCH * alike * (1 - alike), 1e-9))
    kept = 1 / (1 + np.exp(np.clip(-1.702 * off, -50, 50)))  # any two that the sketch keeps
    best, agree, two = (math.inf, WIDTHS[0], MOST_SUBSTRINGS), alike ** (WIDTHS[0] - 1), max(1, len(rest) * (len(rest) - 1))
    for width in WIDTHS:
        agree = agree * alike
        meets = (1 - changed) ** width
        number = 1
        while number <= MOST_SUBSTRINGS and np.mean(1 - (1 - meets) ** number) < RECALL:
            number += max(1, number // 16)
        joined = n * float((kept * (1 - (1 - agree) ** number)).sum()) / two
        cost = number * (1 + COMPARED * n * float(agree.sum()) / two) + JOINED * joined
        if number <= MOST_SUBSTRINGS and cost < best[0]:
            best = (cost, width, number)
    return best[1], best[2], radius


def learn(x: np.ndarray, n: int, least: float = 0.996, k: int = 10, cells: int = CELLS, bits: int = 0, seed: int = 7) -> Codes:
    """The model from a sample x of unit vectors, for n vectors in all, of which the k most similar of each with a cosine of at least `least` are to meet. With bits, a code of so many of them that isn't cut."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    if not len(x):
        return Codes(np.zeros((1, dim)), rng.standard_normal((max(bits, 8), dim)), max(bits, 8), 1)
    centres = centres_of(x, max(1, min(cells, len(x) // 16)), rng)
    width, number, radius = (bits, 1, SKETCH) if bits else cut(x, centres, n, least, k, rng)
    own = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
    rest = x - centres[own]
    rest /= np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-9)
    rotations = []
    many = bits or max(width * number, SKETCH)
    while len(rotations) * dim < many:
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(8 if len(rotations) < 16 else 0):  # beyond, random ones do
            u, _, vt = np.linalg.svd(np.sign(rest @ r.T).T @ rest)
            r = u @ vt
        rotations.append(r)
    return Codes(centres, np.vstack(rotations)[:many], width, number, radius)


def border_margin(least: float) -> float:
    """The distance of unit vectors with a cosine of `least`."""
    return math.sqrt(2 * max(0.0, 1 - least))


def _indexed(codes: Codes, dim: int, margin: float, groups: int):
    weights = (1 << np.arange(codes.width)).astype(np.int64)
    spread = np.arange(SKETCH) * len(codes.rotations) // SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 4]
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = unit(matrix(part.column(1), dim))
                home, visits = codes.homes(x, margin)
                row, cell = np.nonzero(visits)
                bits = codes.bits(x[row], cell)
                value = bits[:, : codes.substrings * codes.width].reshape(len(row), codes.substrings, codes.width) @ weights
                with np.errstate(over="ignore"):
                    place = (cell[:, None] * codes.substrings + np.arange(codes.substrings)).astype(np.uint64)
                    bucket = mixed(mixed(place) + value.astype(np.uint64))
                sketch = np.ascontiguousarray(np.packbits(np.c_[bits[:, spread], home[row] == cell], axis=1)).view(">u8").astype(np.int64)
                ids = part.column(0).to_numpy()[row]
                found.append((bucket.reshape(-1).view(np.int64), *(np.repeat(c, codes.substrings) for c in (ids, sketch[:, 0], sketch[:, 1]))))
            bucket, *rest = (np.concatenate(c) for c in zip(*found))
            yield buckets.pack(bucket, rest, groups)

    return run


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Sketches (..., 2) that differ in few bits, one of them of a vector at home."""
    apart = (a ^ b).view(np.uint64)
    return (np.bitwise_count(apart[..., 0]) + np.bitwise_count(apart[..., 1] & ~np.uint64(1)) <= radius) & ((a[..., 1] | b[..., 1]) & 1 == 1)


def _pairs_within(ids: np.ndarray, sketch: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Pairs of a bucket whose sketches are close, a stretch of rows against all later ones."""
    step = max(1, (1 << 19) // len(ids))
    for at in range(0, len(ids) - 1, step):
        head = np.arange(at, min(at + step, len(ids)))
        i, j = np.nonzero(_close(sketch[head][:, None], sketch[None, at:], radius))
        later = j + at > i + at
        yield np.stack([ids[head[i[later]]], ids[j[later] + at]], 1)


def _meeting(radius: int, limit: int):
    """Of rows sorted by bucket: the close pairs of each bucket; of a bucket of more than `limit` rows its rows instead (a: bucket, b: id, sketch in two numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []  # of the open bucket
        count, over, key = 0, False, None

        def out(pairs: list[np.ndarray], rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            p = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            p = np.unique(np.sort(p[p[:, 0] != p[:, 1]], axis=1), axis=0)
            k, i, s = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
            mask = np.r_[np.ones(len(p), bool), np.zeros(len(s), bool)]
            sketch = [pa.array(np.r_[np.zeros(len(p), np.int64), s[:, w]], mask=mask) for w in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(np.r_[p[:, 0], k]), pa.array(np.r_[p[:, 1], i]), *sketch], names=["a", "b", "s1", "s2"])

        for batch in batches:
            bucket, ids = (batch.column(c).to_numpy() for c in range(2))
            if not len(ids):
                continue
            sketch = np.stack([batch.column(c).to_numpy() for c in (2, 3)], 1)
            pairs, rows = [], []
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            end = np.r_[start[1:], len(bucket)]
            size = end - start
            inner = np.arange(1, len(start) - 1)
            for g in np.unique(size[inner]):
                first = start[inner[size[inner] == g]]
                if g == 1:
                    continue
                if g > 64:
                    for f in first:
                        if g > limit:
                            rows.append((bucket[f : f + g], ids[f : f + g], sketch[f : f + g]))
                        else:
                            pairs += _pairs_within(ids[f : f + g], sketch[f : f + g], radius)
                    continue
                i, j = np.triu_indices(g, 1)
                step = max(1, (1 << 19) // len(i))
                for at in range(0, len(first), step):
                    a, b = first[at : at + step, None] + i, first[at : at + step, None] + j
                    near = _close(sketch[a], sketch[b], radius)
                    pairs.append(np.stack([ids[a[near]], ids[b[near]]], 1))
            for n in dict.fromkeys((0, len(start) - 1)):  # these may go on in other batches
                part = slice(start[n], end[n])
                if bucket[start[n]] != key:
                    if kept and not over:
                        pairs += _pairs_within(np.concatenate([x[1] for x in kept]), np.concatenate([x[2] for x in kept]), radius)
                    kept, count, over, key = [], 0, False, bucket[start[n]]
                kept.append((bucket[part], ids[part], sketch[part]))
                count += end[n] - start[n]
                over = over or count > limit
                if over:
                    rows += kept
                    kept = []
            if pairs or rows:
                yield out(pairs, rows)
        if kept and not over:
            yield out([*_pairs_within(np.concatenate([x[1] for x in kept]), np.concatenate([x[2] for x in kept]), radius)], [])

    return run


_MET = "a bigint, b bigint, s1 bigint, s2 bigint"


def _met(radius: int, limit: int):
    meeting = _meeting(radius, limit)
    return lambda columns: meeting(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "id", "s1", "s2"])]))


def _singly(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "s1", "s2"])


def _candidates(heads: DataFrame, n: int, codes: Codes, dim: int, margin: float) -> DataFrame:
    """a, b: the distinct pairs of the n indexed vectors that meet in a bucket with close codes."""
    parts = fan_out(heads, factor=codes.substrings / 4)
    packs = heads.select("vec_id", "vec").mapInArrow(_indexed(codes, dim, margin, buckets.groups(parts, 2 * n * codes.substrings)), buckets.form(4))
    met = written(buckets.meet(packs, 4, parts, _met(codes.radius, BLOCK), _singly, _MET))
    pairs = met.filter("s1 is null").select("a", "b")
    large = met.filter("s1 is not null").select(F.col("a").alias("bucket"), F.col("b").alias("id"), "s1", "s2")
    if not large.isEmpty():  # exact, in pairs of blocks: each task holds two blocks at most
        half = BLOCK // 4  # blocks are cut by hash and may turn out larger than they should
        sized = large.join(large.groupBy("bucket").agg(F.ceil(F.count("*") / half).cast("int").alias("blocks")), "bucket")
        mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        spread = sized.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keyed = spread.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "id", "s1", "s2")
        again = keyed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meeting(codes.radius, 1 << 62), _MET)
        pairs = pairs.unionByName(again.select("a", "b"))
    return pairs.distinct()


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = matrix(batch.column(2), dim), matrix(batch.column(3), dim)
            dot = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(dot, 12))], names=["a", "b", "cosine"])

    return run


def _cosine_pairs(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    left = vectors.select(F.col("vec_id").alias("a"), F.col("vec").alias("vec_a"))
    right = vectors.select(F.col("vec_id").alias("b"), F.col("vec").alias("vec_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "vec_a", "vec_b").mapInArrow(_cosines(dim), "a bigint, b bigint, cosine double")


def _hashed(base: DataFrame) -> DataFrame:
    """Equal vectors are told by two hashes of 64 bits."""
    return base.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(17), F.reverse("vec")))


def _few_copies(base: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of each vector, with their place and the smallest of them, the head."""
    order = Window.partitionBy("h1", "h2").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _hashed(base).withColumns({"place": F.row_number().over(order), "head": F.first("vec_id").over(order)}).filter(F.col("place") <= k + 1)


def _later_copies(base: DataFrame, few: DataFrame, k: int) -> DataFrame:
    """vec, other, cosine, rank of the copies after the k + 1 smallest ids of a vector: their k most similar are those with the k smallest ids. A mass of copies of one vector is spread over SALT tasks."""
    rows = _hashed(base).select("vec_id", "h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)).alias("salt"))
    full = few.filter(F.col("place") == k + 1).select("h1", "h2", F.col("vec_id").alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("salt"))
    late = rows.join(full, ["h1", "h2", "salt"]).filter("vec_id > last").select("h1", "h2", "salt", F.col("vec_id").alias("vec"))
    first = few.filter(F.col("place") <= k).join(full.select("h1", "h2", "salt"), ["h1", "h2"]).select("h1", "h2", "salt", F.col("vec_id").alias("other"), F.col("place").alias("rank"))
    return late.join(first, ["h1", "h2", "salt"]).select("vec", "other", F.lit(1.0).alias("cosine"), "rank")


def neighbours_above(df: DataFrame, key: str, vector: str, dim: int, k: int = 10, least: float = 0.996, late: bool = True) -> DataFrame:
    """vec, other, cosine, rank: for each usable vector those of its k most similar others that have a cosine of at least `least`.

    Ties go to the smaller id. Without late, the copies of a vector after the k + 1 smallest ids have no rows: they are in nobody's list.
    Null keys and unusable vectors are left out, repeated rows count once, other columns are ignored; an empty table gives no rows."""
    with scratch() as keep:
        base = usable(df, key, vector, dim)
        if late:
            base = written(base, fan_out(df, 2))
        every = written(_few_copies(base, k), None if late else fan_out(df, 2))
        heads = every.filter("place = 1")
        n = heads.count()
        codes = learn(sample(heads, SAMPLE, dim, n), n, least, k)
        near = written(_cosine_pairs(_candidates(heads, n, codes, dim, border_margin(least)), heads, dim).filter(F.col("cosine") >= least))
        near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
        # From heads to the copies that take part; where there are few, they go to the pairs.
        extra = written(every.filter("place > 1").select("vec_id", "head"))
        for side in "ab":
            copies = near.join(extra.withColumnRenamed("head", side), side).withColumn(side, F.col("vec_id")).drop("vec_id")
            near = near.unionByName(copies)
        across = near.select(F.col("a").alias("vec"), F.col("b").alias("other"), "cosine")
        same = extra.unionByName(extra.select(F.col("head").alias("vec_id"), "head").distinct())
        within = same.withColumnRenamed("vec_id", "vec").join(same.withColumnRenamed("vec_id", "other"), "head").filter("vec <> other").select("vec", "other", F.lit(1.0).alias("cosine"))
        order = Window.partitionBy("vec").orderBy(F.desc("cosine"), "other")
        found = across.unionByName(within).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return keep(found.unionByName(_later_copies(base, every, k)) if late else found)


def mutual_pairs(found: DataFrame) -> DataFrame:
    """vec_a, vec_b with vec_a < vec_b: the pairs in which each is among the other's neighbours."""
    return found.groupBy(F.least("vec", "other").alias("vec_a"), F.greatest("vec", "other").alias("vec_b")).agg(F.count("*").alias("sides")).filter("sides = 2").select("vec_a", "vec_b")


# --- the k nearest of given queries, however far ---

#: Bits of a whole code, cells that a query looks into at the first NEAR_CELLS cells, codes of each block that are compared on floats, and rows of a block.
CODE_BITS = 256
NEAR_CELLS = 64
PROBES = 16
SHORTLIST = 200
CELL_BLOCK = 32768


def cells_for(n: int) -> tuple[int, int]:
    """How many cells n vectors have and how many of them a query looks into. Both grow, the cells with the square root of n and the probes with that of the cells, so the part that a query reads shrinks; the sample bounds the cells to a sixteenth of it."""
    cells = int(min(SAMPLE // 16, max(NEAR_CELLS, math.sqrt(n) / 8)))
    return cells, round(PROBES * math.sqrt(cells / NEAR_CELLS))


def _coded(codes: Codes, dim: int, probes: int):
    """Each vector with its code for its nearest cells: cell, vec_id, code, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = matrix(part.column(1), dim)
                x = unit(raw)
                far = codes.nearest(x)
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                row, cell = np.repeat(np.arange(len(x)), near.shape[1]), near.reshape(-1)
                code = np.packbits(codes.bits(x[row], cell), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column(0).take(pa.array(row)), packed(code), packed(raw[row].astype(np.float32))], names=["cell", "vec_id", "code", "vec"])

    return run


def _best_of_blocks(k: int, dim: int, shortlist: int):
    """Rows come by cell and block, the block's vectors (asked = 0) before the queries that look into it: a task holds one block, queries stream by."""

    def answer(block: tuple, ids: np.ndarray, code: np.ndarray, vec: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        d_ids, d_code, d_vec = block
        keep = min(shortlist, len(d_ids))
        for at in range(0, len(ids), 64):
            some = slice(at, at + 64)
            apart = np.zeros((len(ids[some]), len(d_ids)), np.uint16)
            for w in range(d_code.shape[1]):
                apart += np.bitwise_count(code[some, w, None] ^ d_code[None, :, w])
            near = np.argpartition(apart, keep - 1, axis=1)[:, :keep]
            q, d = vec[some].astype(np.float64), d_vec[near].astype(np.float64)
            cosine = np.round(np.einsum("qd,qnd->qn", q, d) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=2)), 12)
            cosine[d_ids[near] == ids[some, None]] = -np.inf  # itself
            order = np.lexsort((d_ids[near], -cosine), axis=1)[:, :k]
            best, other = np.take_along_axis(cosine, order, 1), d_ids[np.take_along_axis(near, order, 1)]
            row, column = np.nonzero(best > -np.inf)
            yield ids[some][row], other[row, column], best[row, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, block = None, [], None
        for batch in batches:
            cell, number, asked, ids = (batch.column(c).to_numpy() for c in range(4))
            if not len(ids):
                continue
            words = len(batch.column(4)[0].as_py()) // 8
            code, vec = unpacked(batch.column(4), words, np.uint64), unpacked(batch.column(5), dim)
            new = np.r_[True, (cell[1:] != cell[:-1]) | (number[1:] != number[:-1]) | (asked[1:] != asked[:-1])]
            start = np.flatnonzero(new)
            out = []
            for a, b in zip(start, np.r_[start[1:], len(ids)]):
                if (cell[a], number[a]) != place:
                    place, parts, block = (cell[a], number[a]), [], None
                if not asked[a]:
                    parts.append((ids[a:b], code[a:b], vec[a:b]))
                elif parts or block:
                    block = block or tuple(np.concatenate(c) for c in zip(*parts))
                    parts = []
                    out += answer(block, ids[a:b], code[a:b], vec[a:b])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["vec", "other", "cosine"])

    return run


def nearest_of(df: DataFrame, key: str, vector: str, dim: int, every_nth: int = 100, k: int = 10) -> DataFrame:
    """vec, other, cosine, rank: the k most similar others of each usable vector whose id is divisible by every_nth (1: of every vector), among all usable vectors.

    A radius of many bits would have the substrings' buckets probed almost all, so here a query looks through the whole codes of its
    nearest cells, block by block, and compares the SHORTLIST nearest codes of each block on floats. Each vector is sent once, to its cell and block; cells with many
    rows are cut into blocks, and the queries that look into a block stream by it, so no task holds more than one block. Ties go to the smaller id; of more than k + 1 copies of a
    vector the smallest ids are found. Null keys, unusable vectors, repeated rows and empty tables as in neighbours_above."""
    with scratch() as keep:
        base = written(usable(df, key, vector, dim), fan_out(df, 2))
        every = written(_few_copies(base, k).select("vec_id", "vec"), fan_out(df, 2))
        n = every.count()
        cells, probes = cells_for(n)
        codes = learn(sample(every, SAMPLE, dim, n), n, cells=cells, bits=CODE_BITS)
        form = "cell int, vec_id bigint, code binary, vec binary"
        data = written(every.mapInArrow(_coded(codes, dim, 1), form))
        blocks = written(data.groupBy("cell").agg(F.ceil(F.count("*") / CELL_BLOCK).cast("int").alias("blocks")))  # at most SAMPLE / 16 rows
        dealt = data.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        asked = base.filter(F.col("vec_id") % every_nth == 0).mapInArrow(_coded(codes, dim, probes), form).join(F.broadcast(blocks), "cell")
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        columns = ["cell", "block", "asked", "vec_id", "code", "vec"]
        met = dealt.withColumn("asked", F.lit(0)).select(*columns).unionByName(asked.withColumn("asked", F.lit(1)).select(*columns))
        met = met.repartition(fan_out(df, 4), "cell", "block").sortWithinPartitions("cell", "block", "asked")
        found = met.mapInArrow(_best_of_blocks(k, dim, SHORTLIST), "vec bigint, other bigint, cosine double")
        order = Window.partitionBy("vec").orderBy(F.desc("cosine"), "other")
        return keep(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
