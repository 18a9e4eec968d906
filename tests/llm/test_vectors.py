"""Similar vectors and clusters against brute force."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantera.llm import clusters, similar_vectors
from cantera.llm.vectors import usable


def table(spark, x, extra=()):
    rows = [(int(i), [float(v) for v in r]) for i, r in x]
    df = spark.createDataFrame([*rows, *extra], "vec_id bigint, v array<float>")
    return df.withColumns({c: F.lit("x") for c in ("vec", "id", "bucket", "cell", "group", "cosine", "place")})


def dirty(dim):
    nan = float("nan")
    return [(None, [1.0] * dim), (90001, None), (90002, [1.0] * (dim - 1)), (90003, [nan] + [1.0] * (dim - 1)), (90004, [0.0] * dim), (90005, [float("inf")] * dim), (90006, [None] + [1.0] * (dim - 1)), (90007, [])]


def grouped(seed=0, dim=20, groups=6, noise=60):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(12 + 25 * g):
            rows.append(c * rng.uniform(50, 200) + rng.standard_normal(dim) * 6)
    rows = [np.asarray(r) / np.linalg.norm(r) * rng.uniform(1, 50) for r in rows]
    rows += list(rng.standard_normal((noise, dim)) * 10)
    for i in range(0, 40):
        rows.append(rows[i] + rng.standard_normal(dim) * np.linalg.norm(rows[i]) * 0.003)  # near copies
    rows += [rows[3]] * 14 + [rows[-1]] * 2  # copies, more than k
    return [(i + 1, np.float32(r)) for i, r in enumerate(rows)]


def brute(x, k=10, least=0.996):
    ids, v = np.array([i for i, _ in x]), np.stack([r for _, r in x]).astype(float)
    n = np.sqrt((v * v).sum(1))
    cos = np.round(v @ v.T / np.outer(n, n), 9)
    top = {}
    for r, i in enumerate(ids):
        order = sorted((-cos[r, c], ids[c]) for c in range(len(ids)) if c != r)[:k]
        top[int(i)] = {int(b): -s for s, b in order}
    return {(a, b) for a in top for b, s in top[a].items() if a < b and a in top[b] and s >= least}, top


def test_usable(spark):
    df = table(spark, [(1, np.ones(4)), (1, np.ones(4)), (2, -np.ones(4))], dirty(4))
    assert sorted(r["vec_id"] for r in usable(df, "vec_id", "v", 4).collect()) == [1, 2]


@pytest.mark.parametrize("block, most", [(4, 1 << 20), (4096, 1 << 20), (4, 100)])
def test_mutual_neighbours(spark, monkeypatch, block, most):
    monkeypatch.setattr(similar_vectors, "BLOCK", block)  # with small blocks, buckets are split and meet block by block
    monkeypatch.setattr(similar_vectors.buckets, "MOST", most)
    x = grouped()
    want, _ = brute(x)
    df = table(spark, x, dirty(20) + [(1, [float(v) for v in x[0][1]])])
    got = [tuple(r) for r in similar_vectors.mutual_pairs(similar_vectors.neighbours_above(df, "vec_id", "v", 20)).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(got) >= 0.98 * len(want) and len(want) > 60


def test_near_vectors_share_a_cell():
    """Pairs just similar enough on two sides of a border: one of them is at the other's home, with half the reach some are not."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((64, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    codes = similar_vectors.Codes(centres, np.zeros((1, 8)), 1, 1)
    x = rng.standard_normal((100_000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal(x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    y = 0.996 * x + np.sqrt(1 - 0.996**2) * off / np.linalg.norm(off, axis=1, keepdims=True)

    def apart(margin):
        (home_x, x_at), (home_y, y_at) = codes.homes(x, margin), codes.homes(y, margin)
        row = np.arange(len(x))
        assert x_at[row, home_x].all() and y_at[row, home_y].all()
        return (~(x_at[row, home_y] | y_at[row, home_x])).sum()

    margin = similar_vectors.border_margin(0.996)
    assert apart(margin) == 0 and apart(margin / 2) > 0


def test_later_copies(spark):
    """Of 30 copies each has the 10 smallest other ids, also those that are in nobody's list; without late they have no rows."""
    x = [(i, np.arange(20) + 1) for i in range(1, 31)] + [(100 + i, r) for i, (_, r) in enumerate(grouped()[:50])]
    found = {late: {} for late in (True, False)}
    for late, rows in found.items():
        for r in similar_vectors.neighbours_above(table(spark, x), "vec_id", "v", 20, late=late).collect():
            rows.setdefault(r["vec"], []).append((r["rank"], r["other"]))
    for i in range(1, 31):
        assert [o for _, o in sorted(found[True][i])] == [j for j in range(1, 31) if j != i][:10]
    assert max(i for i in found[False] if i < 100) == 11 and {i: sorted(v) for i, v in found[False].items()} == {i: sorted(v) for i, v in found[True].items() if i in found[False]}


@pytest.mark.parametrize("dim", [25, 128])
@pytest.mark.parametrize("n", [300_000, 100_000_000])
def test_tight_groups_share_substrings(dim, n):
    """In tight groups codes change more bits on the way to a similar vector: the substrings follow, whatever the number of vectors."""
    rng = np.random.default_rng(1)
    c = rng.standard_normal((40, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    for noise in (0.05, 0.15):
        x = c[rng.integers(40, size=4096)] + rng.standard_normal((4096, dim)) * noise / (np.sqrt(dim) if noise < 0.1 else 1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = similar_vectors.learn(x, n, 0.996)
        a = x[:1000]
        off = rng.standard_normal(a.shape)
        off -= (off * a).sum(1, keepdims=True) * a
        cos = np.maximum(0.9962, similar_vectors.farthest_wanted(x, np.arange(1000), n, 0.996, 10))[:, None]
        b = cos * a + np.sqrt(1 - cos**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
        margin = similar_vectors.border_margin(0.996)
        (home_a, at_a), (home_b, at_b) = codes.homes(a, margin), codes.homes(b, margin)
        cells = np.arange(len(codes.centres))
        both = at_a & at_b & ((home_a[:, None] == cells) | (home_b[:, None] == cells))
        found = np.zeros(len(a), bool)
        for cell in range(len(codes.centres)):
            r = np.flatnonzero(both[:, cell])
            code = [codes.bits(v[r], np.full(len(r), cell))[:, : codes.substrings * codes.width].reshape(len(r), codes.substrings, codes.width) for v in (a, b)]
            found[r] |= (code[0] == code[1]).all(2).any(1)
        assert found.mean() >= 0.99


def test_nearest_of(spark, monkeypatch):
    monkeypatch.setattr(similar_vectors, "CELL_BLOCK", 50)
    x = grouped(seed=1)
    _, top = brute(x)
    rows = similar_vectors.nearest_of(table(spark, x, dirty(20)), "vec_id", "v", 20, every_nth=10).collect()
    got = {}
    for r in rows:
        got.setdefault(r["vec"], set()).add(r["other"])
    asked = [i for i in top if i % 10 == 0]
    assert set(got) == set(asked) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[i] & set(top[i])) / 10 for i in asked]) >= 0.9


def test_no_vectors(spark):
    empty = table(spark, [], dirty(20)[1:3])
    assert similar_vectors.neighbours_above(empty, "vec_id", "v", 20).count() == 0
    assert similar_vectors.nearest_of(empty, "vec_id", "v", 20).count() == 0
    assert clusters.similarity_clusters(empty, "vec_id", "v", 20).count() == 0
    one = table(spark, [(1, np.ones(20))])
    assert similar_vectors.neighbours_above(one, "vec_id", "v", 20).count() == 0
    assert clusters.similarity_clusters(one, "vec_id", "v", 20).count() == 0


def test_clusters(spark):
    x = grouped(seed=2, dim=24)
    ids, v = np.array([i for i, _ in x]), np.stack([r for _, r in x]).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = clusters.similarity_clusters(table(spark, x, dirty(24)), "vec_id", "v", 24, typical=3).collect()
    found = {}
    for r in rows:
        found.setdefault(r["cluster_id"], []).append(r)
    want = set()
    for start in u:
        mean = start
        for _ in range(20):
            mean = u[u @ mean >= 0.7].mean(0)
            mean /= np.linalg.norm(mean)
        cos = u @ mean
        own = cos >= 0.7
        if own.sum() >= 8 and cos[own].min() >= 0.8 and cos[~own].max() < 0.6:
            want.add(frozenset(ids[own].tolist()))
    assert {frozenset(r["vec_id"] for r in own) for own in found.values()} == want and len(want) == 5
    for c, own in found.items():
        member = np.isin(ids, [r["vec_id"] for r in own])
        mean = u[member].mean(0)
        cos = u @ (mean / np.linalg.norm(mean))
        assert c == min(r["vec_id"] for r in own) and len(own) == own[0]["size"] >= 8
        assert cos[member].min() >= 0.8 and cos[~member].max() < 0.6
        best = sorted(((-round(cos[r], 9), int(ids[r])) for r in np.flatnonzero(member)))[:3]
        assert sorted(r["vec_id"] for r in own if r["typical_rank"]) == sorted(i for _, i in best) or len({s for s, _ in best}) < 3


@pytest.mark.parametrize("few", [True, False])
def test_small_clusters(spark, monkeypatch, few):
    """Clusters of 10 among noise that seeds don't hit: the drawn ones are few here, as they are in a large table."""
    monkeypatch.setattr(clusters, "_few_tasks", lambda df: few)  # sums straight to the driver, or added up by tasks first
    monkeypatch.setattr(clusters, "K", 2)
    monkeypatch.setattr(clusters, "OVERSAMPLE", 2)
    monkeypatch.setattr(clusters, "REST_BLOCK", 700)
    monkeypatch.setattr(clusters, "START_BLOCK", 300)
    monkeypatch.setattr(clusters, "FEW", 20)
    rng = np.random.default_rng(5)
    dim, noise = 60, rng.standard_normal((1500, 60))
    planted = []
    for _ in range(12):
        c = rng.standard_normal(dim)
        planted.append(c / np.linalg.norm(c) + rng.standard_normal((10, dim)) * 0.07)
    x = [(i + 1, np.float32(r)) for i, r in enumerate(np.vstack([noise, *planted]))]
    u = np.stack([r for _, r in x]).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = set()
    for g in range(12):
        own = np.arange(1500 + 10 * g, 1510 + 10 * g)
        cos = u @ (u[own].mean(0) / np.linalg.norm(u[own].mean(0)))
        if cos[own].min() >= 0.8 and np.delete(cos, own).max() < 0.6:
            want.add(frozenset((own + 1).tolist()))
    found = {}
    for r in clusters.similarity_clusters(table(spark, x, dirty(dim)), "vec_id", "v", dim).collect():
        found.setdefault(r["cluster_id"], set()).add(r["vec_id"])
    assert len(want) >= 10 and {frozenset(v) for v in found.values()} == want


def test_starts_are_not_copied(spark, monkeypatch):
    """30 blocks of starts meet 30 blocks of vectors left: no pass puts more on disk than twice the vectors, and all of them together leave next to nothing there."""
    monkeypatch.setattr(clusters, "OVERSAMPLE", 2)  # the few rows of draws stay until garbage is collected
    monkeypatch.setattr(clusters, "REST_BLOCK", 100)
    monkeypatch.setattr(clusters, "START_BLOCK", 100)
    monkeypatch.setattr(clusters, "FEW", 20)
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    def files():
        blocks = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = {blocks.apply(i).getName(): blocks.apply(i).length() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle")}
        return found | {f.name: f.stat().st_size for f in os.scandir(sc._temp_dir)}

    def left():
        return sum(size for name, size in files().items() if name not in held)

    x = np.float32(np.random.default_rng(8).standard_normal((3000, 20)))
    rows = table(spark, [(i + 1, r) for i, r in enumerate(x)])
    last, held = max(stages(), default=-1), files()
    found = clusters.similarity_clusters(rows, "vec_id", "v", 20)
    assert 0 < max(size for stage, size in stages().items() if stage > last) < 2 * x.nbytes
    until = time.monotonic() + 20  # Spark doesn't wait until files are removed
    while left() >= x.nbytes / 4 and time.monotonic() < until:
        time.sleep(0.1)
    assert left() < x.nbytes / 4
    assert found.count() == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_many_clusters(spark):
    """600 clusters of 10, far more than centroids, in more dimensions than features: all that keep both bounds come out."""
    rng = np.random.default_rng(11)
    dim, groups = clusters.FEATURES + 44, 600
    c = rng.standard_normal((groups, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    v = np.vstack([np.repeat(c, 10, axis=0) + rng.standard_normal((10 * groups, dim)) * 0.03, rng.standard_normal((300, dim))])
    u = np.float32(v).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = set()
    for g in range(groups):
        own = np.arange(10 * g, 10 * g + 10)
        cos = u @ (u[own].mean(0) / np.linalg.norm(u[own].mean(0)))
        if cos[own].min() >= 0.8 and np.delete(cos, own).max() < 0.6:
            want.add(frozenset((own + 1).tolist()))
    found = {}
    for r in clusters.similarity_clusters(table(spark, [(i + 1, r) for i, r in enumerate(np.float32(v))]), "vec_id", "v", dim).collect():
        found.setdefault(r["cluster_id"], set()).add(r["vec_id"])
    assert len(want) >= 500 and {frozenset(m) for m in found.values()} == want


def test_highest():
    x = np.random.default_rng(3).standard_normal((20, 5000)).astype(np.float32)
    for columns in (9, 300, 2001, 5000):
        top = clusters.highest(x[:, :columns], 7)
        assert (np.sort(np.take_along_axis(x, top, 1)) == np.sort(x[:, :columns])[:, -7:]).all()


def test_hashed_features():
    x = np.random.default_rng(0).standard_normal((5, 1000))
    f = clusters.hashed_features(x)
    assert f.shape == (5, clusters.FEATURES) and np.allclose((f * f).sum(1), 1)
    assert np.allclose(clusters.hashed_features(x[:, :7]), x[:, :7] / np.linalg.norm(x[:, :7], axis=1, keepdims=True))
