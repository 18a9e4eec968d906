"""Frequency, distinctiveness and near duplicates against brute force on small fixtures."""

import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cantera.llm import distinctive, frequency, near_duplicates
from cantera.llm.terms import terms

WORDS = "luz mar sol río casa noche día tren voz café ﬁn x² ＡＢＣ oh na la".split()


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "Song " + str(i), "Ñandú"]), " ".join(rng.choices(WORDS, k=rng.randint(0, 40)))) for i in range(1, n)]
    rows += [(n, "a", None), (n + 1, None, ""), (n + 2, None, " \n—"), (None, "x", "luz mar"), (2**31 + 5, "far", "luz luz única")]
    return rows + rows[:9] + [(n + 3, "long", "mar " * 30_000)]  # repeated rows, a very long text


def frame(spark, rows):
    # Columns named like those that the operators work with.
    df = spark.createDataFrame(rows, "id bigint, song string, texto string")
    return df.withColumns({c: F.lit("x") for c in ("key", "text", "term", "chunk", "runs", "title", "score")})


def test_terms():
    assert terms("ÁÉ ﬁn x² K ½ áb’c_d İ ｚ９") == ["ae", "fin", "x2", "k", "1", "2", "ab", "c", "d", "i", "z9"]
    assert terms(None) == terms("") == terms("— …") == []


@given(st.sets(st.integers(0, 65535), max_size=6000))
@settings(max_examples=20, deadline=None)
def test_container_round_trip(numbers):
    a = np.array(sorted(numbers), np.int32)
    assert (frequency.decompress(frequency.compress(a)) == a).all()


def test_dense_container_round_trip():
    for a in (np.arange(65536), np.arange(0, 65536, 2), np.arange(4096), np.arange(4097)):
        data = frequency.compress(a)
        assert len(data) <= 8192 and (frequency.decompress(data) == a).all()


def counted(rows):
    texts = {i: t for i, _, t in rows if i is not None}
    return {i: Counter(terms(t)) for i, t in texts.items()}


def test_frequency(spark):
    rows = corpus(200)
    per = counted(rows)
    n = sum(1 for c in per.values() if c)
    df, total = Counter(t for c in per.values() for t in c), sum(per.values(), Counter())
    got = {r["term"]: (r["n_occurrences"], r["n_records"], r["mark"]) for r in frequency.term_frequency(frame(spark, rows).repartition(7), "id", "texto").collect()}
    assert got == {t: (total[t], df[t], "rare" if df[t] < 3 else "common" if df[t] > 0.2 * n else "useful") for t in total}
    bitmaps = frequency.term_bitmaps(frame(spark, rows), "id", "texto").filter("term = 'luz'").collect()
    ids = sorted((r["chunk"] << 16) + int(x) for r in bitmaps for x in frequency.decompress(bytes(r["records"])))
    assert ids == sorted(i for i, c in per.items() if "luz" in c)
    assert frequency.term_frequency(frame(spark, []), "id", "texto").count() == 0


def test_containers_larger_than_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(i, "s", "a b" if i % 3 else "a") for i in range(700)]
        got = {r["term"]: (r["n_occurrences"], r["n_records"]) for r in frequency.term_frequency(frame(spark, rows + rows), "id", "texto").collect()}
        assert got == {"a": (700, 700), "b": (466, 466)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_characteristic(spark):
    rows = corpus(120, seed=2)
    per = counted(rows)
    n = sum(1 for c in per.values() if c)
    df = Counter(t for c in per.values() for t in c)
    want = {(i, t, k) for i, c in per.items() for k, t in enumerate(sorted(c, key=lambda t: (-c[t] * (math.log((n + 1) / (df[t] + 1)) + 1), t))[:3], 1)}
    got = [tuple(r) for r in distinctive.characteristic_terms(frame(spark, rows), "id", "texto").select("key", "term", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert distinctive.characteristic_terms(frame(spark, []), "id", "texto").count() == 0


def exact_tail(x, total, marked, drawn):
    ways = sum(math.comb(marked, k) * math.comb(total - marked, drawn - k) for k in range(x, min(marked, drawn) + 1) if drawn - k <= total - marked)
    return float(Fraction(ways, math.comb(total, drawn)))


@given(st.integers(1, 300), st.data())
@settings(max_examples=60, deadline=None)
def test_tail(total, data):
    marked, drawn = data.draw(st.integers(0, total)), data.draw(st.integers(0, total))
    x = data.draw(st.integers(max(0, drawn + marked - total), min(marked, drawn)))
    got = float(np.exp(distinctive.log_upper_tail(np.array([x]), np.array([total]), np.array([marked]), np.array([drawn]))[0]))
    assert got == pytest.approx(exact_tail(x, total, marked, drawn), rel=1e-9)


def test_log_gamma():
    x = np.array([0.5, 1, 2, 3.3, 9.99, 10, 123.4, 1e6, 1e12])
    assert distinctive.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_enriched(spark):
    rows = corpus(60, seed=3)
    per = counted(rows)
    every, total = sum(sum(c.values()) for c in per.values()), sum(per.values(), Counter())
    want = {}
    for i, c in per.items():
        size = sum(c.values())
        if size > 1000:
            continue  # the exact fractions of the long text take long
        p = sorted((exact_tail(c[t], every, total[t], size), t) for t in c)
        for k in range(len(p)):
            want[i, p[k][1]] = -math.log10(min(1.0, min(p[j][0] * len(p) / (j + 1) for j in range(k, len(p)))))
    got = {(r["key"], r["term"]): r["score"] for r in distinctive.enriched_terms(frame(spark, rows), "id", "texto", top=99, most_false=1.0).collect() if (r["key"], r["term"]) in want}
    assert got == pytest.approx(want, abs=1e-8)


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randint(0, 4)):
        op, i = rng.random(), rng.randrange(len(w))
        if op < 0.4:
            w[i] = rng.choice("abcdefgh") * 3
        elif op < 0.7:
            w.insert(i, "nuevo")
        else:
            w.append(w.pop(i))
    return w


def families(seed=5, groups=25):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"p{rng.randrange(400)}" for _ in range(rng.randint(12, 60))]
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows) + 1, rng.choice([None, "title"]), " ".join(edited(rng, base))))
        rows.append((len(rows) + 1, rows[-1][1], rows[-1][2]))  # a copy
    hot = " ".join(f"h{i}" for i in range(20))
    rows += [(1000 + i, "hot", hot) for i in range(40)]  # a group of copies
    rows += [(2000 + i, "hot", hot + f" z{i}") for i in range(20)]  # similar, all different
    return rows + [(3000, "short", "a b c"), (3001, "short", "a b c"), (3002, None, None), (None, "x", hot), *rows[:5], (3003, "long", " ".join(f"w{i}" for i in range(20_000)))]


def similar(rows, threshold):
    sets = {}
    for i, title, text in rows:
        w = terms(text)
        if i is not None and len(w) >= 10:
            c = (terms(title) if title is not None else []) + w
            sets[i] = {tuple(c[k : k + 3]) for k in range(len(c) - 2)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}, sets


def test_near_duplicates(spark):
    rows = families()
    want, sets = similar(rows, 0.5)
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(frame(spark, rows), "id", "song", "texto").collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.99 * len(want)
    classes = near_duplicates.near_duplicate_classes(frame(spark, rows), "id", "song", "texto").collect()
    assert {r["id"] for r in classes} == set(sets)
    assert all(r["class_id"] == min(i for i in sets if sets[i] == sets[r["id"]]) for r in classes)
    assert near_duplicates.near_duplicate_pairs(frame(spark, []), "id", "song", "texto").count() == 0


def test_stars_over_batches():
    import pyarrow as pa

    # Buckets of 2, 9, 30 members, cut by batches anywhere: small ones give every pair once, the large one at most HUBS edges for each member.
    keys = [1] * 2 + [2] * 9 + [3] * 30 + [4]
    ids = list(range(len(keys)))
    for cut in (1, 4, 17, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + cut], pa.int64()), pa.array(ids[i : i + cut], pa.int64())], names=["bucket", "id"]) for i in range(0, len(keys), cut)]
        edges = [e for b in near_duplicates._stars(iter(batches)) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert {(0, 1), *itertools.combinations(range(2, 11), 2)} <= set(edges) and len(edges) == len(set(edges))
        assert all(keys[a] == keys[b] for a, b in edges)
        assert len(edges) == 1 + 36 + sum(30 - 1 - h for h in range(near_duplicates.HUBS))


@pytest.mark.parametrize("block", [100, 1024])
def test_large_family(spark, monkeypatch, block):
    """A family of 1,000 different variants, more than the hubs of its buckets reach: every pair comes, in blocks or in one."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block, raising=False)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(1000):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, None, " ".join(words)))
    sets = [set(near_duplicates.runs(terms(t), 3).tolist()) for _, _, t in rows]
    want = {(a, b) for a, b in itertools.combinations(range(1000), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(frame(spark, rows), "id", "song", "texto").toPandas().itertuples(index=False)]
    assert len(got) == len(set(got)) and set(got) <= want and len(want) > 400_000
    assert len(got) >= 0.9999 * len(want)
    links = near_duplicates.near_duplicate_classes(frame(spark, rows), "id", "song", "texto").agg(F.sum("n_links")).first()[0]
    assert links == 2 * len(got)


@pytest.mark.parametrize("most", [300, 1 << 20])
def test_many_copies(spark, monkeypatch, most):
    """Two linked classes of many copies, in blocks; groups of index entries too large for a task are dealt one by one."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 50)
    monkeypatch.setattr(near_duplicates.buckets, "MOST", most)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base)] * 120 + [" ".join(base[:-3] + ["x", "y", "z"])] * 70 + [" ".join(f"v{k}{i}" for i in range(20)) for k in range(30)]
    rows = [(i, None, t) for i, t in enumerate(texts)]
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(frame(spark, rows), "id", "song", "texto").collect()]
    assert len(got) == len(set(got)) and set(got) == set(itertools.combinations(range(190), 2))


def test_shared_runs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(50)] + [np.array([7, 1000], np.uint64)]
    both = near_duplicates.shared_runs(np.concatenate(sets), np.repeat(np.arange(51), [len(x) for x in sets]), 51)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(51) for j in range(51) if i != j)


def test_buckets_over_batches():
    import pyarrow as pa

    keys = [1] * 2 + [2] * 9 + [3] * 30 + [4]
    for cut in (1, 4, 10, 17, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + cut], pa.int64()), pa.array(list(range(len(keys)))[i : i + cut], pa.int64())], names=["bucket", "id"]) for i in range(0, len(keys), cut)]
        rows = [r for b in near_duplicates._buckets(iter(batches)) for r in b.to_pylist()]
        pairs, members = [(r["a"], r["b"]) for r in rows if r["bucket"] is None], [(r["bucket"], r["a"]) for r in rows if r["bucket"] is not None]
        assert sorted(pairs) == [(0, 1), *itertools.combinations(range(2, 11), 2)] and members == [(3, i) for i in range(11, 41)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**62, 90).astype(np.uint64)
    b = np.r_[a[:60], rng.integers(0, 2**62, 30).astype(np.uint64)]
    s = near_duplicates.sketches(np.r_[a, b], np.r_[np.zeros(90, int), np.ones(90, int)], 2)
    assert abs((s[0] == s[1]).mean() - 60 / 120) < 0.15
    one = near_duplicates.sketches(np.array([7], np.uint64), np.array([0]), 1)
    assert (one == one[0, 0]).all()
