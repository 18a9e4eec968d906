"""Notations, near points and regions, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantera.operators import points as P


def test_notations(spark):
    good = {
        "(50.5, 1.25)": (50.5, 1.25), " ( -43.5 ,  80.4 ) ": (-43.5, 80.4), "(47,6; -63,4)": (47.6, -63.4), "[1.5, 2]": (1.5, 2.0), "9.5, -1.5": (9.5, -1.5),
        "8.5S 75.5W": (-8.5, -75.5), "46.5N 42.4E": (46.5, 42.4), "(+34.4, 11.4)": (34.4, 11.4), "(-50.2 ,-95.4)": (-50.2, -95.4), "(90, -180)": (90.0, -180.0), "8,5 S; 75,5 O": (-8.5, -75.5),
    }
    bad = [None, "", "NaN", "(,)", "(n/a, n/a)", "(15.4)", "(51.4, )", "sin ubicación", "\x01" + "1\x01\x012\x01", "1" * 50_000, " " * 50_000 + "x", "(91, 0)", "(0, 181)", "(1, 2, 3)", "x" * 100_000]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "location string").select("location", P.parse_location(F.col("location")).alias("p"))
    got = {r["location"]: r["p"] and tuple(r["p"]) for r in df.collect()}
    assert {k: got[k] for k in good} == good
    assert all(got[k] is None for k in bad)


def test_more_notations(spark):
    good = {
        "N 40.4, W 3.7": (40.4, -3.7), "S40.4 E3.7": (-40.4, 3.7), "40°30'0\"N 3°15'36\"W": (40.5, -3.26), "lat 40.4 lon -3.7": (40.4, -3.7), "lat: 40.4, lng: 3.7": (40.4, 3.7),
        "latitud=-40,4; longitud=3,7": (-40.4, 3.7), "40,41 -3,70": (40.41, -3.7), "(N 8,5; O 75,5)": (8.5, -75.5),
    }
    bad = ["N 40.4", "lat 40.4", "lat 91 lon 0", "N 40.4 N 3.7", "1, 2, 3", "40.4N", "S -40.4, E 3", "1.5", "12", "lat lon", "40 30 20", "(15.4)", "40°70'N 3°0'E"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "location string").select("location", P.parse_location(F.col("location")).alias("p"))
    got = {r["location"]: r["p"] and tuple(r["p"]) for r in df.collect()}
    assert all(got[k] == pytest.approx(v) for k, v in good.items() if got[k]) and [k for k in good if not got[k]] == []
    assert [k for k in bad if got[k]] == []


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, lat double, lon double")


@pytest.mark.parametrize("block", [4, 2048])
def test_near_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(1)
    rows = [(i, rng.choice([0.0, 1.0, -0.05]) + rng.random() * 0.02, rng.random() * 0.02 - 0.01) for i in range(150)] + [(200 + i, 5.0, 5.0) for i in range(12)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and np.hypot(a[1] - b[1], a[2] - b[2]) <= 0.004}
    got = [tuple(r) for r in P.near_pairs(frame(spark, rows), 0.004).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert P.near_pairs(frame(spark, []), 0.004).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_near_points(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(2)
    a = [(i, rng.random(), rng.random()) for i in range(100)]
    b = [(i, rng.random(), rng.random()) for i in range(40)]
    want = {(x[0], y[0]) for x in a for y in b if np.hypot(x[1] - y[1], x[2] - y[2]) <= 0.1}
    a += [(100 + i, 0.5, 0.5 + i / 1e4) for i in range(40)]  # a crowded place
    want |= {(x[0], y[0]) for x in a[100:] for y in b if np.hypot(x[1] - y[1], x[2] - y[2]) <= 0.1}
    got = [tuple(r) for r in P.near_points(frame(spark, a), frame(spark, b), 0.1).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert P.near_points(frame(spark, a), frame(spark, []), 0.1).count() == P.near_points(frame(spark, []), frame(spark, b), 0.1).count() == 0


def inside(ring, lat, lon):
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("sent, block", [(32 << 20, 1 << 16), (0, 1 << 16), (0, 8)])
def test_regions(spark, monkeypatch, sent, block):
    """Slabs sent to every task, distributed by tiles, and with a tile's points and edges (a dense city) in blocks."""
    monkeypatch.setattr(P, "SENT_BYTES", sent)
    monkeypatch.setattr(P, "TILE_BLOCK", block)
    rng = random.Random(3)
    zones = []
    for i in range(30):
        y, x, n = rng.random() * 4, rng.random() * 4, rng.randint(3, 9)
        ring = [[y + r * np.sin(t), x + r * np.cos(t)] for t, r in ((2 * np.pi * k / n, rng.uniform(0.2, 1)) for k in range(n))]  # may be concave
        ring = ring[::-1] if i % 2 else ring
        zones.append((i, f"Z{i}", [[float(v) for v in c] for c in ring + (ring[:1] if i % 3 == 0 else [])]))
    extra = [(90, "none", None), (91, "two", [[0.0, 0.0], [1.0, 1.0]]), (92, "flat", [[0.0, 0.0], [0.0, 1.0], [0.0, 2.0]]), (None, "no id", [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0]])]
    df = spark.createDataFrame(zones + extra + zones[:2], "zona_id int, nombre string, contorno array<array<double>>")
    pts = [(i, rng.random() * 5 - 0.5, rng.random() * 5 - 0.5) for i in range(400)] + [(400 + i, 2.01 + i / 1e4, 2.01) for i in range(100)]
    want = {(p[0], z[0]) for p in pts for z in zones if inside(z[2], p[1], p[2])}
    got = [tuple(r) for r in P.containing_regions(frame(spark, pts), df, "zona_id", "contorno").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert P.containing_regions(frame(spark, pts), df.limit(0), "zona_id", "contorno").count() == 0
    assert P.containing_regions(frame(spark, []), df, "zona_id", "contorno").count() == 0


def test_located(spark):
    df = spark.createDataFrame([(1, "(1, 2)"), (1, "(1, 2)"), (None, "(1, 2)"), (2, None)], "id int, location string").withColumn("lat", F.lit("x")).withColumn("point", F.lit("y"))
    assert [tuple(r) for r in P.located(df, "id", P.parse_location(F.col("location"))).collect()] == [(1, 1.0, 2.0)]
