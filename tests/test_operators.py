"""Text, codewords, stemming and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantera.engine import Engine
from cantera.functions import mfcc
from cantera.functions.render import similarity_percent
from cantera.functions.stemmer import STOP_STEMS, stem
from cantera.operators import codewords, spatial, text


def test_stems():
    known = {
        "consistency": "consist", "consigned": "consign", "knightly": "knight", "knots": "knot", "skies": "sky", "generously": "generous", "communism": "communism", "happy": "happi",
        "hopping": "hop", "hoping": "hope", "ponies": "poni", "ties": "tie", "caresses": "caress", "gas": "gas", "relational": "relat", "conditional": "condit", "rationalization": "ration",
        "singing": "sing", "losing": "lose", "national": "nation", "agreed": "agre", "feed": "feed", "cry": "cri", "by": "by", "say": "say", "abilities": "abil", "adoption": "adopt", "controll": "control",
    }
    assert {w: stem(w) for w in known} == known
    assert {"the", "of", "veri"} <= STOP_STEMS


def test_search_scores(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, ""), (4, None), (None, "b")], "id int, t string").withColumn("term", F.lit(1)).withColumn("doc", F.lit(1))
    index = text.TextIndex.build(docs, "id", "t", stemmed=False)
    idf = {t: math.log((2 + 1) / (df + 1)) + 1 for t, df in {"a": 1, "b": 2, "c": 1}.items()}
    got = {r["doc"]: r["_score"] for r in index.search("b c zzz").collect()}
    q = {"b": idf["b"], "c": idf["c"]}
    d1, d2 = {"a": idf["a"], "b": 2 * idf["b"]}, {"b": idf["b"], "c": idf["c"]}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {i: sum(q[t] * d.get(t, 0) for t in q) / norm(q) / norm(d) for i, d in ((1, d1), (2, d2))}
    assert got == pytest.approx(want)
    assert {r["doc"]: r["_score"] for r in index.search("b", normalize=False).collect()} == pytest.approx({1: 2 * idf["b"], 2: idf["b"]})
    assert index.search("").count() == 0 and index.search("b", limit=0).count() == 0


def test_inverted_search_equals_exact(spark):
    rows = [(d, w, float((d * 7 + w * 3) % 5)) for d in range(30) for w in range(12)]
    counts = spark.createDataFrame(rows, "doc int, word int, n double").filter("n > 0")
    words = codewords.weights(counts, codewords.word_idf(counts))
    q = words.filter("doc = 4").select("word", "w")
    exact = [tuple(r) for r in codewords.nearest_exact(words, q, 5).collect()]
    assert exact == [tuple(r) for r in codewords.nearest_inverted(words, q, 5).collect()]
    assert exact[0][0] == 4 and abs(exact[0][1]) < 1e-9
    assert codewords.nearest_inverted(words, q, 5, candidates=2).count() == 2


def test_nearest_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0]), (6, [0.0, 1.0])], "id int, v array<double>")
    assert [(r[0], round(r[1], 9)) for r in codewords.nearest_vectors(df, "id", "v", [3.0, 0.0], 9).collect()] == [(1, 0.0), (5, 0.0), (2, 1.0), (6, 1.0)]
    p = spark.createDataFrame([(0.0,), (1.0,), (0.25,), (None,)], "d double").select(similarity_percent(F.col("d")).alias("p"))
    assert [r[0] for r in p.collect()] == [100.0, 0.0, 75.0, None]


def test_nearest_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [5.0, 5.0]), (5, [float("nan"), 0.0]), (6, [1.0])], "id int, p array<double>")
    assert sorted(r["id"] for r in spatial.nearest(df, "p", (0, 0), 1).collect()) == [1, 2]
    assert spatial.nearest(df, "p", (0, 0), 1, ties=False, tie_break=("id",)).first()["id"] == 1
    assert spatial.nearest(df, "p", (0, 0), 0).count() == 0 and spatial.nearest(df.limit(0), "p", (0, 0), 3).count() == 0
    assert [r["id"] for r in df.filter(spatial.same_point("p", (0, 1))).collect()] == [1]


def wav(x, rate=22_050, width=2, channels=1):
    import io
    import wave

    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        scaled = np.round(np.repeat(x, channels) * (2 ** (8 * width - 1) - 1)).astype(np.int64)
        w.writeframes((scaled + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in scaled))
    return held.getvalue()


def test_cepstral_coefficients():
    rng = np.random.default_rng(0)
    x = rng.uniform(-0.5, 0.5, 3000)
    # By definition, a frame and a band at a time.
    frame, hop, filters = mfcc.FRAME, mfcc.HOP, mfcc.bands()
    padded = np.r_[np.zeros(frame // 2), x, np.zeros(frame // 2)]
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / frame) for i in range(frame)]
    db = []
    for at in range(0, len(x) + 1, hop):
        power = abs(np.fft.fft(padded[at : at + frame] * hann)[: frame // 2 + 1]) ** 2
        db.append([10 * math.log10(max(1e-10, float((f * power).sum()))) for f in filters])
    top = max(map(max, db))
    want = [[(math.sqrt((1 if k == 0 else 2) / 128)) * sum(max(v, top - 80) * math.cos(math.pi * k * (n + 0.5) / 128) for n, v in enumerate(row)) for k in range(25)] for row in db]
    got = mfcc.coefficients(x, 25)
    assert got.shape == (1 + 3000 // 512, 25) and np.allclose(got, want)
    # The triangles: one peak each, in ascending order, areas of one.
    peaks = filters.argmax(1)
    assert (np.diff(peaks) >= 0).all() and np.allclose(filters[40:].sum(1) * mfcc.RATE / frame, 1, atol=0.1)
    assert np.allclose(mfcc.to_hz(mfcc.to_mel(np.array([0.0, 500, 1000, 6400, 11025]))), [0, 500, 1000, 6400, 11025]) and mfcc.to_mel(np.array(6400.0)) == pytest.approx(42)
    for width, error in ((1, 0.02), (2, 1e-4), (3, 1e-6), (4, 1e-8)):
        read, rate = mfcc.read_wav(wav(x, 8000, width, 2))
        assert rate == 8000 and np.abs(read - x).max() < error
    tone = np.sin(np.arange(4000) * 0.2)
    assert np.abs(mfcc.at_rate(tone, 11_025)[200:-200] - np.sin(np.arange(8000) * 0.1)[200:-200]).max() < 0.05
    assert mfcc.mfcc_of_wav(wav(np.zeros(0)), 25).shape == (1, 25)


def test_audio_through_the_dialect(spark, tmp_path):
    """Tones in WAV files, by the built-in extractor: the most similar file to a tone is the one of the same pitch."""
    folder = tmp_path / "tones"
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.wav").write_bytes(wav(np.sin(np.arange(9000) * (0.05 + 0.2 * (i % 3))) * (0.5 + 0.0001 * i)))
    (folder / "9.wav").write_bytes(b"no audio")
    csv = tmp_path / "f.csv"
    csv.write_text("id,tone\n" + "".join(f"{i},{folder}/{i}.wav\n" for i in range(6)))
    e = Engine(spark, str(tmp_path / "db"))
    (r,) = e.sql(f"CREATE TABLE t FROM FILE '{csv}' USING PRIMARY INDEX BTREE(id), INDEX KNN_INV(tone, type = 'AUDIO', collection = '{folder}', k = 6, id_from_filename = 1)")
    assert r.error is None, r.error
    for i in range(3):
        got = e.sql(f"SELECT id FROM t WHERE tone <-> '{folder}/{i}.wav' LIMIT 2")[0]
        assert got.error is None and sorted(x["id"] for x in got.rows()) == [i, i + 3]


def test_stream(spark, tmp_path):
    from cantera.streaming.ingest import append_stream

    e = Engine(spark, str(tmp_path / "db"))
    e.sql("CREATE TABLE t (id INT KEY, x FLOAT); INSERT INTO t VALUES (1, 1.5)")
    source = str(tmp_path / "in")
    rows = lambda ids: spark.createDataFrame([(i, 1.0) for i in ids], "id int, x float")
    rows([1, 2, 2]).write.mode("append").parquet(source)
    for more in ([3], [3, 4]):
        q = append_stream(e, "t", spark.readStream.schema("id int, x float").parquet(source), str(tmp_path / "cp"))
        q.awaitTermination()
        rows(more).write.mode("append").parquet(source)
    assert sorted(r["id"] for r in e.select("t").collect()) == [1, 2, 3]


def test_queries_have_unique_names_and_match_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
