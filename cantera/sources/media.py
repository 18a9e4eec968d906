"""Media files as a table, descriptors of their content, and the index of codewords that is kept beside a table.

Descriptors come from extractors: functions from a file's bytes to a list of lists of numbers. Those for SIFT and MFCC need OpenCV and
librosa, except for MFCC of WAV files; others can be given. A collection is a folder of media files, or of Parquet files with the columns path and descriptors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.functions.mfcc import mfcc_of_wav
from cantera.operators import codewords
from cantera.session import scratch, written

#: Extensions that are read (fixed values).
EXTENSIONS = {"IMAGE": ("jpg", "jpeg", "png"), "AUDIO": ("wav", "mp3")}
LONGEST_SIDE = 800
COEFFICIENTS = 25
Extractor = Callable[[bytes], list | None]


class MediaProblem(ValueError):
    """A media file is missing or of no known format."""


def checked(spark: SparkSession, path: str, kind: str | None = None) -> str:
    """The path of a media file that is there and has an extension of its kind."""
    allowed = EXTENSIONS[kind] if kind else sum(EXTENSIONS.values(), ())
    if path.rpartition(".")[2].lower() not in allowed:
        raise MediaProblem(f"{path}: only {', '.join(allowed)} are read")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise MediaProblem(f"no file {path}")
    return path


def media_files(spark: SparkSession, folder: str, kind: str | None = None, id_from_filename: bool = False) -> DataFrame:
    """doc_id, path, name (the file's stem), external_id, content of the folder's media files; files of other extensions are left out.

    doc_id counts the files in order of their paths from 0; external_id is the stem with id_from_filename, else doc_id as a string.
    The count takes the files' paths only, a sort by range and a small table of how many each range has."""
    allowed = EXTENSIONS[kind] if kind else sum(EXTENSIONS.values(), ())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(f"{e},{e.upper()}" for e in allowed) + "}").load(folder)
    place = F.monotonically_increasing_id()
    paths = written(files.select("path").orderBy("path").select("path", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    sizes = sorted(tuple(r) for r in paths.groupBy("part").count().collect())  # a row per task
    before, first = 0, []
    for part, n in sizes:
        first.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(first, "part bigint, first bigint"))
    numbered = paths.join(starts, "part").select("path", (F.col("first") + F.col("at")).alias("doc_id"))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    found = files.select("path", "content").join(numbered, "path").withColumn("name", stem)
    return found.select("doc_id", "path", "name", (F.col("name") if id_from_filename else F.col("doc_id").cast("string")).alias("external_id"), "content")


def sift(content: bytes) -> list | None:
    import cv2
    import numpy as np

    image = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_GRAYSCALE)
    if image is None:
        return None
    scale = LONGEST_SIDE / max(image.shape)
    if scale < 1:
        image = cv2.resize(image, None, fx=scale, fy=scale)
    found = cv2.SIFT_create().detectAndCompute(image, None)[1]
    return None if found is None else found.tolist()


def mfcc(content: bytes) -> list | None:
    """Frames of COEFFICIENTS numbers. WAV needs no library, other formats need librosa."""
    if content[:4] == b"RIFF":
        return mfcc_of_wav(content, COEFFICIENTS).tolist() or None
    import io

    import librosa

    signal, rate = librosa.load(io.BytesIO(content), mono=True)
    return librosa.feature.mfcc(y=signal, sr=rate, n_mfcc=COEFFICIENTS).T.tolist()


#: The library without which nothing of a kind can be read, and the extractor.
LIBRARIES = {"IMAGE": ("cv2", sift), "AUDIO": (None, mfcc)}


def extractor_for(kind: str, given: dict[str, Extractor] | None = None) -> Extractor:
    if given and kind in given:
        return given[kind]
    library, work = LIBRARIES[kind]
    try:
        if library:
            __import__(library)
    except ImportError as e:
        raise RuntimeError(f"{library} isn't installed; give an extractor, or descriptors as a column") from e
    return work


def extract(files: DataFrame, kind: str, given: dict[str, Extractor] | None = None) -> DataFrame:
    """The files' columns but content, and descriptors; a file that can't be read has null descriptors."""
    work = extractor_for(kind, given)
    kept = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(content: bytes):
            try:
                return work(content)
            except Exception:
                return None

        for b in batches:
            yield b[kept].assign(descriptors=[one(bytes(c)) for c in b["content"]])

    form = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in kept)
    return files.mapInPandas(run, f"{form}, descriptors array<array<float>>")


def collection(spark: SparkSession, folder: str, kind: str, id_from_filename: bool = False, given: dict[str, Extractor] | None = None) -> DataFrame:
    """external_id, path, descriptors of a collection."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise MediaProblem(f"no folder {folder}")
    if any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p)):
        found = spark.read.parquet(folder)
        stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
        return found.select((stem if id_from_filename or "external_id" not in found.columns else F.col("external_id").cast("string")).alias("external_id"), "path", "descriptors")
    return extract(media_files(spark, folder, kind, id_from_filename), kind, given).select("external_id", "path", "descriptors")


def build_index(media: DataFrame, key: str, path: str, k: int, seed: int = 42, centroids: DataFrame | None = None) -> DataFrame:
    """The index of codewords of media (the key, descriptors), built as one batch job and kept below path: centroids, idf, weights. How many documents there are is told by the DataFrame of their weights, which is returned.

    Null and empty lists of descriptors give no document. centroids: a codebook that is known; else one of k words is learned."""
    spark = media.sparkSession
    with scratch():
        rows = written(codewords.descriptor_rows(media, key, "descriptors"))
        if centroids is None:
            centroids = codewords.centroids_of(codewords.fit_codebook(rows, int(k), seed), spark)
        centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        counts = written(codewords.word_histograms(rows, codewords.codebook(centroids)))
        codewords.word_idf(counts).write.mode("overwrite").parquet(f"{path}/idf")
        idf = spark.read.parquet(f"{path}/idf")
        # In order of words: the inverted search reads the row groups of its words.
        codewords.weights(counts, idf).repartitionByRange("word").sortWithinPartitions("word", "doc").write.mode("overwrite").parquet(f"{path}/weights")
    return spark.read.parquet(f"{path}/weights")


class MediaIndex:
    """What build_index left below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.codebook = codewords.codebook(spark.read.parquet(f"{path}/centroids"))
        self.idf, self.weights = (spark.read.parquet(f"{path}/{n}") for n in ("idf", "weights"))

    def search(self, media: DataFrame, inverted: bool, k: int) -> DataFrame:
        """doc, _distance of the k documents nearest to a file, given as one row with descriptors."""
        rows = codewords.descriptor_rows(media, "path", "descriptors")
        query = codewords.weights(codewords.word_histograms(rows, self.codebook), self.idf)
        return (codewords.nearest_inverted if inverted else codewords.nearest_exact)(self.weights, query, k)
