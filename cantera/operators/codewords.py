"""Similarity of media by words of descriptors: codebook, histograms, TF-IDF vectors, exact and inverted search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed defaults of the search over the inverted index, of the codebook and of results.
ACTIVE_WORDS = 35
CANDIDATES = 10_000
NEIGHBOURS = 10
CLUSTERS = {"IMAGE": 2000, "AUDIO": 500}


def descriptor_rows(media: DataFrame, key: str, descriptors: str) -> DataFrame:
    """doc, descriptor (array<double>): one row per descriptor; null and empty lists have none, null or NaN elements leave a descriptor out."""
    rows = media.select(F.col(key).alias("doc"), F.explode(descriptors).alias("descriptor")).withColumn("descriptor", F.col("descriptor").cast("array<double>"))
    return rows.filter(F.coalesce(F.forall("descriptor", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)) & (F.size("descriptor") > 0))


def fit_codebook(rows: DataFrame, k: int, seed: int = 42, iterations: int = 20):
    """A k-means model of all descriptors (seeded by parallel oversampling)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    return KMeans(k=k, seed=seed, maxIter=iterations).fit(rows.select(array_to_vector("descriptor").alias("features")))


def centroids_of(model, spark: SparkSession) -> DataFrame:
    """word, centroid of a k-means model."""
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "word int, centroid array<double>")


def codebook(centroids: DataFrame) -> np.ndarray:
    """The centroids (word, centroid; words from 0 on) as a matrix: as many rows as the codebook has words."""
    rows = centroids.orderBy("word").collect()
    return np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), -1)


def word_histograms(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """doc, word, n: how often each centroid is the nearest, by Euclidean distance and ties to the first, to a document's descriptors; descriptors of another length are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, words.shape[1]))
            nearest = np.concatenate([((words**2).sum(1) - 2 * x[at : at + 4096] @ words.T).argmin(1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest.astype(np.int32))], names=["doc", "word"])

    kind = rows.schema["doc"].dataType.simpleString()
    fitting = rows.filter(F.size("descriptor") == words.shape[1] if len(words) else F.lit(False))
    return fitting.select("doc", "descriptor").mapInArrow(run, f"doc {kind}, word int").groupBy("doc", "word").agg(F.count("*").cast("double").alias("n"))


def word_idf(counts: DataFrame) -> DataFrame:
    """word, df, idf with idf = ln((N + 1) / (df + 1)) + 1 over the documents that have words."""
    held = counts.filter("n > 0")
    total = held.agg(F.countDistinct("doc").alias("docs"))
    per_word = held.groupBy("word").agg(F.countDistinct("doc").alias("df"))
    return per_word.join(F.broadcast(total)).select("word", "df", (F.log((F.col("docs") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """doc, word, w: relative frequencies times idf, of length 1 for each document (a zero length is left as it is)."""
    doc = Window.partitionBy("doc")
    raw = counts.join(idf, "word").withColumn("w", F.col("n") / F.sum("n").over(doc) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc))
    return raw.select("doc", "word", F.when(length > 0, F.col("w") / length).otherwise(F.col("w")).alias("w"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays of doubles; 1 when one is all zeros."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths > 0, 1 - dot(a, b) / lengths).otherwise(1.0)


def nearest_vectors(df: DataFrame, key: str, vector: str, query: list[float], k: int = NEIGHBOURS) -> DataFrame:
    """key and _distance of the k vectors nearest by cosine, ties to the smaller key: a bounded heap in each task. Null vectors and such of another length are left out."""
    v, q = F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in query])
    rows = df.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    return rows.select(F.col(key), cosine_distance(v, q).alias("_distance")).orderBy("_distance", key).limit(k)


def nearest_exact(words: DataFrame, query: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """doc, _distance of the k nearest documents among all; words and query (word, w) are sparse."""
    asked = F.broadcast(query.select("word", F.col("w").alias("wq")))  # as long as the codebook at most
    size = F.broadcast(asked.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("length_q")))
    scored = words.join(asked, "word", "left").groupBy("doc").agg(F.sum(F.coalesce(F.col("w") * F.col("wq"), F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    below = F.col("length") * F.col("length_q")
    distance = F.when(below > 0, 1 - F.col("dot") / below).otherwise(1.0)
    return scored.join(size).select("doc", distance.alias("_distance")).orderBy("_distance", "doc").limit(k)


def nearest_inverted(words: DataFrame, query: DataFrame, k: int = NEIGHBOURS, active: int = ACTIVE_WORDS, candidates: int = CANDIDATES) -> DataFrame:
    """As nearest_exact, but only among the `candidates` best documents by the query's `active` heaviest words."""
    top = query.filter("w > 0").orderBy(F.desc("w"), "word").limit(active).select("word", F.col("w").alias("wq"))
    found = words.filter("w > 0").join(F.broadcast(top), "word").groupBy("doc").agg(F.sum(F.col("w") * F.col("wq")).alias("part")).orderBy(F.desc("part"), "doc").limit(candidates)
    return nearest_exact(words.join(F.broadcast(found.select("doc")), "doc", "left_semi"), query, k)
