"""Ranked full-text search: tokens, inverted index, TF-IDF cosine."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.functions.stemmer import STOP_STEMS, stem
from cantera.session import scratch, written


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, all other characters separate; an empty array for null and empty texts. Accents aren't folded."""
    return F.filter(F.split(F.coalesce(F.lower(text), F.lit("")), "[^a-z0-9]+"), lambda t: t != "")


def query_terms(query: str, stemmed: bool = True) -> Counter:
    words = re.findall("[a-z0-9]+", query.lower())
    return Counter(s for w in words if (s := stem(w)) not in STOP_STEMS) if stemmed else Counter(words)


@F.pandas_udf(T.StringType())
def _stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for w in words:
        yield w.map(lambda x: None if (s := stem(x)) in STOP_STEMS else s)


def term_counts(df: DataFrame, key: str, text: str, stemmed: bool = True) -> DataFrame:
    """doc, term, tf. Stems are worked out once per distinct token; tokens are counted once and kept for that. Null keys and documents without terms have no rows."""
    raw = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.explode(tokens(F.col(text))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    if not stemmed:
        return raw
    raw = written(raw)
    known = written(raw.select("term").distinct().withColumn("stem", _stems("term")).filter("stem is not null"))
    return raw.join(known, "term").groupBy("doc", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def document_count(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row, n: documents with a non-empty text."""
    return df.filter(F.col(key).isNotNull() & (F.coalesce(F.length(text), F.lit(0)) > 0)).agg(F.count("*").alias("n"))


def inverse_frequency(counts: DataFrame, total: DataFrame) -> DataFrame:
    """term, df, idf with idf = ln((n + 1) / (df + 1)) + 1; total is one row."""
    per_term = counts.groupBy("term").agg(F.count("*").alias("df"))
    return per_term.join(F.broadcast(total)).select("term", "df", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def norms(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """doc, n_terms, norm of the documents' TF-IDF vectors."""
    w = F.col("tf") * F.col("idf")
    return counts.join(idf, "term").groupBy("doc").agg(F.count("*").alias("n_terms"), F.sqrt(F.sum(w * w)).alias("norm"))


class TextIndex:
    """Postings (term, doc, tf), terms (term, df, idf) and documents (doc, n_terms, norm)."""

    def __init__(self, postings: DataFrame, terms: DataFrame, docs: DataFrame, stemmed: bool = True):
        self.postings, self.terms, self.docs, self.stemmed = postings, terms, docs, stemmed

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, stemmed: bool = True, path: str | None = None) -> "TextIndex":
        """From a table; with a path kept as Parquet, in order of terms so that a query reads few row groups."""
        if not path:
            postings = term_counts(df, key, text, stemmed)
        else:
            with scratch():
                term_counts(df, key, text, stemmed).repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
            postings = df.sparkSession.read.parquet(f"{path}/postings")
        terms = inverse_frequency(postings, document_count(df, key, text))
        if path:
            terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
            terms = df.sparkSession.read.parquet(f"{path}/terms")
        docs = norms(postings, terms)
        if path:
            docs.write.mode("overwrite").parquet(f"{path}/docs")
        return cls(postings, terms, df.sparkSession.read.parquet(f"{path}/docs") if path else docs, stemmed)

    @classmethod
    def load(cls, spark, path: str, stemmed: bool = True) -> "TextIndex":
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "docs")), stemmed)

    def search(self, query: str, limit: int | None = 100, normalize: bool = True) -> DataFrame:
        """doc, _score of the best documents, by (-score, doc as a string). A query without known terms has no results.

        score = sum of tf_d idf * tf_q idf over the query's known terms, divided by the query's norm and, with normalize, the document's; a zero norm counts as 1."""
        spark = self.postings.sparkSession
        wanted = query_terms(query, self.stemmed)
        names = list(wanted)
        asked = spark.createDataFrame([(t, float(n)) for t, n in wanted.items()], "term string, tf_q double")  # as long as the query
        known = F.broadcast(self.terms.filter(F.col("term").isin(names)).join(F.broadcast(asked), "term").select("term", "idf", (F.col("tf_q") * F.col("idf")).alias("wq")))
        norm = F.broadcast(known.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("norm_q")))
        dots = self.postings.filter(F.col("term").isin(names)).join(known, "term").groupBy("doc").agg(F.sum(F.col("tf") * F.col("idf") * F.col("wq")).alias("dot"))
        scored = dots.join(norm)
        below = F.when(F.col("norm_q") == 0, 1.0).otherwise(F.col("norm_q"))
        if normalize:
            scored = scored.join(self.docs, "doc")
            below = below * F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))
        ranked = scored.select("doc", (F.col("dot") / below).alias("_score"))
        return ranked if limit is None else ranked.orderBy(F.desc("_score"), F.col("doc").cast("string")).limit(limit)
