"""How distinctive a term is of a record (problem 6).

Postings come in the vertical layout (terms.containers): they meet the corpus totals of their term as one
row per term, chunk and batch. The totals of terms with at least a HEAVY-th of all postings, at most HEAVY terms therefore, go to
every task, so the containers of a term that a third of all records hold stay where they are and are
never gathered; those of rarer terms meet their totals by a join. Two scores are worked out on the containers' flat arrays:

enrichment: with M term occurrences in the corpus, K of this term and n in the record, the number of this
term in the record is hypergeometric if terms were dealt at random. p is the exact probability of the count
found or a higher one, summed from log-gamma terms; it is adjusted for false discoveries within the record
(Benjamini-Hochberg), and the score is -log10 of the adjusted probability.

tfidf: tf * (ln((N + 1) / (df + 1)) + 1).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cantera.llm.frequency import totals
from cantera.llm.terms import ANY, CHUNK_BITS, containers
from cantera.session import fan_out, scratch, written


#: Terms whose totals may be sent to every task.
HEAVY = 10_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series from 10 up, reached by the recurrence."""
    x = np.asarray(x, np.float64)
    product, y = np.ones_like(x), x.copy()
    for _ in range(10):
        small = y < 10
        product = np.where(small, product * y, product)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def log_upper_tail(x: np.ndarray, total: np.ndarray, marked: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """ln P(X >= x) of a hypergeometric X: `drawn` of `total` things are taken, of which `marked` are marked."""
    x, total, marked, drawn = (np.asarray(v, np.float64) for v in np.broadcast_arrays(x, total, marked, drawn))
    low, most = np.maximum(0, drawn + marked - total), np.minimum(marked, drawn)
    # The shorter tail's terms fall quickly, so it is the one that is summed: from x up, or from x - 1 down.
    upward = x > drawn * marked / total
    at = np.where(upward, x, x - 1)
    first = log_choose(marked, np.clip(at, low, most)) + log_choose(total - marked, drawn - np.clip(at, low, most)) - log_choose(total, drawn)
    step, ratio, tail = at.copy(), np.ones_like(x), np.ones_like(x)
    live = (at >= low) & (at <= most)
    tail[~live] = 0
    while live.any():
        k = step[live]
        m, d, t = marked[live], drawn[live], total[live]
        up = upward[live]
        r = np.where(up, (m - k) * (d - k) / np.maximum((k + 1) * (t - m - d + k + 1), 1e-300), k * (t - m - d + k) / np.maximum((m - k + 1) * (d - k + 1), 1e-300))
        new = ratio[live] * np.maximum(r, 0)
        ratio[live] = new
        tail[live] += new
        step[live] = np.where(up, k + 1, k - 1)
        live[live] = new > 1e-17 * tail[live]
    with np.errstate(divide="ignore"):
        summed = first + np.log(tail)
    with np.errstate(divide="ignore", invalid="ignore"):
        other = np.log1p(-np.exp(np.minimum(summed, 0)))
    result = np.where(upward, summed, np.where(tail > 0, other, 0.0))
    return np.where(x <= low, 0.0, np.minimum(result, 0.0))


def _scores(how: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, chunk = batch.column(0), batch.column(1).to_numpy()
            numbers, counts, lengths = batch.column(2), batch.column(3), batch.column(4)
            held = np.diff(numbers.offsets.to_numpy())
            n, c, size = numbers.flatten().to_numpy(), counts.flatten().to_numpy(), lengths.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), held)
            df, occurrences = batch.column(5).to_numpy()[row], batch.column(6).to_numpy()[row]
            with_terms, every = batch.column(7).to_numpy()[row], batch.column(8).to_numpy()[row]
            if how == "tfidf":
                score = c * (np.log((with_terms + 1) / (df + 1)) + 1)
            else:
                score = log_upper_tail(c, every, occurrences, size)
            yield pa.RecordBatch.from_arrays([pa.array((chunk[row] << CHUNK_BITS) + n), term.take(pa.array(row)), pa.array(c), pa.array(df), pa.array(score)], names=["key", "term", "tf", "df", "score"])

    return run


def _scored(df: DataFrame, key: str, text: str, how: str) -> DataFrame:
    parts = fan_out(df)
    found = written(containers(df, key, text))
    per_term = totals(found, parts)
    every = per_term.filter(F.col("term") == ANY).select(F.col("n_records").alias("with_terms"), F.col("n_occurrences").alias("every"))  # one row at most
    of_terms, held = per_term.filter(F.col("term") != ANY), found.filter(F.col("term") != ANY)
    postings = of_terms.agg(F.sum("n_records")).first()[0] or 0
    heavy = F.col("n_records") >= postings / HEAVY
    many = held.join(F.broadcast(of_terms.filter(heavy)), "term")
    few = held.join(F.broadcast(of_terms.filter(heavy).select("term")), "term", "left_anti").join(of_terms.filter(~heavy), "term")
    columns = ["term", "chunk", "numbers", "counts", "lengths", "n_records", "n_occurrences", "with_terms", "every"]
    return many.unionByName(few).join(F.broadcast(every)).select(*columns).mapInArrow(_scores(how), "key bigint, term string, tf int, df bigint, score double")


def characteristic_terms(df: DataFrame, key: str, text: str, top: int = 3) -> DataFrame:
    """key, term, tf, df, score, rank: the `top` terms of each record by tf-idf, ties to the term first in alphabetical order.

    Null keys are left out, records without terms give no rows, repeated rows count once; an empty table gives no rows."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "term")
    with scratch() as keep:
        return keep(_best(df, key, text, top, order))


def _best(df: DataFrame, key: str, text: str, top: int, order) -> DataFrame:
    # A record delivered again has equal rows, which get equal ranks: dense_rank, then one of each.
    ranked = _scored(df, key, text, "tfidf").withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= top)
    return ranked.dropDuplicates(["key", "term"])


def enriched_terms(df: DataFrame, key: str, text: str, top: int = 3, most_false: float = 0.05) -> DataFrame:
    """key, term, tf, df, score, rank: the `top` terms of each record by enrichment among those whose adjusted probability is at most most_false.

    score is -log10 of the probability adjusted within the record (a record's terms are the tests). Ties go to the
    term first in alphabetical order. Null keys, texts without terms, repeated rows and empty tables as in characteristic_terms."""
    with scratch() as keep:
        return keep(_enriched(df, key, text, top, most_false))


def _enriched(df: DataFrame, key: str, text: str, top: int, most_false: float) -> DataFrame:
    rows = _scored(df, key, text, "enrichment").dropDuplicates(["key", "term"])
    record = Window.partitionBy("key")
    tests = F.count("*").over(record)
    place = F.row_number().over(record.orderBy("score", "term"))
    adjusted = rows.select("key", "term", "tf", "df", (F.col("score") + F.log(tests.cast("double")) - F.log(place.cast("double"))).alias("raw"), place.alias("place"))
    from_worst = record.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = adjusted.withColumn("score", F.greatest(F.lit(0.0), -F.min("raw").over(from_worst) / F.log(F.lit(10.0))))
    ranked = scored.withColumn("rank", F.row_number().over(record.orderBy(F.desc("score"), F.col("raw"), "term")))
    return ranked.filter((F.col("rank") <= top) & (F.col("score") >= -math.log10(most_false))).select("key", "term", "tf", "df", "score", "rank")
