"""The queries of the problems tagged llm, by name; each takes a session and a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.llm import clusters, distinctive, frequency, mixture, near_duplicates, oracle, reading, similar_vectors, tokens
from cantera.session import scratch, table


#: Extractor, table, column and length of the two vector tables.
VECTORS = (("mfcc", "audio_mfcc", "mfccs", 25), ("sift", "imagen_sift", "sift", 128))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(extractor: str, name: str, column: str, dim: int) -> DataFrame:
        found = similar_vectors.neighbours_above(table(spark, sf_dir, name), "vec_id", column, dim, k=10, least=0.996, late=False)
        return similar_vectors.mutual_pairs(found).select(F.lit(extractor).alias("extractor"), "vec_a", "vec_b")

    return one(*VECTORS[0]).unionByName(one(*VECTORS[1]))


def p1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar vectors of each vector whose id is divisible by 100."""

    def one(extractor: str, name: str, column: str, dim: int) -> DataFrame:
        found = similar_vectors.nearest_of(table(spark, sf_dir, name), "vec_id", column, dim, every_nth=100, k=10)
        return found.select(F.lit(extractor).alias("extractor"), "vec", "other", F.round("cosine", 6).alias("cosine"), "rank")

    return one(*VECTORS[0]).unionByName(one(*VECTORS[1]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "canciones"), "id", "song", "texto", threshold=0.5)
    return found.select(F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "canciones"), "id", "song", "texto", threshold=0.5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.term_frequency(table(spark, sf_dir, "canciones"), "id", "texto").filter("mark <> 'useful'").select("term", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.term_frequency(table(spark, sf_dir, "canciones"), "id", "texto")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(extractor: str, name: str, column: str, dim: int) -> DataFrame:
        found = clusters.similarity_clusters(table(spark, sf_dir, name), "vec_id", column, dim)
        return found.select(F.lit(extractor).alias("extractor"), "vec_id", "cluster_id", "size", F.round("cosine", 6).alias("cosine"), "typical_rank")

    return one(*VECTORS[0]).unionByName(one(*VECTORS[1]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_clusters(spark, sf_dir).select("extractor", "vec_id", "cluster_id")


def p4_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most typical members of each cluster."""
    return p4_clusters(spark, sf_dir).filter("typical_rank is not null")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distinctive.characteristic_terms(table(spark, sf_dir, "canciones"), "id", "texto", top=3)
    return found.select(F.col("key").cast("int").alias("id"), "term")


def p6_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distinctive.enriched_terms(table(spark, sf_dir, "canciones"), "id", "texto", top=3)
    return found.select(F.col("key").cast("int").alias("id"), "term", "tf", "df", F.round("score", 4).alias("score"), "rank")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k")


#: Domain of each source of the mixture.
DOMAINS = {
    "letras": "musica", "notas_audio": "musica", "archivo_radio": "musica", "resenas_alojamiento": "viaje", "guia_ciudad": "viaje",
    "boletin_local": "viaje", "catalogo_moda": "comercio", "fichas_juego": "comercio", "foro_motor": "tecnica", "manual_motor": "tecnica",
}


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        return keep(mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mezcla_objetivo"), DOMAINS, total_tokens="all")[0])


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        return keep(mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mezcla_objetivo"), DOMAINS, total_tokens="all")[1])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grades that p9_levels clamps."""
    return reading.grades(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "nivel")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_level(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("score", F.round("score", 2))


QUERIES = {f.__name__: f for f in (p1_found, p1_knn, p2_found, p2_classes, p3_found, p3_terms, p4_found, p4_clusters, p4_typical, p6_found, p6_enriched, p7_ids, p8_mixture, p8_shares, p9_found, p9_levels)}
ORACLE_SQL: dict[str, str] = oracle.sql(VECTORS)
