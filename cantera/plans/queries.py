"""The core's queries by name, and equivalent SQL.

Each query runs on whole tables; a limit is there only where it is the feature (top-k, nearest, ranked search).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantera.engine import Engine
from cantera.functions.render import arrays_as_text, similarity_percent
from cantera.lang import ast
from cantera.lang.parser import parse
from cantera.operators import codewords, spatial, text
from cantera.plans import p5
from cantera.plans.binder import Binder
from cantera.session import shared_dir, table
from cantera.sources import media
from cantera.sources.catalog import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TYPES = {"int": "INT", "bigint": "BIGINT", "double": "FLOAT", "string": "TEXT", "timestamp_ntz": "TIME", "timestamp": "TIME", "array<float>": "ARRAY"}


def bound(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A SELECT of the dialect over a Parquet table that no catalog holds."""
    (s,) = parse(statement)
    base = table(spark, sf_dir, s.table)
    columns = [ast.ColumnDef(n, _TYPES.get(t, "TEXT"), key=i == 0) for i, (n, t) in enumerate(base.dtypes)]
    df = Binder(Table(s.table, columns), base, lambda c, limit: None).bind(s.where, s.limit)
    if s.order:
        df = df.orderBy(F.col(s.order).desc() if s.descending else F.col(s.order).asc(), columns[0].name)
    if s.limit is not None:
        df = (df if s.order else df.orderBy(columns[0].name)).limit(s.limit)
    return df.select(*s.columns) if s.columns else df


def _dialect(name: str, statement: str, sql: str | None = None) -> None:
    """A query that is one SELECT of the dialect; most are valid SQL as they stand."""
    QUERIES[name] = lambda spark, sf_dir: bound(spark, sf_dir, statement)
    ORACLE_SQL[name] = sql or statement


for _name, _statement in {
    "scan_project": "SELECT p_partkey, p_name, p_size FROM part",
    "filter_eq": "SELECT p_partkey, p_size FROM part WHERE p_size = 15",
    "filter_ne": "SELECT p_partkey, p_size FROM part WHERE p_size != 15",
    "filter_lt": "SELECT p_partkey, p_size FROM part WHERE p_size < 10",
    "filter_le": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 50000.5",
    "filter_gt": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000",
    "filter_ge": "SELECT p_partkey, p_size FROM part WHERE p_size >= 40",
    "filter_eq_string": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "between_int": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "between_double": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000.5 AND 90000",
    "between_string": "SELECT p_partkey, p_brand FROM part WHERE p_brand BETWEEN 'Brand#2' AND 'Brand#4'",
    "bool_and": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05",
    "bool_or": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5 OR l_returnflag = 'R'",
    "bool_nested": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' OR l_quantity > 40 AND (l_linestatus = 'O' OR l_tax < 0.02)",
    "pk_lookup": "SELECT * FROM orders WHERE o_orderkey = 7",
    "order_limit_asc": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC LIMIT 50",
    "order_limit_desc": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 50",
    "topk": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 10 AND 20 ORDER BY p_partkey LIMIT 50",
}.items():
    _dialect(_name, _statement, _statement.replace(" ASC LIMIT", ", o_orderkey LIMIT").replace(" DESC LIMIT", " DESC, o_orderkey LIMIT"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
def between_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def secondary_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


# --- space ---
_GRID = "SELECT p_partkey, [CAST(p_size AS DOUBLE), floor(p_retailprice / 100)] AS p FROM part"


def _grid(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 100).cast("double")).alias("p"))


def _euclid(v: str, point: list[float]) -> str:
    return "sqrt(" + " + ".join(f"pow(CAST({v}[{i}] AS DOUBLE) - {p}, 2)" for i, p in enumerate(point, 1)) + ")"


@query(f"SELECT vec_id FROM embeddings WHERE {_euclid('embedding', [0.05, -0.05])} <= 0.1")
def spatial_radius_2d(spark, sf_dir):
    return spatial.within_radius(table(spark, sf_dir, "embeddings"), "embedding", (0.05, -0.05), 0.1).select("vec_id")


@query(f"SELECT vec_id FROM embeddings WHERE {_euclid('embedding', [0.0, 0.0, 0.0])} <= 0.15")
def spatial_radius_3d(spark, sf_dir):
    return spatial.within_radius(table(spark, sf_dir, "embeddings"), "embedding", (0.0, 0.0, 0.0), 0.15).select("vec_id")


@query(f"SELECT vec_id, round({_euclid('embedding', [0.05, -0.05])}, 6) AS distance FROM embeddings ORDER BY {_euclid('embedding', [0.05, -0.05])}, vec_id LIMIT 10")
def spatial_knn_2d(spark, sf_dir):
    found = spatial.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", (0.05, -0.05), 10, ties=False, tie_break=("vec_id",))
    return found.select("vec_id", F.round("_distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_euclid('embedding', [0.1, 0.0, -0.1])}, 6) AS distance FROM embeddings ORDER BY {_euclid('embedding', [0.1, 0.0, -0.1])}, vec_id LIMIT 20")
def spatial_knn_3d(spark, sf_dir):
    found = spatial.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", (0.1, 0.0, -0.1), 20, ties=False, tie_break=("vec_id",))
    return found.select("vec_id", F.round("_distance", 6).alias("distance"))


@query(f"WITH g AS ({_GRID}), r AS (SELECT p_partkey, rank() OVER (ORDER BY {_euclid('p', [25.0, 10.0])}) AS k FROM g) SELECT p_partkey FROM r WHERE k <= 10")
def knn_ties(spark, sf_dir):
    return spatial.nearest(_grid(spark, sf_dir), "p", (25.0, 10.0), 10).select("p_partkey")


@query(f"WITH g AS ({_GRID}), r AS (SELECT p_partkey, rank() OVER (ORDER BY {_euclid('p', [25.0, 10.0])}) AS k FROM g) SELECT p_partkey FROM r JOIN part USING (p_partkey) WHERE k <= 10 AND p_partkey < 1000")
def knn_then_filter(spark, sf_dir):
    found = spatial.nearest(_grid(spark, sf_dir), "p", (25.0, 10.0), 10).select("p_partkey")
    return table(spark, sf_dir, "part").filter("p_partkey < 1000").join(found, "p_partkey", "left_semi").select("p_partkey")


# --- text ---
_TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: t <> '')"
_TF = f"tok AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
_IDF = f"{_TF}, n AS (SELECT count(*) AS n FROM documents WHERE length(coalesce(text, '')) > 0), idf AS (SELECT term, count(*) AS df, ln((max(n) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM tf, n GROUP BY term)"
_NORM = f"{_IDF}, norm AS (SELECT doc_id, count(*) AS n_terms, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tf JOIN idf USING (term) GROUP BY doc_id)"
SEARCHED = "luz casa river street strong"
_SEARCH = f"{_NORM}, q AS (SELECT term, idf, idf AS wq FROM idf WHERE term IN ({', '.join(repr(t) for t in SEARCHED.split())})), qn AS (SELECT sqrt(sum(wq * wq)) AS qn FROM q), s AS (SELECT doc_id, sum(tf * idf * wq) AS dot FROM tf JOIN q USING (term) GROUP BY doc_id), ranked AS (SELECT doc_id, dot / (qn * norm) AS score FROM s JOIN norm USING (doc_id), qn)"


def _counts(spark, sf_dir):
    return text.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text", stemmed=False)


def _idf(spark, sf_dir, counts):
    return text.inverse_frequency(counts, text.document_count(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"SELECT doc_id, len({_TOKENS}) AS n_tokens FROM documents")
def text_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query(f"WITH {_TF} SELECT doc_id, term, tf FROM tf")
def text_tf(spark, sf_dir):
    return _counts(spark, sf_dir).select(F.col("doc").alias("doc_id"), "term", "tf")


@query(f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def text_df_idf(spark, sf_dir):
    return _idf(spark, sf_dir, _counts(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_NORM} SELECT doc_id, n_terms, round(norm, 4) AS norm FROM norm")
def text_norms(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return text.norms(counts, _idf(spark, sf_dir, counts)).select(F.col("doc").alias("doc_id"), "n_terms", F.round("norm", 4).alias("norm"))


def _index(spark, sf_dir, stemmed=False):
    return text.TextIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text", stemmed=stemmed, path=f"{shared_dir(spark)}/text-{uuid.uuid4().hex}")


@query(f"WITH {_SEARCH} SELECT doc_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, CAST(doc_id AS VARCHAR) LIMIT 20")
def text_search(spark, sf_dir):
    return _index(spark, sf_dir).search(SEARCHED, 20).select(F.col("doc").alias("doc_id"), F.round("_score", 6).alias("score"))


@query(f"WITH {_SEARCH}, top AS (SELECT * FROM ranked ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 20) SELECT doc_id, lang, source, round(score, 6) AS score FROM top JOIN documents USING (doc_id)")
def text_search_join(spark, sf_dir):
    found = _index(spark, sf_dir).search(SEARCHED, 20)
    return table(spark, sf_dir, "documents").join(found.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "lang", "source", F.round("_score", 6).alias("score"))


@query()
def text_search_stemmed(spark, sf_dir):
    return _index(spark, sf_dir, stemmed=True).search("houses of strong singers", 20).select(F.col("doc").alias("doc_id"), F.round("_score", 6).alias("score"))


# --- vectors and words of descriptors ---
_V = "CAST(embedding AS DOUBLE[])"
_FIRST = f"q AS (SELECT {_V} AS q FROM embeddings WHERE vec_id = 0)"
_COS = f"{_FIRST}, d AS (SELECT vec_id, 1 - list_dot_product({_V}, q) / (sqrt(list_dot_product({_V}, {_V})) * sqrt(list_dot_product(q, q))) AS dist FROM embeddings, q)"
_WORDS = f"raw AS (SELECT vec_id AS doc, unnest({_V}) AS n, generate_subscripts({_V}, 1) - 1 AS word FROM embeddings), c AS (SELECT doc, word, n FROM raw WHERE n > 0), widf AS (SELECT word, count(DISTINCT doc) AS df, ln(((SELECT count(DISTINCT doc) FROM c) + 1.0) / (count(DISTINCT doc) + 1.0)) + 1.0 AS idf FROM c GROUP BY word), w0 AS (SELECT doc, word, n / sum(n) OVER (PARTITION BY doc) * idf AS w FROM c JOIN widf USING (word)), w AS (SELECT doc, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w0)"
_INV = f"{_WORDS}, qw AS (SELECT word, w AS wq FROM w WHERE doc = 0), act AS (SELECT * FROM qw ORDER BY wq DESC, word LIMIT 35), cand AS (SELECT doc, sum(w * wq) AS part FROM w JOIN act USING (word) GROUP BY doc ORDER BY part DESC, doc LIMIT 10000), d AS (SELECT doc, 1 - sum(coalesce(w * wq, 0)) / (sqrt(sum(w * w)) * (SELECT sqrt(sum(wq * wq)) FROM qw)) AS dist FROM w LEFT JOIN qw USING (word) WHERE doc IN (SELECT doc FROM cand) GROUP BY doc)"


def _first_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query(f"WITH {_COS} SELECT vec_id, round(dist, 6) AS distance FROM d ORDER BY dist, vec_id LIMIT 10")
def vec_cosine_knn(spark, sf_dir):
    found = codewords.nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf_dir), 10)
    return found.select("vec_id", F.round(F.abs("_distance"), 6).alias("distance"))


@query(f"WITH {_COS} SELECT vec_id, CASE WHEN (1 - dist) * 100 > 99.9999 THEN 100.0 WHEN (1 - dist) * 100 < 0.0001 THEN 0.0 ELSE round((1 - dist) * 100, 4) END AS percent FROM d ORDER BY dist, vec_id LIMIT 10")
def similarity_percent_knn(spark, sf_dir):
    found = codewords.nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf_dir), 10)
    return found.select("vec_id", similarity_percent(F.col("_distance")).alias("percent"))


def _word_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.posexplode(F.col("embedding").cast("array<double>")).alias("word", "n"))
    return rows.filter("n > 0")


def _word_weights(spark, sf_dir):
    counts = _word_counts(spark, sf_dir)
    return codewords.weights(counts, codewords.word_idf(counts))


@query(f"WITH {_WORDS} SELECT CAST(word AS INT) AS word, df, round(idf, 6) AS idf FROM widf")
def codeword_df_idf(spark, sf_dir):
    return codewords.word_idf(_word_counts(spark, sf_dir)).select("word", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_WORDS} SELECT doc AS vec_id, CAST(word AS INT) AS word, round(w, 6) AS w FROM w")
def tfidf_vectors(spark, sf_dir):
    return _word_weights(spark, sf_dir).select(F.col("doc").alias("vec_id"), "word", F.round("w", 6).alias("w"))


@query(f"WITH {_INV} SELECT doc AS vec_id, abs(round(dist, 6)) AS distance FROM d ORDER BY dist, doc LIMIT 10")
def vec_knn_inverted(spark, sf_dir):
    words = _word_weights(spark, sf_dir)
    found = codewords.nearest_inverted(words, words.filter("doc = 0").select("word", "w"), 10)
    return found.select(F.col("doc").alias("vec_id"), F.abs(F.round("_distance", 6)).alias("distance"))


def _first_centroids(spark, sf_dir):
    """A codebook that SQL can name too: the embeddings with the ids 0 to 15."""
    return table(spark, sf_dir, "embeddings").filter("vec_id < 16").select(F.col("vec_id").cast("int").alias("word"), F.col("embedding").cast("array<double>").alias("centroid"))


def _descriptors(spark, sf_dir, doc):
    return table(spark, sf_dir, "embeddings").select(doc.alias("doc"), F.col("embedding").cast("array<double>").alias("descriptor"))


_QUANTISED = f"cw AS (SELECT vec_id AS word, {_V} AS c FROM embeddings WHERE vec_id < 16), near AS (SELECT e.vec_id, e.label, arg_min(cw.word, list_distance({_V.replace('embedding', 'e.embedding')}, cw.c)) AS word FROM embeddings e, cw GROUP BY e.vec_id, e.label)"


@query(f"WITH {_QUANTISED} SELECT label, CAST(word AS INT) AS word, CAST(count(*) AS DOUBLE) AS n FROM near GROUP BY label, word")
def codebook_quantise(spark, sf_dir):
    return codewords.word_histograms(_descriptors(spark, sf_dir, F.col("label")), codewords.codebook(_first_centroids(spark, sf_dir))).select(F.col("doc").alias("label"), "word", "n")


@query()
def codebook_histograms(spark, sf_dir):
    """Words of the embeddings under a learned codebook of 16 words, by label as the document."""
    rows = _descriptors(spark, sf_dir, F.col("label"))
    words = codewords.codebook(codewords.centroids_of(codewords.fit_codebook(rows, 16), spark))
    return codewords.word_histograms(rows, words).select(F.col("doc").alias("label"), "word", "n")


# --- tables of the engine ---
def _engine(spark, **options) -> Engine:
    return Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", **options)


def _result(e: Engine, statement: str) -> DataFrame:
    """The rows of one SELECT; whatever fails is raised."""
    return e.run(parse(statement)[0]).data


_PART = "CREATE TABLE part (p_partkey BIGINT KEY INDEX BTREE, p_name VARCHAR[60], p_brand VARCHAR[20] INDEX HASH, p_type TEXT, p_size INT, p_retailprice FLOAT)"


def _loaded(spark, sf_dir) -> Engine:
    e = _engine(spark)
    e.run(parse(_PART)[0])
    e.insert_rows("part", table(spark, sf_dir, "part"))
    return e


@query("SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT 9000000001, 'nuevo', 7")
def insert_rows(spark, sf_dir):
    e = _loaded(spark, sf_dir)
    e.run(parse("INSERT INTO part VALUES (9000000001, 'nuevo', 'Brand#9', 'x', 7, 1.5)")[0])
    return e.select("part", ("p_partkey", "p_name", "p_size"))


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size < 10 OR p_size BETWEEN 30 AND 40)")
def delete_where(spark, sf_dir):
    e = _loaded(spark, sf_dir)
    e.run(parse("DELETE FROM part WHERE p_size < 10 OR p_size BETWEEN 30 AND 40")[0])
    return e.select("part", ("p_partkey", "p_size"))


@query("SELECT count(*) AS deleted_count, 0 AS left_count FROM part")
def delete_all_count(spark, sf_dir):
    e = _loaded(spark, sf_dir)
    n = e.delete("part")
    return e.select("part").agg(F.lit(n).cast("bigint").alias("deleted_count"), F.count("*").cast("int").alias("left_count"))


@query("SELECT CAST(c_custkey AS INT) AS c_custkey, c_name, c_nationkey, CAST(c_acctbal AS FLOAT) AS c_acctbal, c_mktsegment FROM customer")
def csv_infer_load(spark, sf_dir):
    e = _engine(spark)
    path = f"{e.catalog.root}/customer.csv"
    table(spark, sf_dir, "customer").write.csv(path, header=True, quote='"', escape='"')
    e.run(parse(f"CREATE TABLE customer FROM FILE '{path}' USING PRIMARY INDEX BTREE(c_custkey), INDEX HASH(c_mktsegment)")[0])
    return e.select("customer")


@query("SELECT 'part' AS \"table\", count(*) AS row_count, 'p_partkey BIGINT, p_name VARCHAR[60], p_brand VARCHAR[20], p_type TEXT, p_size INT, p_retailprice FLOAT' AS columns FROM part")
def catalog_metadata(spark, sf_dir):
    return _loaded(spark, sf_dir).tables()


@query("SELECT p_brand, p_partkey, k FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def topk_per_group(spark, sf_dir):
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("k", F.row_number().over(order).cast("bigint")).filter("k <= 3").select("p_brand", "p_partkey", "k")


def _keyed(spark, sf_dir, kind: str) -> Engine:
    """part by its key in one of the primary layouts, with HASH brands and RTREE points."""
    e = _engine(spark)
    e.run(parse(f"CREATE TABLE part (p_partkey BIGINT KEY INDEX {kind}, p_brand VARCHAR[20] INDEX HASH, p_size INT)")[0])
    e.insert_rows("part", table(spark, sf_dir, "part"))
    return e


def _layout(kind: str) -> None:
    statement = "SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey BETWEEN 100 AND 160 OR p_partkey = 7 OR p_partkey < 3 OR p_partkey >= 1990 AND p_partkey <= 1999"
    QUERIES[f"layout_{kind.lower()}"] = lambda spark, sf_dir: _result(_keyed(spark, sf_dir, kind), statement)
    ORACLE_SQL[f"layout_{kind.lower()}"] = statement


for _kind in ("SEQ", "ISAM", "BTREE"):
    _layout(_kind)


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#13' OR p_brand = 'Brand#22' AND p_size > 10")
def hash_lookup(spark, sf_dir):
    return _result(_keyed(spark, sf_dir, "SEQ"), "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#13' OR p_brand = 'Brand#22' AND p_size > 10")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def secondary_fetch(spark, sf_dir):
    """Keys that another table gives, looked up in the primary layout."""
    keys = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return _keyed(spark, sf_dir, "BTREE").fetch("part", keys).select("p_partkey", "p_size")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def between_date_dialect(spark, sf_dir):
    e = _engine(spark)
    e.run(parse("CREATE TABLE orders (o_orderkey BIGINT KEY, o_orderdate DATE)")[0])
    e.insert_rows("orders", table(spark, sf_dir, "orders"))
    return _result(e, "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN '1995-01-01' AND '1996-12-31'")


def _pointed(spark, sf_dir) -> Engine:
    e = _engine(spark)
    e.run(parse("CREATE TABLE places (p_partkey BIGINT KEY INDEX SEQ, p_size INT, p ARRAY[2][FLOAT] INDEX RTREE)")[0])
    e.insert_rows("places", table(spark, sf_dir, "part").select("p_partkey", "p_size", F.array(F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 100).cast("double")).alias("p")))
    return e


_RANKED = f"WITH g AS ({_GRID}), r AS (SELECT p_partkey, rank() OVER (ORDER BY {_euclid('p', [25.0, 10.0])}) AS k FROM g)"


@query(f"WITH g AS ({_GRID}) SELECT p_partkey FROM g WHERE {_euclid('p', [20.0, 12.0])} <= 5")
def rtree_radius(spark, sf_dir):
    return _result(_pointed(spark, sf_dir), "SELECT p_partkey FROM places WHERE p IN ((20, 12), 5)")


@query(f"{_RANKED} SELECT p_partkey FROM r WHERE k <= 10")
def rtree_knn(spark, sf_dir):
    return _result(_pointed(spark, sf_dir), "SELECT p_partkey FROM places WHERE p KNN ((25, 10), 10)")


@query(f"{_RANKED} SELECT p_partkey FROM r JOIN part USING (p_partkey) WHERE k <= 10 AND p_partkey < 1000 OR p_size = 3")
def rtree_knn_in_tree(spark, sf_dir):
    return _result(_pointed(spark, sf_dir), "SELECT p_partkey FROM places WHERE p KNN ((25, 10), 10) AND p_partkey < 1000 OR p_size = 3")


@query(f"WITH g AS ({_GRID}), l AS (SELECT * FROM g WHERE {_euclid('p', [20.0, 12.0])} > 5), r AS (SELECT p_partkey, rank() OVER (ORDER BY {_euclid('p', [20.0, 12.0])}) AS k FROM l) SELECT p_partkey FROM r WHERE k <= 8")
def rtree_delete(spark, sf_dir):
    e = _pointed(spark, sf_dir)
    e.run(parse("DELETE FROM places WHERE p IN ((20, 12), 5)")[0])
    return _result(e, "SELECT p_partkey FROM places WHERE p KNN ((20, 12), 8)")


@query(f"WITH g AS ({_GRID}) SELECT p_partkey FROM g WHERE abs(p[1] - 6) < 1e-9 AND abs(p[2] - 9) < 1e-9")
def point_match(spark, sf_dir):
    return _grid(spark, sf_dir).filter(spatial.same_point("p", (6.0, 9.0))).select("p_partkey")


@query("SELECT p_partkey, '(' || p_size || ', ' || (p_partkey % 7) || ')' AS p FROM part")
def array_rendering(spark, sf_dir):
    return arrays_as_text(table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 7).alias("p")))


_BAD = {
    "a string for a number": "SELECT * FROM part WHERE p_size = 'x'", "a number for a string": "SELECT * FROM part WHERE p_brand < 3", "a range on HASH": "SELECT * FROM part WHERE p_brand BETWEEN 'A' AND 'B'",
    "no text index": "SELECT * FROM part WHERE p_brand @@ 'x'", "no media index": "SELECT * FROM part WHERE p_brand <-> 'x.jpg'", "no such column": "SELECT nada FROM part", "no points": "SELECT * FROM part WHERE p_size KNN ((1, 2), 3)",
    "half a number": "INSERT INTO part VALUES (1.5, 'x', 3)", "a key that is there": "INSERT INTO part VALUES (1, 'x', 3)",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'BindProblem')" for n in _BAD) + ") AS t(\"case\", error)")
def statement_errors(spark, sf_dir):
    e = _keyed(spark, sf_dir, "BTREE")
    return spark.createDataFrame([(n, str(e.sql(text)[0].error).partition(":")[0]) for n, text in _BAD.items()], "case string, error string")


# --- text and media through the dialect ---
def _indexed(spark, sf_dir, **options) -> tuple[Engine, int]:
    e = _engine(spark, stem=False, **options)
    e.run(parse("CREATE TABLE documents (doc_id BIGINT KEY, lang VARCHAR[20] INDEX HASH, text TEXT)")[0])
    e.insert_rows("documents", table(spark, sf_dir, "documents"))
    return e, e.run(parse("BUILD TEX_INV ON documents(text)")[0]).count


@query(f"WITH {_TF} SELECT count(DISTINCT doc_id) AS documents_indexed FROM tf")
def text_index_build(spark, sf_dir):
    return spark.createDataFrame([(_indexed(spark, sf_dir)[1],)], "documents_indexed bigint")


@query(f"WITH {_SEARCH} SELECT doc_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, CAST(doc_id AS VARCHAR) LIMIT 20")
def text_match(spark, sf_dir):
    found = _result(_indexed(spark, sf_dir)[0], f"SELECT doc_id, _score FROM documents WHERE text @@ '{SEARCHED}' LIMIT 20")
    return found.select("doc_id", F.round("_score", 6).alias("score"))


@query(f"WITH {_SEARCH} SELECT doc_id, round(score, 6) AS score FROM documents LEFT JOIN ranked USING (doc_id) WHERE score IS NOT NULL AND rtrim(lang) = 'es' OR doc_id < 10")
def text_match_in_tree(spark, sf_dir):
    found = _result(_indexed(spark, sf_dir, text_limit=None)[0], f"SELECT doc_id, _score FROM documents WHERE text @@ '{SEARCHED}' AND lang = 'es' OR doc_id < 10")
    return found.select("doc_id", F.round("_score", 6).alias("score"))


_MEDIA = f"WITH {_QUANTISED}, c AS (SELECT vec_id // 5 AS doc, word, CAST(count(*) AS DOUBLE) AS n FROM near GROUP BY ALL), widf AS (SELECT word, ln(((SELECT count(DISTINCT doc) FROM c) + 1.0) / (count(DISTINCT doc) + 1.0)) + 1.0 AS idf FROM c GROUP BY word), w0 AS (SELECT doc, word, n / sum(n) OVER (PARTITION BY doc) * idf AS w FROM c JOIN widf USING (word)), w AS (SELECT doc, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w0), d AS (SELECT x.doc, 1 - sum(coalesce(x.w * q.w, 0)) AS dist FROM w x LEFT JOIN (SELECT * FROM w WHERE doc = 3) q USING (word) GROUP BY x.doc)"


def _media(kind: str) -> None:
    """Files of five embeddings each, under a known codebook; the dialect's `<->` gives the ten most similar to one of them."""

    def run(spark, sf_dir):
        e = _engine(spark)
        e.run(parse(f"CREATE TABLE media (id BIGINT KEY, file IMAGE INDEX {kind} (clusters = 16))")[0])
        vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("id"), "embedding")
        files = vectors.groupBy("id").agg(F.collect_list("embedding").alias("descriptors")).withColumn("path", F.concat(F.lit("f"), "id", F.lit(".jpg")))
        e.catalog.append(e.catalog.get("media"), files.select("id", F.col("path").alias("file")))
        e.register_media("media", "file", files.select("path", "descriptors"), centroids=_first_centroids(spark, sf_dir))
        found = _result(e, "SELECT id, _distance FROM media WHERE file <-> 'f3.jpg' LIMIT 10")
        return found.select(F.round(F.abs("_distance"), 6).alias("distance"))

    QUERIES[f"media_{kind.lower()}"] = run
    ORACLE_SQL[f"media_{kind.lower()}"] = f"{_MEDIA} SELECT abs(round(dist, 6)) AS distance FROM d ORDER BY dist, doc LIMIT 10"


for _kind in ("KNN_SEQ", "KNN_INV"):
    _media(_kind)


def _files(spark, sf_dir) -> str:
    """A folder with a file for each nation, named by its key: jpg for even ones, wav for those divisible by 3, else txt; the name is the content."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows at every scale
        n = r["n_nationkey"]
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.{'jpg' if n % 2 == 0 else 'wav' if n % 3 == 0 else 'txt'}")
        stream = p.getFileSystem(conf).create(p, True)
        stream.write(bytearray(r["n_name"].encode()))
        stream.close()
    return folder


_NAMED = "named AS (SELECT n_name, CAST(n_nationkey AS VARCHAR) AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'jpg' ELSE 'wav' END AS kind FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0)"


@query(f"WITH {_NAMED} SELECT row_number() OVER (ORDER BY name || '.' || kind) - 1 AS doc_id, name, name AS external_id, length(n_name) AS size FROM named")
def media_source(spark, sf_dir):
    found = media.media_files(spark, _files(spark, sf_dir), id_from_filename=True)
    return found.select("doc_id", "name", "external_id", F.length("content").cast("bigint").alias("size"))


@query(f"WITH {_NAMED} SELECT name, length(n_name) AS n_descriptors FROM named WHERE kind = 'jpg' AND n_name NOT LIKE 'A%'")
def media_extraction(spark, sf_dir):
    """An extractor of the caller's, over all files in parallel; files that it fails on have no descriptors."""

    def one_per_byte(content: bytes) -> list:
        if content.startswith(b"A"):
            raise ValueError("not read")
        return [[float(b)] for b in content]

    found = media.extract(media.media_files(spark, _files(spark, sf_dir), "IMAGE"), "IMAGE", {"IMAGE": one_per_byte})
    return found.filter("descriptors is not null").select("name", F.size("descriptors").cast("bigint").alias("n_descriptors"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS name, 1 + (3000 + 700 * n_nationkey) // 512 AS frames, 25 AS width FROM nation")
def audio_frames(spark, sf_dir):
    """Cepstral coefficients of a tone for each nation, the longer the greater its key: a frame for each 512 samples that begin."""
    import io
    import wave

    import numpy as np

    folder = f"{shared_dir(spark)}/tones-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows at every scale
        n, held = r["n_nationkey"], io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(22_050)
            w.writeframes((10_000 * np.sin(np.arange(3000 + 700 * n) * (100 + 10 * n) / 3500)).astype("<i2").tobytes())
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.wav")
        stream = p.getFileSystem(conf).create(p, True)
        stream.write(bytearray(held.getvalue()))
        stream.close()
    found = media.extract(media.media_files(spark, folder, "AUDIO"), "AUDIO")
    return found.select("name", F.size("descriptors").cast("bigint").alias("frames"), F.size(F.get("descriptors", F.lit(0))).alias("width"))


@query("SELECT * FROM (VALUES ('10.wav', 'MediaProblem'), ('99.jpg', 'MediaProblem'), ('10.jpg', 'read')) AS t(file, outcome)")
def media_formats(spark, sf_dir):
    folder, outcome = _files(spark, sf_dir), []
    for name in ("10.wav", "99.jpg", "10.jpg"):
        try:
            media.checked(spark, f"{folder}/{name}", "IMAGE")
            outcome.append((name, "read"))
        except media.MediaProblem:
            outcome.append((name, "MediaProblem"))
    return spark.createDataFrame(outcome, "file string, outcome string")


# --- catalog and API ---
@query("SELECT p_partkey, p_size FROM part WHERE p_size < 5 UNION ALL SELECT 9000000001, 3")
def catalog_reload(spark, sf_dir):
    """What one engine wrote, another opened later reads."""
    e = _keyed(spark, sf_dir, "ISAM")
    e.run(parse("INSERT INTO part VALUES (9000000001, 'Brand#9', 3)")[0])
    return _result(Engine(spark, e.catalog.root), "SELECT p_partkey, p_size FROM part WHERE p_size < 5")


@query("SELECT 'scan' AS step, count(*) AS rows_read, 0 AS rows_written FROM part UNION ALL SELECT 'insert', 0, 1 UNION ALL SELECT 'reset', 0, 0")
def io_statistics(spark, sf_dir):
    e, steps = _keyed(spark, sf_dir, "BTREE"), []
    for step, run in (("scan", lambda: e.select("part")), ("insert", lambda: e.run(parse("INSERT INTO part VALUES (9000000001, 'Brand#9', 3)")[0])), ("reset", lambda: None)):
        e.reset_io_stats("part")
        run()
        found = e.io_stats("part")
        steps.append((step, found["rows_read"], found["rows_written"]))
    return spark.createDataFrame(steps, "step string, rows_read bigint, rows_written bigint")


@query("SELECT 1 AS statement, 'select' AS type, count(*) AS n FROM part WHERE p_size = 15 UNION ALL SELECT 2, 'delete', count(*) FROM part WHERE p_size = 15 UNION ALL SELECT 3, 'select', 0")
def execute_statements(spark, sf_dir):
    found = _keyed(spark, sf_dir, "BTREE").execute("SELECT p_partkey FROM part WHERE p_size = 15; DELETE FROM part WHERE p_size = 15; SELECT p_partkey FROM part WHERE p_size = 15")
    return spark.createDataFrame([(i, r["type"], r["rows_count"]) for i, r in enumerate(found["results"], 1)], "statement int, type string, n bigint")


@query("SELECT CAST(c_custkey AS INT) AS id, CAST(c_custkey * 3000000 AS INT) AS big FROM customer WHERE c_custkey * 3000000 < 2147483648")
def csv_skip_overflow(spark, sf_dir):
    """Rows with an INT out of range are left out whole, and counted."""
    e = _engine(spark)
    path = f"{e.catalog.root}/big.csv"
    customers = table(spark, sf_dir, "customer")
    customers.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 3000000).alias("big")).write.csv(path, header=True)
    r = e.run(parse(f"CREATE TABLE big FROM FILE '{path}' USING PRIMARY INDEX SEQ(id)")[0])
    assert r.count + r.extra["rows_skipped"] == customers.count()
    return e.select("big")


QUERIES["p5_found"] = p5.p5_found
ORACLE_SQL["p5_found"] = p5.SQL
