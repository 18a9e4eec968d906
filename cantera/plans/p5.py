"""Queries of the problem of near points and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantera.operators.points import containing_regions, located, near_pairs, near_points, parse_location
from cantera.session import scratch, table, written

LISTING_RADIUS = 0.000075
STORE_RADIUS = 0.01


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id, ref_id: listings near each listing, stores near it, zones around it."""
    airbnb = table(spark, sf_dir, "airbnb")
    ubicacion = F.col("ubicacion")
    finite = (F.size(ubicacion) >= 2) & (F.abs(F.get(ubicacion, F.lit(0))) < float("inf")) & (F.abs(F.get(ubicacion, F.lit(1))) < float("inf"))
    stores = table(spark, sf_dir, "tiendas").filter(F.coalesce(finite, F.lit(False)))
    stores = located(stores, "id", F.struct(F.get(ubicacion, F.lit(0)).alias("lat"), F.get(ubicacion, F.lit(1)).alias("lon")))
    zones = table(spark, sf_dir, "zonas")
    with scratch() as keep:
        listings, stores = written(located(airbnb, "id", parse_location(F.col("location")))), written(stores)
        parts = [
            ("airbnb", near_pairs(listings, LISTING_RADIUS)),
            ("tienda", near_points(listings, stores, STORE_RADIUS)),
            ("zona", containing_regions(listings, zones, "zona_id", "contorno").withColumnRenamed("region", "id_2")),
        ]
        rows = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("int").alias("id"), F.col("id_2").cast("int").alias("ref_id")) for kind, df in parts]
        return keep(rows[0].unionByName(rows[1]).unionByName(rows[2]))


_N = r"[-+−]?\d+(?:\.\d+)?"
_C = r"[-+−]?\d+(?:[.,]\d+)?"
_U = r"\d+(?:[.,]\d+)?"
_PLAIN = rf"^\s*[(\[]?\s*({_N})\s*(?:,|\s)\s*({_N})\s*[)\]]?\s*$"
_SEMI = rf"^\s*[(\[]?\s*({_C})\s*;\s*({_C})\s*[)\]]?\s*$"
_LETTERS = rf"^\s*[(\[]?\s*({_U})\s*°?\s*([NnSs])\s*[,;]?\s*({_U})\s*°?\s*([EeWwOo])\s*[)\]]?\s*$"


def _sql_number(pattern: str, group: int) -> str:
    return f"try_cast(nullif(translate(regexp_extract(location, '{pattern}', {group}), ',−', '.-'), '') AS DOUBLE)"


SQL = f"""
WITH raw AS (SELECT DISTINCT id, location FROM airbnb WHERE id IS NOT NULL),
parsed AS (SELECT id,
  coalesce({_sql_number(_PLAIN, 1)}, {_sql_number(_SEMI, 1)}, {_sql_number(_LETTERS, 1)} * CASE WHEN upper(regexp_extract(location, '{_LETTERS}', 2)) = 'S' THEN -1 ELSE 1 END) AS lat,
  coalesce({_sql_number(_PLAIN, 2)}, {_sql_number(_SEMI, 2)}, {_sql_number(_LETTERS, 3)} * CASE WHEN upper(regexp_extract(location, '{_LETTERS}', 4)) IN ('W', 'O') THEN -1 ELSE 1 END) AS lon
  FROM raw),
a AS (SELECT * FROM parsed WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
t AS (SELECT id, any_value(ubicacion[1]) AS lat, any_value(ubicacion[2]) AS lon FROM tiendas WHERE len(ubicacion) >= 2 AND isfinite(ubicacion[1]) AND isfinite(ubicacion[2]) GROUP BY id),
z AS (SELECT zona_id, any_value(contorno) AS ring FROM zonas GROUP BY zona_id),
e0 AS (SELECT zona_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM z),
e AS (SELECT zona_id, ring[i][1] AS y1, ring[i][2] AS x1, ring[i % len(ring) + 1][1] AS y2, ring[i % len(ring) + 1][2] AS x2 FROM e0)
SELECT 'airbnb' AS kind, p.id AS id, q.id AS ref_id FROM a p JOIN a q ON q.lat BETWEEN p.lat - 0.0001 AND p.lat + 0.0001 AND p.id < q.id
  WHERE sqrt((p.lat - q.lat) * (p.lat - q.lat) + (p.lon - q.lon) * (p.lon - q.lon)) <= {LISTING_RADIUS}
UNION ALL SELECT 'tienda', a.id, t.id FROM a, t WHERE sqrt((a.lat - t.lat) * (a.lat - t.lat) + (a.lon - t.lon) * (a.lon - t.lon)) <= {STORE_RADIUS}
UNION ALL SELECT 'zona', a.id, e.zona_id FROM a JOIN e ON (e.y1 > a.lat) <> (e.y2 > a.lat) AND a.lon < (e.x2 - e.x1) * (a.lat - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY a.id, e.zona_id HAVING count(*) % 2 = 1
"""
