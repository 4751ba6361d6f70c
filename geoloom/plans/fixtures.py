"""The test tables as the engine's domain: places, sequences and splits for `embeddings`, shots for `events`.

The tables have no coordinates; both engines compute the same ones from the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from .registry import table

#: The same in SQL, as the start of a WITH list. p is the projection of a place.
CACHE_SQL = f"""
cache0 AS (SELECT vec_id AS row_id, embedding, label, -50.0::DOUBLE + 10.0::DOUBLE * label + ((vec_id * 37) % 201 - 100) / 100.0::DOUBLE AS lat,
  -170.0::DOUBLE + 34.0::DOUBLE * label + ((vec_id * 53) % 401 - 200) / 100.0::DOUBLE AS lon, label || '-' || (vec_id % 7) AS seq, label % 5 AS country,
  CASE WHEN substr(md5('17:' || vec_id), 1, 1) < 'd' THEN 'bank' ELSE 'query' END AS side FROM embeddings),
cache1 AS (SELECT *, (lon + 180.0) / 360.0 AS px,
  0.5 - ln((1 + sin(radians(least(greatest(lat, -{geo.MAX_LAT}), {geo.MAX_LAT})))) / (1 - sin(radians(least(greatest(lat, -{geo.MAX_LAT}), {geo.MAX_LAT}))))) / (4 * pi()) AS py FROM cache0),
cache AS (SELECT *, CAST(least(greatest(floor(px * 65536), 0), 65535) AS BIGINT) AS x16, CAST(least(greatest(floor(py * 65536), 0), 65535) AS BIGINT) AS y16 FROM cache1)"""


def km_sql(a: str, b: str) -> str:
    """Great-circle distance between the lat and lon of two aliases, rounded."""
    h = f"pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)"
    return f"(2 * {geo.EARTH_KM} * asin(least(1.0, sqrt({h}))))"


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, embedding, label, lat, lon, seq, country, side, px, py, x16, y16."""
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    out = e.select(
        i.alias("row_id"),
        "embedding",
        "label",
        (F.lit(-50.0) + F.lit(10.0) * F.col("label") + ((i * 37) % 201 - 100) / F.lit(100.0)).alias("lat"),
        (F.lit(-170.0) + F.lit(34.0) * F.col("label") + ((i * 53) % 401 - 200) / F.lit(100.0)).alias("lon"),
        F.concat_ws("-", "label", i % 7).alias("seq"),
        (F.col("label") % 5).alias("country"),
        F.when(F.substring(F.md5(F.concat(F.lit("17:"), i.cast("string"))), 1, 1) < "d", "bank").otherwise("query").alias("side"),
    )
    return out.withColumns({"px": geo.project_x("lon"), "py": geo.project_y("lat"), "x16": geo.tile_x("lon", 16), "y16": geo.tile_y("lat", 16)})
