"""The engine's scalar functions under names in SQL: bodies are SQL, which Catalyst inlines, so nothing runs row by row in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import geo

#: Signature, result and body of each function.
FUNCTIONS = {
    "geo_project_x(lon DOUBLE)": ("DOUBLE", "(lon + 180) / 360"),
    "geo_project_y(lat DOUBLE)": ("DOUBLE", f"0.5 - ln((1 + sin(radians(greatest(-{geo.MAX_LAT}D, least({geo.MAX_LAT}D, lat))))) / (1 - sin(radians(greatest(-{geo.MAX_LAT}D, least({geo.MAX_LAT}D, lat)))))) / (4 * pi())"),
    "geo_tile_x(lon DOUBLE, z INT)": ("BIGINT", "greatest(0L, least(shiftleft(1L, z) - 1, CAST(floor((lon + 180) / 360 * shiftleft(1L, z)) AS BIGINT)))"),
    "geo_tile_y(lat DOUBLE, z INT)": ("BIGINT", "greatest(0L, least(shiftleft(1L, z) - 1, CAST(floor(geo_project_y(lat) * shiftleft(1L, z)) AS BIGINT)))"),
    "geo_tile_key(z INT, x BIGINT, y BIGINT)": ("BIGINT", "shiftleft(CAST(z AS BIGINT), 58) | shiftleft(x, 29) | y"),
    "geo_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": (
        "DOUBLE",
        f"2 * {geo.EARTH_KM}D * asin(least(1D, sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))",
    ),
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_norm(a ARRAY<DOUBLE>)": ("DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [s.partition("(")[0] for s in FUNCTIONS]
