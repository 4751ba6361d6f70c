"""Queries over tile algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators.order import numbered
from .fixtures import CACHE_SQL, cache, km_sql
from .registry import query


@query("geo_project", f"""WITH {CACHE_SQL}
SELECT row_id, round(px, 9) AS px, round(py, 9) AS py, round(degrees(atan(sinh(pi() * (1 - 2 * py)))), 7) AS lat_back, round(px * 360 - 180, 7) AS lon_back FROM cache""")
def geo_project(spark, sf_dir):
    c = cache(spark, sf_dir)
    return c.select("row_id", F.round("px", 9).alias("px"), F.round("py", 9).alias("py"), F.round(geo.unproject_lat("py"), 7).alias("lat_back"), F.round(geo.unproject_lon("px"), 7).alias("lon_back"))


@query("geo_tile_z16", f"""WITH {CACHE_SQL}
SELECT row_id, x16, y16, x16 / 65536.0::DOUBLE AS x0, y16 / 65536.0::DOUBLE AS y0, round((x16 + 0.5::DOUBLE) / 65536 * 360 - 180, 7) AS centre_lon,
  round(degrees(atan(sinh(pi() * (1 - 2 * ((y16 + 0.5::DOUBLE) / 65536))))), 7) AS centre_lat, round(px * 65536 - floor(px * 65536), 6) AS u, round(py * 65536 - floor(py * 65536), 6) AS v FROM cache""")
def geo_tile_z16(spark, sf_dir):
    return cache(spark, sf_dir).select(
        "row_id", "x16", "y16", geo.corner(16, "x16").alias("x0"), geo.corner(16, "y16").alias("y0"),
        F.round(geo.tile_lon(16, "x16", 0.5), 7).alias("centre_lon"), F.round(geo.tile_lat(16, "y16", 0.5), 7).alias("centre_lat"),
        F.round(geo.fraction(F.col("px"), 16), 6).alias("u"), F.round(geo.fraction(F.col("py"), 16), 6).alias("v"),
    )


@query("geo_path", f"""WITH {CACHE_SQL}
SELECT row_id, ((y16 >> 12) & 15) * 16 + ((x16 >> 12) & 15) AS a0, ((y16 >> 8) & 15) * 16 + ((x16 >> 8) & 15) AS a1,
  ((y16 >> 4) & 15) * 16 + ((x16 >> 4) & 15) AS a2, (y16 & 15) * 16 + (x16 & 15) AS a3 FROM cache""")
def geo_path(spark, sf_dir):
    c = cache(spark, sf_dir).withColumn("path", geo.path("x16", "y16"))
    return c.select("row_id", *(F.col("path")[t].alias(f"a{t}") for t in range(geo.STEPS)))


@query("geo_descend_roundtrip", f"""WITH {CACHE_SQL} SELECT row_id, 16 AS z, x16 AS x, y16 AS y, TRUE AS same FROM cache""")
def geo_descend_roundtrip(spark, sf_dir):
    c = cache(spark, sf_dir).withColumn("t", geo.path_tile(geo.path("x16", "y16")))
    return c.select("row_id", F.col("t.z").cast("int").alias("z"), "t.x", "t.y", ((F.col("t.x") == F.col("x16")) & (F.col("t.y") == F.col("y16"))).alias("same"))


@query("geo_prefix", f"""WITH {CACHE_SQL}
SELECT row_id, CAST(t AS INT) AS step, x16 >> (16 - 4 * t) AS x, y16 >> (16 - 4 * t) AS y,
  round((px * pow(2, 4 * t) - (x16 >> (16 - 4 * t))) * 16, 6) AS cell_x, round((py * pow(2, 4 * t) - (y16 >> (16 - 4 * t))) * 16, 6) AS cell_y FROM cache, range(4) r(t)""")
def geo_prefix(spark, sf_dir):
    t = F.col("step")
    side = F.pow(F.lit(2.0), 4 * t)
    c = cache(spark, sf_dir).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(3))))
    c = c.withColumns({a: F.floor(F.col(f"{a}16") / F.pow(F.lit(2.0), 16 - 4 * t)) for a in "xy"})
    return c.select("row_id", "step", "x", "y", F.round((F.col("px") * side - F.col("x")) * 16, 6).alias("cell_x"), F.round((F.col("py") * side - F.col("y")) * 16, 6).alias("cell_y"))


@query("geo_tile_key", f"""WITH {CACHE_SQL}
SELECT row_id, (CAST(16 AS BIGINT) << 58) | (x16 << 29) | y16 AS key, (CAST(8 AS BIGINT) << 58) | ((x16 >> 8) << 29) | (y16 >> 8) AS key8 FROM (SELECT row_id, x16, y16 FROM cache)""".replace("CAST(16 AS BIGINT) << 58", "4611686018427387904"))
def geo_tile_key(spark, sf_dir):
    return cache(spark, sf_dir).select("row_id", geo.tile_key(16, "x16", "y16").alias("key"), geo.tile_key(8, F.shiftright("x16", 8), F.shiftright("y16", 8)).alias("key8"))


@query("geo_haversine_pairs", f"""WITH {CACHE_SQL}
SELECT a.row_id AS a, b.row_id AS b, round({km_sql("a", "b")}, 6) AS km FROM cache a JOIN cache b ON a.label = b.label AND a.seq = b.seq AND a.row_id < b.row_id""")
def geo_haversine_pairs(spark, sf_dir):
    """Pairs within a sequence; an equi join on it."""
    c = cache(spark, sf_dir).select("row_id", "label", "seq", "lat", "lon")
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.seq") == F.col("b.seq")) & (F.col("a.row_id") < F.col("b.row_id")))
    return j.select(F.col("a.row_id").alias("a"), F.col("b.row_id").alias("b"), F.round(geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 6).alias("km"))


@query("geo_unit_vectors", f"""WITH {CACHE_SQL}, u AS (SELECT row_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM cache)
SELECT row_id, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, round(degrees(asin(z)), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon,
  round(2 * {geo.EARTH_KM} * asin(sqrt(pow(x - 1, 2) + y * y + z * z) / 2), 5) AS km_from_origin FROM u""")
def geo_unit_vectors(spark, sf_dir):
    x, y, z = geo.unit("lat", "lon")
    u = cache(spark, sf_dir).select("row_id", x.alias("x"), y.alias("y"), z.alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    chord = F.sqrt(F.pow(x - 1, 2) + y * y + z * z)
    return u.select("row_id", *(F.round(v, 9).alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))), F.round(geo.unit_lat(x, y, z), 6).alias("lat"), F.round(geo.unit_lon(x, y), 6).alias("lon"), F.round(geo.chord_to_km(chord), 5).alias("km_from_origin"))


@query("cells_z8", f"""WITH {CACHE_SQL}
SELECT (x16 >> 8) * 256 + (y16 >> 8) AS cell_z8, (y16 >> 8) * 256 + (x16 >> 8) AS cell_rows, count(*) AS n FROM cache GROUP BY ALL""")
def cells_z8(spark, sf_dir):
    return cache(spark, sf_dir).groupBy(geo.cell_id("x16", "y16", 8).alias("cell_z8"), geo.cell_id_rows("x16", "y16", 8).alias("cell_rows")).agg(F.count("*").alias("n"))


@query("degree_cells", f"""WITH {CACHE_SQL}
SELECT CAST(floor((lat + 90) / 0.5) * 721 + floor((lon + 180) / 0.5) AS BIGINT) AS cell, count(*) AS n FROM cache GROUP BY ALL""")
def degree_cells(spark, sf_dir):
    return cache(spark, sf_dir).groupBy(geo.degree_cell("lat", "lon", 0.5).cast("long").alias("cell")).agg(F.count("*").alias("n"))


@query("geo_steps", f"""WITH {CACHE_SQL}
SELECT row_id, CAST(t AS INT) AS step, ((y16 >> (12 - 4 * t)) & 15) * 16 + ((x16 >> (12 - 4 * t)) & 15) AS action,
  (y16 >> (16 - 4 * t)) * CAST(pow(2, 4 * t) AS BIGINT) + (x16 >> (16 - 4 * t)) AS parent FROM cache, range(4) r(t)""")
def geo_steps(spark, sf_dir):
    return steps(cache(spark, sf_dir).select("row_id", "x16", "y16")).select("row_id", "step", "action", "parent")


def steps(c):
    """A row for each step of a descent: its action and the y-major parent cell, -1-free."""
    out = []
    for t in range(geo.STEPS):
        out.append(F.struct(F.lit(t).alias("step"), geo.digit("x16", "y16", 12 - 4 * t).alias("action"), geo.cell_id_rows("x16", "y16", 4 * t).alias("parent")))
    c = c.withColumn("s", F.explode(F.array(*out)))
    return c.select(*(n for n in c.columns if n != "s"), "s.step", "s.action", "s.parent")


@query("geo_overzoom", f"""WITH {CACHE_SQL}
SELECT row_id, 14 AS z, x16 >> 2 AS x, y16 >> 2 AS y, 4 AS scale, x16 - (x16 >> 2) * 4 AS offset_x, y16 - (y16 >> 2) * 4 AS offset_y, 65535 - y16 AS tms_y,
  x16 < 30000 AND y16 < 65536 AS valid FROM cache""")
def geo_overzoom(spark, sf_dir):
    c = cache(spark, sf_dir).withColumn("s", geo.overzoom(F.lit(16), "x16", "y16", 14))
    # An address is broken on purpose where x is large, to show what validation refuses.
    y = F.when(F.col("x16") < 30000, F.col("y16")).otherwise(F.col("y16") + 65536)
    return c.select("row_id", F.col("s.z").cast("int").alias("z"), "s.x", "s.y", F.col("s.scale").cast("int").alias("scale"), "s.offset_x", "s.offset_y", geo.tms_y(F.lit(16), "y16").alias("tms_y"), geo.valid_tile(F.lit(16), "x16", y, 16).alias("valid"))


@query("geomem_children", f"""WITH {CACHE_SQL}, t AS (SELECT DISTINCT x16 >> 12 AS x, y16 >> 12 AS y FROM cache)
SELECT y * 16 + x AS parent, CAST(a AS BIGINT) AS action, (y * 16 + a // 16) * 256 + x * 16 + a % 16 AS child FROM t, range(256) r(a)""")
def geomem_children(spark, sf_dir):
    """The 256 memory rows under each region: level z8 cells in row order."""
    t = cache(spark, sf_dir).select(F.shiftright("x16", 12).alias("x"), F.shiftright("y16", 12).alias("y")).distinct()
    t = t.withColumn("action", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))))
    cx, cy = geo.child("x", "y", "action")
    return t.select((F.col("y") * 16 + F.col("x")).alias("parent"), "action", (cy * 256 + cx).alias("child"))


@query("region_id", f"""WITH {CACHE_SQL}
SELECT row_id, CAST(t AS INT) AS step, CASE WHEN t = 0 THEN 256 ELSE CAST(floor((y16 >> (16 - 4 * t)) / pow(2, 4 * t) * 16) * 16 + floor((x16 >> (16 - 4 * t)) / pow(2, 4 * t) * 16) AS BIGINT) END AS region FROM cache, range(4) r(t)""")
def region_id(spark, sf_dir):
    c = cache(spark, sf_dir).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(3))))
    side = F.pow(F.lit(2.0), 4 * F.col("step"))
    corner = [F.floor(F.col(f"{a}16") / F.pow(F.lit(2.0), 16 - 4 * F.col("step"))) / side for a in "xy"]
    return c.select("row_id", "step", geo.region(corner[0], corner[1], "step").cast("long").alias("region"))


@query("targets_5rows", f"""WITH {CACHE_SQL}
SELECT row_id, CAST(t AS TINYINT) AS step, CAST(4 * t AS TINYINT) AS tile_z, CAST(x16 >> (16 - 4 * t) AS INT) AS tile_x, CAST(y16 >> (16 - 4 * t) AS INT) AS tile_y,
  CAST(CASE WHEN t < 4 THEN ((y16 >> (12 - 4 * least(t, 3))) & 15) * 16 + ((x16 >> (12 - 4 * least(t, 3))) & 15) ELSE -1 END AS SMALLINT) AS target_action,
  CASE WHEN t = 4 THEN round(px * 65536 - floor(px * 65536), 5) ELSE -1 END AS u, CASE WHEN t = 4 THEN round(py * 65536 - floor(py * 65536), 5) ELSE -1 END AS v,
  (x16 >> (16 - 4 * t)) / pow(2, 4 * t) AS x0, (y16 >> (16 - 4 * t)) / pow(2, 4 * t) AS y0 FROM cache, range(5) r(t)""")
def targets_5rows(spark, sf_dir):
    return targets(cache(spark, sf_dir).select("row_id", "px", "py", "x16", "y16")).withColumns({"u": F.round("u", 5), "v": F.round("v", 5)})


def targets(c):
    """Five rows for each image: four steps with their action, then the click with its place in the finest tile. -1 marks what a row lacks."""
    rows = []
    for t in range(geo.STEPS + 1):
        z, shift, last = 4 * t, 16 - 4 * t, t == geo.STEPS
        x, y = F.shiftright("x16", shift), F.shiftright("y16", shift)
        rows.append(F.struct(
            F.lit(t).cast("tinyint").alias("step"), F.lit(z).cast("tinyint").alias("tile_z"), x.cast("int").alias("tile_x"), y.cast("int").alias("tile_y"),
            (F.lit(-1) if last else geo.digit("x16", "y16", 12 - z)).cast("smallint").alias("target_action"),
            *((geo.fraction(F.col(p), 16) if last else F.lit(-1.0)).alias(n) for p, n in (("px", "u"), ("py", "v"))),
            (x / float(1 << z)).alias("x0"), (y / float(1 << z)).alias("y0"),
        ))
    return c.select("row_id", F.explode(F.array(*rows)).alias("r")).select("row_id", "r.*")


@query("distinct_tiles", f"""WITH {CACHE_SQL}
SELECT CAST(4 * t AS INT) AS z, count(DISTINCT (x16 >> (16 - 4 * t)) * 65536 + (y16 >> (16 - 4 * t))) AS tiles, CASE WHEN t <= 2 THEN CAST(pow(4, 4 * t) AS BIGINT) END AS exhaustive FROM cache, range(5) r(t) GROUP BY t""")
def distinct_tiles(spark, sf_dir):
    z = F.explode(F.sequence(F.lit(0), F.lit(16), F.lit(4)))
    c = cache(spark, sf_dir).select("x16", "y16", z.alias("z"))
    parent = [F.floor(F.col(f"{a}16") / F.pow(F.lit(2.0), 16 - F.col("z"))) for a in "xy"]
    return c.groupBy("z").agg(F.count_distinct(parent[0] * 65536 + parent[1]).alias("tiles")).withColumn("exhaustive", F.when(F.col("z") <= 8, F.pow(F.lit(4.0), "z").cast("long")))


@query("descent_steps", f"""WITH {CACHE_SQL}
SELECT row_id, CAST(t AS INT) AS step, ((y16 >> (12 - 4 * t)) & 15) AS row, ((x16 >> (12 - 4 * t)) & 15) AS col,
  round(2 * pi() * {geo.EARTH_KM} * cos(radians(lat)) / pow(2, 4 * t + 4), 6) AS cell_km FROM cache, range(4) r(t)""")
def descent_steps(spark, sf_dir):
    """What each step of a descent chose: the row and column among the children and how wide a child is there."""
    s = steps(cache(spark, sf_dir).select("row_id", "lat", "x16", "y16"))
    width = 2 * F.pi() * geo.EARTH_KM * F.cos(F.radians("lat")) / F.pow(F.lit(2.0), 4 * F.col("step") + 4)
    return s.select("row_id", "step", F.floor(F.col("action") / 16).alias("row"), (F.col("action") % 16).alias("col"), F.round(width, 6).alias("cell_km"))


@query("map_cache_needed", f"""WITH {CACHE_SQL}, t AS (SELECT DISTINCT 4 * t AS z, x16 >> (16 - 4 * t) AS x, y16 >> (16 - 4 * t) AS y FROM cache, range(5) r(t)),
a AS (SELECT * FROM t UNION SELECT 4, i % 16, i // 16 FROM range(256) r(i) UNION SELECT 0, 0, 0)
SELECT CAST(z AS INT) AS z, x, y, row_number() OVER (ORDER BY z, x, y) - 1 AS row FROM a""")
def map_cache_needed(spark, sf_dir):
    """Every tile that descents can look at: those of the targets, all of zoom 4, and the root; numbered in order."""
    c = cache(spark, sf_dir).select("x16", "y16", F.explode(F.sequence(F.lit(0), F.lit(16), F.lit(4))).alias("z"))
    used = c.select("z", *(F.floor(F.col(f"{a}16") / F.pow(F.lit(2.0), 16 - F.col("z"))).alias(a) for a in "xy"))
    fixed = spark.range(256).select(F.lit(4).alias("z"), (F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    root = spark.range(1).select(F.lit(0).alias("z"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    needed = used.unionByName(fixed).unionByName(root).distinct()
    return numbered(needed, [F.col("z"), F.col("x"), F.col("y")], "row")
