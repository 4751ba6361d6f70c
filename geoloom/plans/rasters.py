"""Queries over rasters: pixel planes made by range, as the tables hold none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster
from .registry import query

SIDE = 128
PLANE_SQL = f"p AS (SELECT CAST(i % {SIDE} AS INT) AS x, CAST(i // {SIDE} AS INT) AS y FROM range({SIDE * SIDE}) r(i)), plane AS (SELECT x, y, CAST(CASE WHEN (x * 7 + y * 3) % 11 = 0 THEN 100 ELSE ((x // 5 + y // 3 + (x * y) % 4) % 12) * 23 END AS INT) AS v FROM p)"
LEGAL_SQL = "(v % 23 = 0 AND v >= 0 AND v < 276)"


def plane(spark, side=SIDE):
    """x, y, v: patches of classes with a sprinkling of values that no class has."""
    i = F.col("id")
    p = spark.range(side * side).select((i % side).cast("int").alias("x"), F.floor(i / side).cast("int").alias("y"))
    x, y = F.col("x"), F.col("y")
    v = F.when((x * 7 + y * 3) % 11 == 0, 100).otherwise(((F.floor(x / 5) + F.floor(y / 3) + (x * y) % 4) % 12) * 23)
    return p.withColumn("v", v.cast("int"))


def snapped(spark):
    return plane(spark).withColumn("v", raster.snap(F.col("v")))


SNAP_SQL = f"{PLANE_SQL}, snapped AS (SELECT x, y, CAST(least(11, (v + 11) // 23) * 23 AS INT) AS v FROM plane)"


@query("mask_legal", f"WITH {PLANE_SQL} SELECT v, count(*) AS n FROM plane WHERE NOT {LEGAL_SQL} GROUP BY v")
def mask_legal(spark, sf_dir):
    """Values that no class has."""
    return plane(spark).where(~raster.legal(F.col("v"))).groupBy("v").agg(F.count("*").alias("n"))


@query("edge_snap", f"WITH {SNAP_SQL} SELECT v, count(*) AS n FROM snapped GROUP BY v")
def edge_snap(spark, sf_dir):
    return snapped(spark).groupBy("v").agg(F.count("*").alias("n"))


@query("class_histogram", f"WITH {SNAP_SQL} SELECT CAST(x // 16 AS BIGINT) AS px, CAST(y // 16 AS BIGINT) AS py, CAST(((y % 16) // 8) * 2 + (x % 16) // 8 AS BIGINT) AS cell, CAST(v // 23 AS INT) AS class, count(*) / 64.0::DOUBLE AS share FROM snapped GROUP BY ALL")
def class_histogram(spark, sf_dir):
    return raster.histogram(snapped(spark), 16, 2)


@query("class_breakdown", f"WITH {PLANE_SQL}, n AS (SELECT v, count(*) AS n FROM plane GROUP BY v) SELECT v, CASE WHEN {LEGAL_SQL} THEN [{', '.join(repr(c) for c in raster.CLASSES)}][v // 23 + 1] END AS class, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM n")
def class_breakdown(spark, sf_dir):
    return raster.breakdown(plane(spark)).withColumn("percent", F.round("percent", 6))


VOTE_SQL = f"""{PLANE_SQL}, b AS (SELECT x // 2 AS qx, y // 2 AS qy, v, (y % 2) * 2 + x % 2 AS o FROM plane), k AS (SELECT qx, qy, v, count(*) AS n, min(o) AS o FROM b WHERE {LEGAL_SQL} GROUP BY ALL),
w AS (SELECT qx, qy, arg_max(v, n * 100 - o) AS v, max(n) AS n, count(*) AS kinds FROM k GROUP BY ALL), m AS (SELECT qx, qy, sum(v) AS s, count(*) AS t FROM b GROUP BY ALL)"""


@query("mask_majority_vote", f"WITH {VOTE_SQL} SELECT CAST(m.qx AS INT) AS x, CAST(m.qy AS INT) AS y, CAST(coalesce(w.v, least(11, (CAST(floor(s / t + 0.5) AS BIGINT) + 11) // 23) * 23) AS INT) AS v FROM m LEFT JOIN w ON w.qx = m.qx AND w.qy = m.qy")
def mask_majority_vote(spark, sf_dir):
    return raster.majority(plane(spark), 2)


@query("mask_ambiguous", f"WITH {VOTE_SQL} SELECT CAST(m.qx AS INT) AS x, CAST(m.qy AS INT) AS y, CAST(CASE WHEN w.v IS NULL OR w.n / w.kinds::DOUBLE <= 0.5 THEN 255 ELSE w.v END AS INT) AS v FROM m LEFT JOIN w ON w.qx = m.qx AND w.qy = m.qy")
def mask_ambiguous(spark, sf_dir):
    return raster.majority(plane(spark), 2, 0.5)


@query("ambiguous_by_class", f"WITH {VOTE_SQL}, f AS (SELECT coalesce(w.v, least(11, (CAST(floor(s / t + 0.5) AS BIGINT) + 11) // 23) * 23) AS v, w.v IS NULL OR w.n / w.kinds::DOUBLE <= 0.5 AS flagged FROM m LEFT JOIN w ON w.qx = m.qx AND w.qy = m.qy) SELECT CAST(v AS INT) AS v, count(*) AS n, round(avg(CASE WHEN flagged THEN 1.0 ELSE 0 END), 9) AS flagged FROM f GROUP BY v")
def ambiguous_by_class(spark, sf_dir):
    """Each class's pixels and the share that the ambiguous mode flags: two rasters of one tile, joined by pixel."""
    p = plane(spark)
    j = raster.majority(p, 2).join(raster.majority(p, 2, 0.5).withColumnRenamed("v", "a"), ["x", "y"])
    return j.groupBy("v").agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == raster.AMBIGUOUS).cast("double")), 9).alias("flagged"))


@query("renderer_agreement", f"""WITH {SNAP_SQL}, o AS (SELECT x, y, CASE WHEN x % 31 = 0 THEN 0 ELSE v END AS v FROM snapped), d AS (SELECT avg(CASE WHEN a.v <> b.v THEN 1.0 ELSE 0 END) AS differ FROM snapped a JOIN o b ON a.x = b.x AND a.y = b.y),
ha AS (SELECT x // 16 AS px, y // 16 AS py, ((y % 16) // 8) * 2 + (x % 16) // 8 AS c, v, count(*) / 64.0 AS s FROM snapped GROUP BY ALL), hb AS (SELECT x // 16 AS px, y // 16 AS py, ((y % 16) // 8) * 2 + (x % 16) // 8 AS c, v, count(*) / 64.0 AS s FROM o GROUP BY ALL)
SELECT round(differ, 9) AS differ, round((SELECT max(abs(coalesce(ha.s, 0) - coalesce(hb.s, 0))) FROM ha FULL JOIN hb ON ha.px = hb.px AND ha.py = hb.py AND ha.c = hb.c AND ha.v = hb.v)::DOUBLE, 9) AS most FROM d""")
def renderer_agreement(spark, sf_dir):
    """Two renderers' outputs: the share of pixels that differ, and the largest difference of a token."""
    a = snapped(spark)
    r = raster.agreement(a, a.withColumn("v", F.when(F.col("x") % 31 == 0, 0).otherwise(F.col("v"))), 16, 2)
    return r.select(F.round("differ", 9).alias("differ"), F.round("most", 9).alias("most"))


@query("road_orientation", f"""WITH {SNAP_SQL}, r AS (SELECT x, y, CASE WHEN v // 23 IN (9, 10) THEN 1.0::DOUBLE ELSE 0 END AS r FROM snapped), g AS (SELECT a.x, a.y, b.r - a.r AS gx, c.r - a.r AS gy FROM r a JOIN r b ON b.x = a.x + 1 AND b.y = a.y JOIN r c ON c.x = a.x AND c.y = a.y + 1),
s AS (SELECT CAST(x // 32 AS BIGINT) AS px, CAST(y // 32 AS BIGINT) AS py, sum(gx * gx) AS xx, sum(gy * gy) AS yy, sum(gx * gy) AS xy FROM g GROUP BY ALL)
SELECT px, py, round(0.5 * atan2(2 * xy, xx - yy), 6) AS angle, round(sqrt(pow(xx - yy, 2) + 4 * xy * xy) / (xx + yy), 6) AS coherence FROM s WHERE xx + yy > 0""")
def road_orientation(spark, sf_dir):
    r = raster.orientation(snapped(spark), 32)
    return r.select("px", "py", F.round("angle", 6).alias("angle"), F.round("coherence", 6).alias("coherence"))
