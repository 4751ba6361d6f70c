"""Queries over splits, errors, coverage, density and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, vectors
from ..operators import metrics, spatial, splits
from .fixtures import CACHE_SQL, cache, km_sql
from .registry import query, table
from .retrieval import KNN_SQL, near, sides
from .tiles import steps

# --- splits: groups are customers, strata nations ---

SPLIT_SQL = """rows AS (SELECT o_orderkey, o_custkey AS grp, c_nationkey AS stratum FROM orders JOIN customer ON c_custkey = o_custkey),
sizes AS (SELECT grp, count(*) AS n, min(stratum) AS stratum FROM rows GROUP BY grp),
placed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY md5('17:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY stratum) AS share FROM sizes),
assigned AS (SELECT grp, stratum, n, CASE WHEN share < 0.8 THEN 'train' WHEN share < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM placed)"""


def assigned(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return splits.assign(rows.select(F.col("o_custkey").alias("grp"), F.col("c_nationkey").alias("stratum")), "grp", "stratum")


@query("split_groups_quota", f"WITH {SPLIT_SQL} SELECT grp, stratum, n, split FROM assigned")
def split_groups_quota(spark, sf_dir):
    return assigned(spark, sf_dir)


@query("split_disjoint_audit", f"""WITH {SPLIT_SQL}, r AS (SELECT o.*, a.split FROM rows o JOIN assigned a USING (grp))
SELECT split, count(*) AS n, count(DISTINCT grp) AS groups, (SELECT count(*) FROM (SELECT grp FROM r GROUP BY grp HAVING count(DISTINCT split) > 1)) AS spanning FROM r GROUP BY split""")
def split_disjoint_audit(spark, sf_dir):
    a = assigned(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp")).join(a.select("grp", "split"), "grp")
    bad = splits.spans(rows, "grp").agg(F.count("*").alias("spanning"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups")).crossJoin(F.broadcast(bad))


@query("split_overlap", f"""WITH {CACHE_SQL}, k AS (SELECT DISTINCT seq, side FROM cache), c AS (SELECT DISTINCT (x16 >> 8) * 256 + (y16 >> 8) AS cell, side FROM cache)
SELECT 'seq' AS key, a.side AS a, b.side AS b, count(*) AS shared FROM k a JOIN k b USING (seq) WHERE a.side < b.side GROUP BY ALL UNION ALL SELECT 'cell', a.side, b.side, count(*) FROM c a JOIN c b USING (cell) WHERE a.side < b.side GROUP BY ALL""")
def split_overlap(spark, sf_dir):
    """What a row-wise split leaves in common: here whole sequences and cells."""
    c = cache(spark, sf_dir).withColumn("cell", geo.cell_id("x16", "y16", 8))
    return splits.overlap(c, "seq", "side").select(F.lit("seq").alias("key"), "a", "b", "shared").unionByName(splits.overlap(c, "cell", "side").select(F.lit("cell").alias("key"), "a", "b", "shared"))


@query("majority_country", f"WITH {CACHE_SQL}, n AS (SELECT seq, country, count(*) AS n FROM (SELECT vec_id % 11 AS seq, label % 5 AS country FROM embeddings) GROUP BY ALL) SELECT CAST(seq AS BIGINT) AS seq, country FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY n DESC, country) AS r FROM n) WHERE r = 1")
def majority_country(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 11).alias("seq"), (F.col("label") % 5).alias("country"))
    return splits.majority(e, "seq", "country")


@query("country_band", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) BETWEEN 40 AND 65")
def country_band(spark, sf_dir):
    """Thin countries: tallies within a band."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n between 40 and 65").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")


# --- errors: the best neighbour's distance ---

ERR_SQL = f"{KNN_SQL}, err AS (SELECT query_id, km FROM near WHERE rank = 1)"


def errors(spark, sf_dir):
    return near(spark, sf_dir, 1).select("query_id", "km")


@query("report_buckets", f"WITH {ERR_SQL} SELECT count(*) AS n, round(quantile_cont(km, 0.5), 5) AS median, round(avg(km), 5) AS mean, {', '.join(f'round(avg(CASE WHEN km <= {r} THEN 1.0 ELSE 0 END), 9) AS at{r}' for r in metrics.BASELINE_KM)} FROM err")
def report_buckets(spark, sf_dir):
    r = metrics.report(errors(spark, sf_dir))
    return r.select("n", *(F.round(c, 5).alias(c) for c in ("median", "mean")), *(F.round(f"at{k}", 9).alias(f"at{k}") for k in metrics.BASELINE_KM))


@query("geoscore", f"WITH {ERR_SQL} SELECT {', '.join(f'round(avg(CASE WHEN km < {r} THEN 1.0 ELSE 0 END), 9) AS under{r}' for r in metrics.STANDARD_KM)}, round(avg(5000 * exp(-km / {metrics.SCORE_KM})), 5) AS geoscore FROM err")
def geoscore(spark, sf_dir):
    r = metrics.standard(errors(spark, sf_dir))
    return r.select(*(F.round(f"under{k}", 9).alias(f"under{k}") for k in metrics.STANDARD_KM), F.round("geoscore", 5).alias("geoscore"))


@query("error_percentiles", f"WITH {ERR_SQL}, p AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]) AS p) SELECT CAST(p AS DOUBLE) AS p, round((SELECT quantile_cont(km, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]) FROM err)[list_position([0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0], p)], 5) AS km FROM p")
def error_percentiles(spark, sf_dir):
    """Exact percentiles with linear interpolation."""
    p = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    q = errors(spark, sf_dir).agg(F.percentile("km", F.array(*map(F.lit, p))).alias("q"))
    return q.select(F.explode(F.arrays_zip(F.array(*map(F.lit, p)).alias("p"), F.col("q").alias("km"))).alias("s")).select("s.p", F.round("s.km", 5).alias("km"))


@query("trimmed_means", f"WITH {ERR_SQL}, c AS (SELECT quantile_cont(km, 0.5) AS a, quantile_cont(km, 0.9) AS b FROM err) SELECT round(avg(km) FILTER (WHERE km <= a), 5) AS p50, round(avg(km) FILTER (WHERE km <= b), 5) AS p90 FROM err, c")
def trimmed_means(spark, sf_dir):
    return metrics.trimmed_means(errors(spark, sf_dir), [0.5, 0.9]).select(F.round(F.col("means")[0], 5).alias("p50"), F.round(F.col("means")[1], 5).alias("p90"))


@query("tail_mass", f"WITH {ERR_SQL} SELECT CAST(t AS INT) AS over_km, round(avg(CASE WHEN km > t THEN 1.0 ELSE 0 END), 9) AS row_share, round(sum(CASE WHEN km > t THEN km ELSE 0 END) / sum(km), 9) AS error_share FROM err, (VALUES (2500), (8000), (15000)) v(t) GROUP BY t")
def tail_mass(spark, sf_dir):
    e = errors(spark, sf_dir).select("km", F.explode(F.array(*map(F.lit, (2500, 8000, 15000)))).alias("over_km"))
    over = F.col("km") > F.col("over_km")
    return e.groupBy("over_km").agg(F.round(F.avg(over.cast("double")), 9).alias("row_share"), F.round(F.sum(F.when(over, F.col("km")).otherwise(0.0)) / F.sum("km"), 9).alias("error_share"))


WRONG_SQL = f"""{ERR_SQL}, wrong AS (SELECT e.query_id, e.km, CAST(CASE WHEN q.x16 >> 12 <> b.x16 >> 12 OR q.y16 >> 12 <> b.y16 >> 12 THEN 0 WHEN q.x16 >> 8 <> b.x16 >> 8 OR q.y16 >> 8 <> b.y16 >> 8 THEN 1
  WHEN q.x16 >> 4 <> b.x16 >> 4 OR q.y16 >> 4 <> b.y16 >> 4 THEN 2 WHEN q.x16 <> b.x16 OR q.y16 <> b.y16 THEN 3 ELSE 4 END AS INT) AS step FROM err e JOIN knn k ON k.query_id = e.query_id AND k.rank = 1 JOIN cache q ON q.row_id = e.query_id JOIN cache b ON b.row_id = k.row_id)"""


@query("first_wrong_profile", f"WITH {WRONG_SQL}, g AS (SELECT step, count(*) AS n, sum(km) / (SELECT count(*) FROM err) AS part FROM wrong GROUP BY step) SELECT step, n, round(part, 5) AS part_km, round(sum(part) OVER (ORDER BY step) / sum(part) OVER (), 9) AS running FROM g")
def first_wrong_profile(spark, sf_dir):
    """What each first wrong step adds to the mean error, and the running share."""
    c = cache(spark, sf_dir).select("row_id", geo.path("x16", "y16").alias("path"))
    n = near(spark, sf_dir, 1).select("query_id", "row_id", "km")
    j = n.join(c.withColumnsRenamed({"row_id": "query_id", "path": "want"}), "query_id").join(c, "row_id")
    same = F.transform(F.arrays_zip("want", "path"), lambda p: p["want"] == p["path"])
    wrong = F.array_position(same, F.lit(False))
    g = j.select("km", F.when(wrong == 0, geo.STEPS).otherwise(wrong - 1).cast("int").alias("step")).groupBy("step").agg(F.count("*").alias("n"), F.sum("km").alias("s"))
    total = Window.partitionBy()
    part = F.col("s") / F.sum("n").over(total)
    return g.select("step", "n", F.round(part, 5).alias("part_km"), F.round(F.sum("s").over(Window.orderBy("step")) / F.sum("s").over(total), 9).alias("running"))


@query("step_accuracy", f"WITH {KNN_SQL} SELECT CAST(t AS INT) AS step, round(avg(CASE WHEN ((q.y16 >> (12 - 4 * t)) & 15) = ((b.y16 >> (12 - 4 * t)) & 15) AND ((q.x16 >> (12 - 4 * t)) & 15) = ((b.x16 >> (12 - 4 * t)) & 15) THEN 1.0 ELSE 0 END), 9) AS accuracy FROM knn k JOIN cache q ON q.row_id = k.query_id JOIN cache b ON b.row_id = k.row_id, range(4) r(t) WHERE k.rank = 1 GROUP BY t")
def step_accuracy(spark, sf_dir):
    s = steps(cache(spark, sf_dir).select("row_id", "x16", "y16")).select("row_id", "step", "action")
    n = near(spark, sf_dir, 1).select("query_id", "row_id")
    j = n.join(s.withColumnsRenamed({"row_id": "query_id", "action": "want"}), "query_id").join(s, ["row_id", "step"])
    return j.groupBy("step").agg(F.round(F.avg((F.col("want") == F.col("action")).cast("double")), 9).alias("accuracy"))


COVER_SQL = f"""{KNN_SQL}, legal AS (SELECT q.row_id AS query_id, min({km_sql("q", "b")}) AS near_km, arg_min(b.row_id, {km_sql("q", "b")} ) AS row_id FROM cache q JOIN cache b ON q.side = 'query' AND b.side = 'bank' AND q.seq <> b.seq GROUP BY ALL),
cov AS (SELECT l.query_id, l.near_km, min(n.km) AS any_km, min(n.km) FILTER (WHERE n.rank = 1) AS top_km FROM legal l JOIN near n USING (query_id) GROUP BY ALL)"""


def coverage(spark, sf_dir):
    """near, any and top distances of each query: three equi joins."""
    q, b = sides(spark, sf_dir)
    legal = spatial.nearest(q.select("row_id", "lat", "lon", "seq"), b.select("row_id", "lat", "lon", "seq"), "seq", start_km=200.0, grow=10.0).select("query_id", F.col("km").alias("near"))
    n = near(spark, sf_dir).groupBy("query_id").agg(F.min("km").alias("any"), F.min(F.when(F.col("rank") == 1, F.col("km"))).alias("top"))
    return legal.join(n, "query_id")


@query("nearest_legal", f"WITH {COVER_SQL} SELECT query_id, round(near_km, 6) AS km FROM legal")
def nearest_legal(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    cols = ["row_id", "lat", "lon", "seq"]
    return spatial.nearest(q.select(*cols), b.select(*cols), "seq", start_km=100.0).select("query_id", F.round("km", 6).alias("km"))


@query("coverage_partition", f"""WITH {COVER_SQL} SELECT CAST(r AS INT) AS r, CASE WHEN top_km < r THEN 'solved' WHEN any_km < r THEN 'ranking' WHEN near_km < r THEN 'retrieval' ELSE 'coverage' END AS class, count(*) AS n FROM cov, (VALUES (25), (200), (2500)) v(r) GROUP BY ALL""")
def coverage_partition(spark, sf_dir):
    c = coverage(spark, sf_dir).withColumn("r", F.explode(F.array(*map(F.lit, (25, 200, 2500)))))
    return metrics.partition(c, F.col("r")).groupBy("r", "class").agg(F.count("*").alias("n"))


@query("coverage_conditional", f"""WITH {COVER_SQL} SELECT CAST(r AS INT) AS r, round(avg(CASE WHEN near_km < r THEN 1.0 ELSE 0 END), 9) AS covered, round(avg(CASE WHEN any_km < r THEN 1.0 ELSE 0 END) FILTER (WHERE near_km < r), 9) AS found, round(avg(CASE WHEN top_km < r THEN 1.0 ELSE 0 END) FILTER (WHERE near_km < r), 9) AS first,
  count(*) FILTER (WHERE near_km >= r AND any_km < r) AS breaks FROM cov, (VALUES (25), (200), (2500)) v(r) GROUP BY r""")
def coverage_conditional(spark, sf_dir):
    """Shares of covered queries that retrieval finds and ranks first, and the number of queries that break the partition."""
    r = F.col("r")
    c = coverage(spark, sf_dir).withColumn("r", F.explode(F.array(*map(F.lit, (25, 200, 2500)))))
    cov = F.col("near") < r
    return c.groupBy("r").agg(
        F.round(F.avg(cov.cast("double")), 9).alias("covered"), F.round(F.avg(F.when(cov, (F.col("any") < r).cast("double"))), 9).alias("found"),
        F.round(F.avg(F.when(cov, (F.col("top") < r).cast("double"))), 9).alias("first"), F.count_if(~cov & (F.col("any") < r)).alias("breaks"),
    )


@query("ceiling_rk", f"""WITH {KNN_SQL}, m AS (SELECT query_id, k, min(km) AS km FROM near, (VALUES (1), (4), (8)) v(k) WHERE rank <= k GROUP BY ALL) SELECT CAST(r AS INT) AS r, round(avg(CASE WHEN km < r THEN 1.0 ELSE 0 END) FILTER (WHERE k = 1), 9) AS k1, round(avg(CASE WHEN km < r THEN 1.0 ELSE 0 END) FILTER (WHERE k = 4), 9) AS k4, round(avg(CASE WHEN km < r THEN 1.0 ELSE 0 END) FILTER (WHERE k = 8), 9) AS k8 FROM m, (VALUES (25), (200), (2500)) v(r) GROUP BY r""")
def ceiling_rk(spark, sf_dir):
    n = near(spark, sf_dir).groupBy("query_id").agg(*(F.min(F.when(F.col("rank") <= k, F.col("km"))).alias(f"m{k}") for k in (1, 4, 8)))
    n = n.withColumn("r", F.explode(F.array(*map(F.lit, (25, 200, 2500)))))
    return n.groupBy("r").agg(*(F.round(F.avg((F.col(f"m{k}") < F.col("r")).cast("double")), 9).alias(f"k{k}") for k in (1, 4, 8)))


# --- two arms: the first neighbour, and the nearer of the first two ---

ARMS_SQL = f"{KNN_SQL}, arms AS (SELECT query_id AS id, min(km) FILTER (WHERE rank = 1) AS a, min(km) FILTER (WHERE rank <= 3) AS b FROM near GROUP BY ALL)"


def arms(spark, sf_dir):
    n = near(spark, sf_dir)
    return n.groupBy(F.col("query_id").alias("id")).agg(F.min(F.when(F.col("rank") == 1, F.col("km"))).alias("a"), F.min(F.when(F.col("rank") <= 3, F.col("km"))).alias("b"))


@query("flows_win_loss", f"""WITH {ARMS_SQL}, f AS (SELECT *, a < 4000 AS ha, b < 4000 AS hb FROM arms) SELECT count(*) FILTER (WHERE hb AND NOT ha) AS won, count(*) FILTER (WHERE ha AND NOT hb) AS lost, count(*) FILTER (WHERE hb AND NOT ha) - count(*) FILTER (WHERE ha AND NOT hb) AS net,
  round(count(*) FILTER (WHERE hb AND NOT ha) / greatest(count(*) FILTER (WHERE ha AND NOT hb), 1)::DOUBLE, 9) AS ratio, round(quantile_cont(a, 0.5) FILTER (WHERE ha <> hb), 5) AS moved_median, round(quantile_cont(a, 0.9) FILTER (WHERE ha <> hb), 5) AS moved_p90, round(avg(CASE WHEN ha OR hb THEN 1.0 ELSE 0 END), 9) AS either, round(avg(CASE WHEN hb THEN 1.0 ELSE 0 END) FILTER (WHERE NOT ha), 9) AS b_given_not_a FROM f""")
def flows_win_loss(spark, sf_dir):
    f = arms(spark, sf_dir).select("a", (F.col("a") < 4000).alias("ha"), (F.col("b") < 4000).alias("hb"))
    won, lost = F.count_if(F.col("hb") & ~F.col("ha")), F.count_if(F.col("ha") & ~F.col("hb"))
    moved = F.when(F.col("ha") != F.col("hb"), F.col("a"))
    return f.agg(
        won.alias("won"), lost.alias("lost"), (won - lost).alias("net"), F.round(won / F.greatest(lost, F.lit(1)), 9).alias("ratio"),
        F.round(F.percentile(moved, 0.5), 5).alias("moved_median"), F.round(F.percentile(moved, 0.9), 5).alias("moved_p90"),
        F.round(F.avg((F.col("ha") | F.col("hb")).cast("double")), 9).alias("either"), F.round(F.avg(F.when(~F.col("ha"), F.col("hb").cast("double"))), 9).alias("b_given_not_a"),
    )


REPS = 40
BOOT_SQL = f"""{ARMS_SQL}, no AS (SELECT row_number() OVER (ORDER BY id) - 1 AS no, a, b FROM arms), n AS (SELECT count(*) AS n FROM arms),
draws AS (SELECT rep, CAST(('0x' || substr(md5('17:' || rep || ':' || i), 1, 12)) AS BIGINT) % n AS no FROM n, range({REPS}) r(rep), range((SELECT CAST(count(*) AS BIGINT) FROM arms)) d(i)),
reps AS (SELECT rep, quantile_cont(a, 0.5) - quantile_cont(b, 0.5) AS median, avg(a) - avg(b) AS mean, avg(CASE WHEN a < 4000 THEN 1.0 ELSE 0 END) - avg(CASE WHEN b < 4000 THEN 1.0 ELSE 0 END) AS hits FROM draws JOIN no USING (no) GROUP BY rep)"""


@query("bootstrap_paired", f"""WITH {BOOT_SQL}, s AS (SELECT 'median' AS statistic, quantile_cont(median, 0.025) AS lo, quantile_cont(median, 0.975) AS hi FROM reps UNION ALL SELECT 'mean', quantile_cont(mean, 0.025), quantile_cont(mean, 0.975) FROM reps UNION ALL SELECT 'hits', quantile_cont(hits, 0.025), quantile_cont(hits, 0.975) FROM reps)
SELECT statistic, round(lo, 5) AS lo, round(hi, 5) AS hi, lo > 0 OR hi < 0 AS separated FROM s""")
def bootstrap_paired(spark, sf_dir):
    b = metrics.paired_bootstrap(arms(spark, sf_dir), REPS, 17, 4000.0)
    return b.select("statistic", F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), "separated")


@query("align_arms", "WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, n_chars FROM documents WHERE lang <> 'de') SELECT count(*) FILTER (WHERE b.doc_id IS NOT NULL AND a.doc_id IS NOT NULL) AS both, count(*) FILTER (WHERE b.doc_id IS NULL) AS only_a, count(*) FILTER (WHERE a.doc_id IS NULL) AS only_b FROM a FULL JOIN b USING (doc_id)".replace("FROM a FULL JOIN b USING (doc_id)", "FROM a FULL JOIN b ON a.doc_id = b.doc_id"))
def align_arms(spark, sf_dir):
    """Two result sets by id: how many rows both have and how many only one, which a paired comparison must refuse."""
    a = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("a"))
    b = table(spark, sf_dir, "documents").where("lang <> 'de'").select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


# --- density, occupancy, radius ---

BAND_SQL = f"{ARMS_SQL}, cells AS (SELECT CAST(floor((lat + 90) / 1.0) * 361 + floor((lon + 180) / 1.0) AS BIGINT) AS cell, count(*) AS n FROM cache WHERE side = 'bank' GROUP BY ALL), d AS (SELECT x.*, coalesce(c.n, 0) AS n FROM arms x JOIN cache q ON q.row_id = x.id LEFT JOIN cells c ON c.cell = CAST(floor((q.lat + 90) / 1.0) * 361 + floor((q.lon + 180) / 1.0) AS BIGINT)), banded AS (SELECT *, CASE WHEN n >= 8 THEN 8 WHEN n >= 6 THEN 6 WHEN n >= 4 THEN 4 WHEN n >= 2 THEN 2 ELSE 0 END AS band FROM d)"


def banded(spark, sf_dir):
    c = cache(spark, sf_dir)
    cells = spatial.cell_counts(c.where("side = 'bank'"), 1.0)
    q = c.select(F.col("row_id").alias("id"), geo.degree_cell("lat", "lon", 1.0).cast("long").alias("cell"))
    d = arms(spark, sf_dir).join(q, "id").join(cells, "cell", "left")
    return d.withColumn("band", spatial.density_band(F.coalesce("n", F.lit(0)), [0, 2, 4, 6, 8]))


@query("gain_by_density", f"WITH {BAND_SQL} SELECT CAST(band AS INT) AS band, count(*) AS n, round(avg(CASE WHEN a < 4000 THEN 1.0 ELSE 0 END), 9) AS a, round(avg(CASE WHEN b < 4000 THEN 1.0 ELSE 0 END), 9) AS b, round(avg(CASE WHEN b < 4000 THEN 1.0 ELSE 0 END) - avg(CASE WHEN a < 4000 THEN 1.0 ELSE 0 END), 9) AS gain FROM banded GROUP BY band HAVING count(*) >= 5")
def gain_by_density(spark, sf_dir):
    h = {x: F.avg((F.col(x) < 4000).cast("double")) for x in "ab"}
    g = banded(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"), F.round(h["a"], 9).alias("a"), F.round(h["b"], 9).alias("b"), F.round(h["b"] - h["a"], 9).alias("gain"))
    return g.where("n >= 5")


@query("gain_growth", f"WITH {BAND_SQL} SELECT round(avg(CASE WHEN band >= 4 THEN a - b END) - avg(CASE WHEN band < 4 THEN a - b END), 5) AS growth FROM banded")
def gain_growth(spark, sf_dir):
    """A difference of differences: the gain in dense cells less that in thin ones."""
    d = F.col("a") - F.col("b")
    return banded(spark, sf_dir).agg(F.round(F.avg(F.when(F.col("band") >= 4, d)) - F.avg(F.when(F.col("band") < 4, d)), 5).alias("growth"))


@query("count_table", f"""WITH {CACHE_SQL}, s AS (SELECT row_id, side, CAST(t AS INT) AS step, (y16 >> (16 - 4 * t)) * CAST(pow(2, 4 * t) AS BIGINT) + (x16 >> (16 - 4 * t)) AS parent, ((y16 >> (12 - 4 * t)) & 15) * 16 + ((x16 >> (12 - 4 * t)) & 15) AS action FROM cache, range(4) r(t)),
n AS (SELECT step, parent, action, count(*) AS n FROM s WHERE side = 'bank' GROUP BY ALL) SELECT step, parent, action, n FROM (SELECT *, row_number() OVER (PARTITION BY step, parent ORDER BY n DESC, action) AS r FROM n) WHERE r = 1""")
def count_table(spark, sf_dir):
    s = steps(cache(spark, sf_dir).where("side = 'bank'").select("row_id", "x16", "y16"))
    return spatial.top_child(s, ["step", "parent"], "action").select("step", "parent", "action", "n")


@query("occupancy_accuracy", f"""WITH {CACHE_SQL}, s AS (SELECT row_id, side, CAST(t AS INT) AS step, (y16 >> (16 - 4 * t)) * CAST(pow(2, 4 * t) AS BIGINT) + (x16 >> (16 - 4 * t)) AS parent, ((y16 >> (12 - 4 * t)) & 15) * 16 + ((x16 >> (12 - 4 * t)) & 15) AS action FROM cache, range(4) r(t)),
n AS (SELECT step, parent, action, count(*) AS n FROM s WHERE side = 'bank' GROUP BY ALL), best AS (SELECT step, parent, action FROM (SELECT *, row_number() OVER (PARTITION BY step, parent ORDER BY n DESC, action) AS r FROM n) WHERE r = 1)
SELECT s.step, round(avg(CASE WHEN b.action = s.action THEN 1.0 ELSE 0 END), 9) AS accuracy, round(avg(CASE WHEN b.action IS NULL THEN 1.0 ELSE 0 END), 9) AS unseen FROM s LEFT JOIN best b ON b.step = s.step AND b.parent = s.parent WHERE s.side = 'query' GROUP BY s.step""")
def occupancy_accuracy(spark, sf_dir):
    """How well the most populated child predicts; an unseen parent counts as wrong."""
    c = cache(spark, sf_dir).select("row_id", "side", "x16", "y16")
    best = spatial.top_child(steps(c.where("side = 'bank'")), ["step", "parent"], "action").withColumnRenamed("action", "best")
    j = steps(c.where("side = 'query'")).join(best, ["step", "parent"], "left")
    hit = F.coalesce(F.col("best") == F.col("action"), F.lit(False)).cast("double")
    return j.groupBy("step").agg(F.round(F.avg(hit), 9).alias("accuracy"), F.round(F.avg(F.col("best").isNull().cast("double")), 9).alias("unseen"))


@query("radius_pairs", f"WITH {CACHE_SQL} SELECT a.row_id AS a, b.row_id AS b, round({km_sql('a', 'b')}, 6) AS km FROM cache a JOIN cache b ON a.row_id <> b.row_id AND {km_sql('a', 'b')} <= 30")
def radius_pairs(spark, sf_dir):
    c = cache(spark, sf_dir).select("row_id", "lat", "lon")
    return spatial.within(c, c, 30.0).where("a <> b").select("a", "b", F.round("km", 6).alias("km"))


@query("density_groups")
def density_groups(spark, sf_dir):
    return spatial.density_groups(cache(spark, sf_dir).select("row_id", "lat", "lon"), 30.0, 3)


@query("spherical_centroid", f"WITH {CACHE_SQL}, m AS (SELECT label, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM cache GROUP BY label) SELECT label, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM m")
def spherical_centroid(spark, sf_dir):
    m = cache(spark, sf_dir).groupBy("label").agg(*(F.avg(v).alias(n) for n, v in zip("xyz", geo.unit("lat", "lon"), strict=True)))
    return m.select("label", F.round(geo.unit_lat(*map(F.col, "xyz")), 6).alias("lat"), F.round(geo.unit_lon(F.col("x"), F.col("y")), 6).alias("lon"))


@query("biggest_cell_baseline", f"""WITH {CACHE_SQL}, n AS (SELECT (y16 >> 12) * 16 + (x16 >> 12) AS cell, count(*) AS n, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM cache WHERE side = 'bank' GROUP BY ALL),
g AS (SELECT degrees(asin(z / sqrt(x * x + y * y + z * z))) AS lat, degrees(atan2(y, x)) AS lon FROM n ORDER BY n DESC, cell LIMIT 1)
SELECT round(quantile_cont({km_sql("g", "c")}, 0.5), 5) AS median, round(avg({km_sql("g", "c")}), 5) AS mean FROM cache c, g WHERE c.side = 'query'""")
def biggest_cell_baseline(spark, sf_dir):
    """The error of always guessing the centroid of the most populated cell: one row, so it is broadcast."""
    c = cache(spark, sf_dir)
    n = c.where("side = 'bank'").groupBy(geo.cell_id_rows("x16", "y16", 4).alias("cell")).agg(F.count("*").alias("n"), *(F.avg(v).alias(a) for a, v in zip("xyz", geo.unit("lat", "lon"), strict=True)))
    g = n.orderBy(F.desc("n"), "cell").limit(1).select(geo.unit_lat(*map(F.col, "xyz")).alias("glat"), geo.unit_lon(F.col("x"), F.col("y")).alias("glon"))
    km = c.where("side = 'query'").crossJoin(F.broadcast(g)).select(geo.haversine_km("lat", "lon", "glat", "glon").alias("km"))
    r = metrics.report(km)
    return r.select(F.round("median", 5).alias("median"), F.round("mean", 5).alias("mean"))


@query("nearest_train_gap", f"WITH {COVER_SQL} SELECT round(quantile_cont(near_km, 0.1), 5) AS p10, round(quantile_cont(near_km, 0.5), 5) AS p50, round(quantile_cont(near_km, 0.9), 5) AS p90, round(avg(CASE WHEN near_km < 1 THEN 1.0 ELSE 0 END), 9) AS under1 FROM legal")
def nearest_train_gap(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    cols = ["row_id", "lat", "lon", "seq"]
    n = spatial.nearest(q.select(*cols), b.select(*cols), "seq", start_km=100.0).where("km is not null")
    p = n.agg(F.percentile("km", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"), F.avg((F.col("km") < 1).cast("double")).alias("u"))
    return p.select(*(F.round(F.col("p")[i], 5).alias(f"p{n}") for i, n in enumerate((10, 50, 90))), F.round("u", 9).alias("under1"))


@query("confidence_radius", f"""WITH {KNN_SQL}, w AS (SELECT k.query_id, c.lat, c.lon, exp(k.sim * 10 - max(k.sim * 10) OVER (PARTITION BY k.query_id)) AS w FROM knn k JOIN cache c USING (row_id)),
m AS (SELECT query_id, sum(w) AS t, sum(w * cos(radians(lat)) * cos(radians(lon))) AS x, sum(w * cos(radians(lat)) * sin(radians(lon))) AS y, sum(w * sin(radians(lat))) AS z FROM w GROUP BY ALL), c AS (SELECT query_id, t, degrees(asin(z / sqrt(x * x + y * y + z * z))) AS lat, degrees(atan2(y, x)) AS lon FROM m)
SELECT query_id, round(sqrt(sum(w.w / c.t * pow({km_sql("w", "c")}, 2))), 4) AS radius_km FROM w JOIN c USING (query_id) GROUP BY query_id""")
def confidence_radius(spark, sf_dir):
    n = near(spark, sf_dir).join(cache(spark, sf_dir).select("row_id", "lat", "lon"), "row_id").select("query_id", "lat", "lon", (F.col("sim") * 10).alias("score"))
    return metrics.confidence_radius(n).select("query_id", F.round("radius_km", 4).alias("radius_km"))


@query("correlation_counts", f"WITH {CACHE_SQL}, n AS (SELECT (x16 >> 8) * 256 + (y16 >> 8) AS cell, count(*) AS n, avg(sqrt(list_dot_product(embedding[1:8]::DOUBLE[], embedding[1:8]::DOUBLE[]))) AS size FROM cache GROUP BY ALL) SELECT round(corr(ln(n), size), 6) AS r, count(*) AS cells FROM n HAVING count(*) > 20")
def correlation_counts(spark, sf_dir):
    n = cache(spark, sf_dir).select(geo.cell_id("x16", "y16", 8).alias("cell"), vectors.norm(F.slice(vectors.doubles("embedding"), 1, 8)).alias("size"))
    n = n.groupBy("cell").agg(F.count("*").alias("n"), F.avg("size").alias("size"))
    return n.agg(F.round(F.corr(F.log("n"), F.col("size")), 6).alias("r"), F.count("*").alias("cells")).where("cells > 20")


@query("offset_spread", f"WITH {CACHE_SQL}, v AS (SELECT x16 % 4 AS dx, y16 % 4 AS dy, embedding[1]::DOUBLE AS s FROM cache), g AS (SELECT dx, dy, stddev_pop(s) AS sd, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= 2) SELECT round(avg(sd) / (SELECT stddev_pop(s) FROM v), 6) AS ratio, count(*) AS groups FROM g")
def offset_spread(spark, sf_dir):
    """Spread within groups by offset over the whole spread: near 0 if the offset alone decides."""
    v = cache(spark, sf_dir).select((F.col("x16") % 4).alias("dx"), (F.col("y16") % 4).alias("dy"), F.col("embedding")[0].cast("double").alias("s"))
    g = v.groupBy("dx", "dy").agg(F.stddev_pop("s").alias("sd"), F.count("*").alias("n")).where("n >= 2").agg(F.avg("sd").alias("sd"), F.count("*").alias("groups"))
    return g.crossJoin(F.broadcast(v.agg(F.stddev_pop("s").alias("all")))).select(F.round(F.col("sd") / F.col("all"), 6).alias("ratio"), "groups")


@query("halves_by_hash", f"WITH {ARMS_SQL}, h AS (SELECT a.*, ('0x' || substr(md5(c.seq), 1, 6))::BIGINT % 10 < 5 AS pick FROM arms a JOIN cache c ON c.row_id = a.id) SELECT pick, count(*) AS n, round(avg(a), 5) AS a, round(avg(b), 5) AS b FROM h GROUP BY pick")
def halves_by_hash(spark, sf_dir):
    """Whole sequences on one half or the other: choose on one, report on the other."""
    h = arms(spark, sf_dir).join(cache(spark, sf_dir).select(F.col("row_id").alias("id"), "seq"), "id")
    h = h.withColumn("pick", F.conv(F.substring(F.md5("seq"), 1, 6), 16, 10).cast("long") % 10 < 5)
    return h.groupBy("pick").agg(F.count("*").alias("n"), F.round(F.avg("a"), 5).alias("a"), F.round(F.avg("b"), 5).alias("b"))
