"""More audits, stamps and classifications; rerank experiments; a running top k over a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, text, vectors
from ..operators import search
from ..operators.order import shared
from ..streaming import streams
from .fixtures import CACHE_SQL, cache, km_sql
from .registry import query, table
from .retrieval import KNN_SQL, knn, near, sides
from .streams import stream


@query("audit_knn_cache", f"""WITH {KNN_SQL}, c AS (SELECT query_id, rank, CASE WHEN query_id % 9 = 0 AND rank = 8 THEN -1 ELSE row_id END AS row_id, CASE WHEN query_id % 11 = 0 AND rank = 1 THEN 'nan'::DOUBLE ELSE sim END AS sim FROM knn), n AS (SELECT count(*) AS n FROM cache)
SELECT query_id, count(*) AS k, count(*) FILTER (WHERE row_id < 0 OR row_id >= n) AS outside, count(*) FILTER (WHERE isnan(sim)) AS not_finite FROM c, n GROUP BY query_id HAVING count(*) <> 8 OR count(*) FILTER (WHERE row_id < 0 OR row_id >= n) > 0 OR count(*) FILTER (WHERE isnan(sim)) > 0""")
def audit_knn_cache(spark, sf_dir):
    """Queries of a neighbour table with too few neighbours, indices out of range, or similarities that aren't finite (planted)."""
    q = F.col("query_id")
    c = knn(spark, sf_dir).select(
        "query_id", F.when((q % 9 == 0) & (F.col("rank") == 8), -1).otherwise(F.col("row_id")).alias("row_id"),
        F.when((q % 11 == 0) & (F.col("rank") == 1), float("nan")).otherwise(F.col("sim")).alias("sim"),
    )
    n = cache(spark, sf_dir).agg(F.count("*").alias("n"))
    bad = c.crossJoin(F.broadcast(n)).groupBy("query_id").agg(
        F.count("*").alias("k"), F.count_if((F.col("row_id") < 0) | (F.col("row_id") >= F.col("n"))).alias("outside"),
        F.count_if(F.isnan("sim") | (F.abs("sim") == float("inf"))).alias("not_finite"),
    )
    return bad.where("k <> 8 or outside > 0 or not_finite > 0")


@query("audit_contamination", f"WITH {CACHE_SQL}, held AS (SELECT DISTINCT seq FROM cache WHERE side = 'query'), r AS (SELECT country, count(*) AS n, count(*) FILTER (WHERE seq IN (SELECT seq FROM held)) AS leaked FROM cache WHERE side = 'bank' GROUP BY country) SELECT country, n, leaked, leaked / n::DOUBLE > 0.005 AS refused FROM r")
def audit_contamination(spark, sf_dir):
    """Bank rows whose sequence is held out, by country; over half a per cent an evaluation must refuse."""
    c = cache(spark, sf_dir).select("row_id", "country", "seq", "side")
    held = c.where("side = 'query'").select("seq").distinct().withColumn("held", F.lit(1))
    r = c.where("side = 'bank'").join(held, "seq", "left").groupBy("country").agg(F.count("*").alias("n"), F.count("held").alias("leaked"))
    return r.withColumn("refused", F.col("leaked") / F.col("n") > 0.005)


@query("audit_stamps", "WITH m AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS have, CASE WHEN event_id % 100 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS INT) END AS want FROM events) SELECT event_id, CASE WHEN have IS NULL THEN 'missing' ELSE 'stale' END AS state FROM m WHERE have IS DISTINCT FROM want OR have IS NULL")
def audit_stamps(spark, sf_dir):
    """Markers whose recorded inputs differ from what is there now: only the keys that both state are compared."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,int>").alias("have"))
    want = F.when(F.col("event_id") % 100 == 0, F.create_map(F.lit("k"), F.lit(-1))).otherwise(F.col("have"))
    e = e.withColumn("want", want)
    differ = F.exists(F.map_keys("want"), lambda k: ~F.col("have")[k].eqNullSafe(F.col("want")[k]))
    missing = F.col("have").isNull() | F.col("have")["k"].isNull()
    return e.where(F.coalesce(differ, F.lit(True)) | missing).select("event_id", F.when(missing, "missing").otherwise("stale").alias("state"))


@query("row_space", "WITH n AS (SELECT (SELECT count(*) FROM documents) AS rel, (SELECT count(*) FROM embeddings) AS ext), f(name, rows) AS (SELECT 'a', rel FROM n UNION ALL SELECT 'b', rel + ext FROM n UNION ALL SELECT 'c', ext FROM n UNION ALL SELECT 'd', rel + 1 FROM n) SELECT name, rows, CASE WHEN rows = rel THEN 'release' WHEN rows = rel + ext THEN 'stack' WHEN rows = ext THEN 'extension' ELSE 'other' END AS space FROM f, n")
def row_space(spark, sf_dir):
    """Which rows a file of so many vectors can hold: the release, the release with its extension, the extension, or neither."""
    rel, ext = (table(spark, sf_dir, t).agg(F.count("*").alias(n)) for t, n in (("documents", "rel"), ("embeddings", "ext")))
    n = rel.crossJoin(F.broadcast(ext))
    files = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("rows")) for k, v in (("a", F.col("rel")), ("b", F.col("rel") + F.col("ext")), ("c", F.col("ext")), ("d", F.col("rel") + 1))))
    f = n.withColumn("f", F.explode(files)).select("rel", "ext", "f.*")
    r = F.col("rows")
    return f.select("name", "rows", F.when(r == F.col("rel"), "release").when(r == F.col("rel") + F.col("ext"), "stack").when(r == F.col("ext"), "extension").otherwise("other").alias("space"))


@query("stale_variants", "WITH v AS (SELECT doc_id, substr(sha256(source || chr(0) || lang), 1, 8) AS variant FROM documents), live AS (SELECT DISTINCT variant FROM v WHERE doc_id >= 100) SELECT variant, count(*) AS n, variant NOT IN (SELECT variant FROM live) AS stale FROM v GROUP BY variant")
def stale_variants(spark, sf_dir):
    """Cache folders by a short hash of the settings that made them, and those that no present setting has."""
    v = table(spark, sf_dir, "documents").select("doc_id", text.digest(F.array("source", "lang"), 8).alias("variant"))
    return v.groupBy("variant").agg(F.count("*").alias("n"), (F.count_if(F.col("doc_id") >= 100) == 0).alias("stale"))


@query("audit_listing", f"""WITH {KNN_SQL}, g AS (SELECT country AS part, count(*) AS rows, min(c.row_id) AS lo, count(*) FILTER (WHERE side = 'bank') AS bank FROM cache c GROUP BY country), b AS (SELECT q.country AS part, count(*) AS neighbours, count(*) FILTER (WHERE q.seq = c.seq) AS same_group FROM knn k JOIN cache q ON q.row_id = k.query_id JOIN cache c ON c.row_id = k.row_id GROUP BY q.country)
SELECT part, rows, bank, coalesce(neighbours, 0) AS neighbours, coalesce(same_group, 0) = 0 AS clean FROM g LEFT JOIN b USING (part)""")
def audit_listing(spark, sf_dir):
    """One line for each part of a neighbour table: rows, bank, neighbours, and whether the group rule holds."""
    c = cache(spark, sf_dir).select("row_id", "country", "seq", "side")
    g = c.groupBy(F.col("country").alias("part")).agg(F.count("*").alias("rows"), F.count_if(F.col("side") == "bank").alias("bank"))
    n = knn(spark, sf_dir).join(c.select(F.col("row_id").alias("query_id"), F.col("country").alias("part"), F.col("seq").alias("qseq")), "query_id").join(c.select("row_id", "seq"), "row_id")
    b = n.groupBy("part").agg(F.count("*").alias("neighbours"), F.count_if(F.col("qseq") == F.col("seq")).alias("same"))
    return g.join(b, "part", "left").select("part", "rows", "bank", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), (F.coalesce("same", F.lit(0)) == 0).alias("clean"))


@query("audit_resume", "WITH s AS (SELECT c_custkey, c_nationkey, c_custkey % 250 = 0 AS changed FROM customer) SELECT c_nationkey, count(*) AS done, count(*) FILTER (WHERE changed) AS refused FROM s GROUP BY c_nationkey HAVING count(*) FILTER (WHERE changed) > 0")
def audit_resume(spark, sf_dir):
    """Parts that can't be resumed, as some of their rows were made with other settings (planted)."""
    made = F.struct("c_mktsegment", F.when(F.col("c_custkey") % 250 == 0, 1).otherwise(0).alias("grid"))
    now = F.struct("c_mktsegment", F.lit(0).alias("grid"))
    s = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("done"), F.count_if(made != now).alias("refused"))
    return s.where("refused > 0")


@query("merge_parts", f"WITH {CACHE_SQL}, p AS (SELECT row_id, label AS part FROM cache UNION ALL SELECT row_id, 10 FROM cache WHERE row_id % 100 = 0), d AS (SELECT row_id, count(*) AS n, min(part) AS first FROM p GROUP BY row_id) SELECT part, count(*) AS rows, count(*) FILTER (WHERE n > 1) AS shared FROM p JOIN d USING (row_id) GROUP BY part")
def merge_parts(spark, sf_dir):
    """Parts of a corpus before they are merged: rows, and ids that another part has too, for which a merge must refuse."""
    c = cache(spark, sf_dir).select("row_id", F.col("label").alias("part"))
    p = c.unionByName(c.where("row_id % 100 = 0").select("row_id", F.lit(10).alias("part")))
    d = p.groupBy("row_id").agg(F.count("*").alias("n"))
    return p.join(d, "row_id").groupBy("part").agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 1).alias("shared"))


@query("longest_prefix", "WITH s(stem) AS (VALUES ('src'), ('src1'), ('src10'), ('src2')), j AS (SELECT d.doc_id, s.stem FROM documents d JOIN s ON starts_with(d.source, s.stem)) SELECT stem, count(*) AS n FROM (SELECT doc_id, arg_max(stem, length(stem)) AS stem FROM j GROUP BY doc_id) GROUP BY stem")
def longest_prefix(spark, sf_dir):
    """Names by the longest known stem that starts them: an equi join on prefixes of each length instead of a product."""
    stems = ("src", "src1", "src10", "src2")
    s = spark.createDataFrame([(x,) for x in stems], "stem string")
    lengths = F.array(*map(F.lit, sorted({len(x) for x in stems})))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(lengths, lambda n: F.substring("source", F.lit(1), n))).alias("stem")).distinct()
    best = d.join(F.broadcast(s), "stem").groupBy("doc_id").agg(F.max_by("stem", F.length("stem")).alias("stem"))
    return best.groupBy("stem").agg(F.count("*").alias("n"))


@query("consensus_rerank", f"""WITH {KNN_SQL}, v AS (SELECT a.query_id, a.row_id, a.sim, count(*) FILTER (WHERE {km_sql("x", "y")} < 3000) - 1 AS votes FROM knn a JOIN knn b ON a.query_id = b.query_id JOIN cache x ON x.row_id = a.row_id JOIN cache y ON y.row_id = b.row_id GROUP BY ALL)
SELECT query_id, row_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, sim DESC, row_id) AS INT) AS rank, votes FROM v""")
def consensus_rerank(spark, sf_dir):
    """Candidates of a query in order of how many of its other candidates lie within 3000 km; k rows a query, so the self-join is k squared a query."""
    n = knn(spark, sf_dir).select("query_id", "row_id", "sim").join(cache(spark, sf_dir).select("row_id", "lat", "lon"), "row_id")
    other = n.select("query_id", F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    v = n.join(other, "query_id").groupBy("query_id", "row_id", "sim").agg((F.count_if(geo.haversine_km("lat", "lon", "blat", "blon") < 3000) - 1).alias("votes"))
    return search.ranked(v, "query_id", F.desc("votes"), F.desc("sim"), F.col("row_id")).select("query_id", "row_id", "rank", "votes")


@query("query_expansion", f"""WITH {KNN_SQL}, t AS (SELECT k.query_id, unnest(c.embedding::DOUBLE[]) * k.sim AS x, unnest(range(64)) AS i FROM knn k JOIN cache c USING (row_id) WHERE k.rank <= 3), q AS (SELECT row_id AS query_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM cache WHERE side = 'query'),
s AS (SELECT query_id, i, sum(x) AS x FROM (SELECT * FROM t UNION ALL SELECT * FROM q) GROUP BY ALL), e AS (SELECT query_id, list(x ORDER BY i) AS v FROM s GROUP BY query_id)
SELECT query_id, row_id, round(sim, 6) AS sim FROM (SELECT e.query_id, b.row_id, list_cosine_similarity(e.v, b.embedding::DOUBLE[]) AS sim, row_number() OVER (PARTITION BY e.query_id ORDER BY list_cosine_similarity(e.v, b.embedding::DOUBLE[]) DESC, b.row_id) AS r FROM e JOIN cache q ON q.row_id = e.query_id JOIN cache b ON b.side = 'bank' AND b.seq <> q.seq) WHERE r = 1""")
def query_expansion(spark, sf_dir):
    """Each query replaced by itself plus its three best neighbours, weighted by similarity, and searched again."""
    q, b = sides(spark, sf_dir)
    top = search.topk(q, b, 3, exclude="seq").join(b.select("row_id", F.col("embedding").alias("v")), "row_id")
    add = top.select("query_id", vectors.scale(F.col("v"), F.col("sim")).alias("v")).unionByName(q.select(F.col("row_id").alias("query_id"), F.col("embedding").alias("v")))
    sums = add.select("query_id", F.posexplode("v").alias("i", "x")).groupBy("query_id", "i").agg(F.sum("x").alias("x"))
    wide = sums.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    new = q.select("row_id", "seq").join(wide.select(F.col("query_id").alias("row_id"), vectors.normalise(F.col("v")).alias("embedding")), "row_id")
    return search.topk(new, b, 1, exclude="seq").select("query_id", "row_id", F.round("sim", 6).alias("sim"))


@query("stream_topk", f"WITH {KNN_SQL}, a AS (SELECT q.row_id AS query_id, b.row_id, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM cache q JOIN cache b ON q.side = 'query' AND b.side = 'bank') SELECT query_id, row_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id) AS r FROM a) WHERE r <= 3")
def stream_topk(spark, sf_dir):
    """The three best rows of each query while the bank arrives as a stream: every batch is searched and merged into what was best before."""
    q, _ = sides(spark, sf_dir)
    place = f"{shared(spark)}/topk-{uuid.uuid4().hex}"

    def merge(batch, number):
        c = batch.select(F.col("vec_id").alias("row_id"), vectors.normalise(vectors.doubles("embedding")).alias("embedding"), F.when(F.substring(F.md5(F.concat(F.lit("17:"), F.col("vec_id").cast("string"))), 1, 1) < "d", "bank").alias("side"))
        found = search.topk(q, c.where("side = 'bank'"), 3).select("query_id", "row_id", "sim")
        best = spark.read.parquet(f"{place}/{number - 1}") if number else None
        streams.merge_topk(best, found, 3).write.mode("overwrite").parquet(f"{place}/{number}")

    run = stream(spark, sf_dir, "embeddings").writeStream.foreachBatch(merge).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    last = max((p["batchId"] for p in run.recentProgress if p["numInputRows"]), default=None)
    if last is None:  # nothing came
        return q.select(F.col("row_id").alias("query_id"), "row_id", F.lit(0.0).alias("sim")).limit(0)
    return spark.read.parquet(f"{place}/{last}").select("query_id", "row_id", F.round("sim", 6).alias("sim"))


@query("error_of_ranks", f"WITH {KNN_SQL} SELECT query_id, round(min(km) FILTER (WHERE rank <= 4), 6) AS km4, round(min(km), 6) AS km8 FROM near GROUP BY query_id")
def error_of_ranks(spark, sf_dir):
    return near(spark, sf_dir).groupBy("query_id").agg(F.round(F.min(F.when(F.col("rank") <= 4, F.col("km"))), 6).alias("km4"), F.round(F.min("km"), 6).alias("km8"))


@query("pick_arm", f"WITH {KNN_SQL}, a AS (SELECT rank AS arm, avg(CASE WHEN km < 4000 THEN 1.0 ELSE 0 END) AS hit, quantile_cont(km, 0.5) AS median FROM near GROUP BY rank), t AS (SELECT *, max(hit) OVER () - hit <= 0.005 AS near FROM a) SELECT arm, round(hit, 9) AS hit, round(median, 5) AS median, CAST(row_number() OVER (ORDER BY near DESC, CASE WHEN near THEN median END, hit DESC, arm) AS INT) AS place FROM t")
def pick_arm(spark, sf_dir):
    """Arms (here one for each rank) by hit rate; those within 0.005 of the best by their median instead. Arms are few and already aggregated."""
    a = near(spark, sf_dir).groupBy(F.col("rank").alias("arm")).agg(F.avg((F.col("km") < 4000).cast("double")).alias("hit"), F.percentile("km", 0.5).alias("median"))
    t = a.withColumn("near", F.max("hit").over(Window.partitionBy()) - F.col("hit") <= 0.005)
    order = Window.orderBy(F.desc("near"), F.when(F.col("near"), F.col("median")), F.desc("hit"), "arm")
    return t.select("arm", F.round("hit", 9).alias("hit"), F.round("median", 5).alias("median"), F.row_number().over(order).alias("place"))
