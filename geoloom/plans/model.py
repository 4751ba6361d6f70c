"""Queries over vector transforms, the retrieval prior and beam descent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, vectors
from ..operators import metrics, pca, prior
from .fixtures import CACHE_SQL, cache, km_sql
from .registry import query
from .retrieval import KNN_SQL, knn
from .tiles import steps

# --- vectors ---


def listed(v, digits=6):
    """A vector in rows, rounded, so both engines print it alike."""
    return F.transform(v, lambda x: F.round(x, digits))


@query("vec_concat_scale", f"WITH {CACHE_SQL}, v AS (SELECT row_id, list_concat(list_transform(embedding[1:4]::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding[1:4]::DOUBLE[], embedding[1:4]::DOUBLE[])), 1e-6)), list_transform(embedding[5:8]::DOUBLE[], lambda x: 0.5 * x / greatest(sqrt(list_dot_product(embedding[5:8]::DOUBLE[], embedding[5:8]::DOUBLE[])), 1e-6))) AS v FROM cache) SELECT row_id, unnest(range(8)) AS i, round(unnest(v), 6) AS x FROM v")
def vec_concat_scale(spark, sf_dir):
    """Two unit parts on end, the second at half weight."""
    e = vectors.doubles("embedding")
    v = vectors.concat_scaled(vectors.normalise(F.slice(e, 1, 4)), vectors.normalise(F.slice(e, 5, 4)), 0.5)
    return cache(spark, sf_dir).select("row_id", F.posexplode(v).alias("i", "x")).select("row_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


VIEWS = "[embedding[1:16]::DOUBLE[], embedding[17:32]::DOUBLE[], embedding[33:48]::DOUBLE[], embedding[49:64]::DOUBLE[]]"


def views():
    """A vector's quarters as four views of it."""
    e = vectors.doubles("embedding")
    return F.array(*(F.slice(e, 16 * i + 1, 16) for i in range(4)))


@query("vec_level_mean", f"WITH {CACHE_SQL}, t AS (SELECT row_id, unnest({VIEWS}) AS v FROM cache), n AS (SELECT row_id, v, greatest(sqrt(list_dot_product(v, v)), 1e-6) AS n FROM t), u AS (SELECT row_id, unnest(v) / n AS x, unnest(range(16)) AS i FROM n) SELECT row_id, i, round(avg(x), 6) AS x FROM u GROUP BY ALL")
def vec_level_mean(spark, sf_dir):
    """Views normalised first and then averaged."""
    v = vectors.mean(F.transform(views(), lambda view: vectors.normalise(view)))
    return cache(spark, sf_dir).select("row_id", F.posexplode(v).alias("i", "x")).select("row_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("vec_gem", f"WITH {CACHE_SQL}, t AS (SELECT row_id, unnest({VIEWS}) AS v FROM cache), u AS (SELECT row_id, unnest(v) AS x, unnest(range(16)) AS i FROM t), m AS (SELECT row_id, i, avg(sign(x) * pow(abs(x), 3)) AS m FROM u GROUP BY ALL) SELECT row_id, i, round(sign(m) * pow(abs(m), 1 / 3.0::DOUBLE), 6) AS x FROM m")
def vec_gem(spark, sf_dir):
    return cache(spark, sf_dir).select("row_id", F.posexplode(vectors.gem(views(), 3.0)).alias("i", "x")).select("row_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("vec_rope", f"""WITH {CACHE_SQL}, p AS (SELECT row_id, k, embedding[2 * k + 1]::DOUBLE AS a, embedding[2 * k + 2]::DOUBLE AS b, (row_id % 9) * 0.5 * pow(100.0, -k / 7.0::DOUBLE) AS t FROM cache, range(8) r(k))
SELECT row_id, 2 * k AS i, round(a * cos(t) - b * sin(t), 6) AS x FROM p UNION ALL SELECT row_id, 2 * k + 1, round(a * sin(t) + b * cos(t), 6) FROM p""")
def vec_rope(spark, sf_dir):
    """Eight component pairs turned by a place times a falling ladder of rates."""
    angles = vectors.rope_angles((F.col("row_id") % 9).cast("double"), 8, 0.5, 100.0)
    v = vectors.rotate(F.slice(vectors.doubles("embedding"), 1, 16), angles)
    return cache(spark, sf_dir).select("row_id", F.posexplode(v).alias("i", "x")).select("row_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("vec_blend", f"WITH {CACHE_SQL}, n AS (SELECT row_id, sqrt(0.3 * list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]) + 0.7 * list_dot_product(embedding[33:64]::DOUBLE[], embedding[33:64]::DOUBLE[])) AS n FROM cache) SELECT row_id, round(n, 6) AS norm, n = 0 AS zero FROM n")
def vec_blend(spark, sf_dir):
    """Weighted parts on end, by the square roots of their weights, so cosines are weighted sums; the length, and whether the row is all zero."""
    e = vectors.doubles("embedding")
    v = F.concat(vectors.scale(F.slice(e, 1, 32), 0.3**0.5), vectors.scale(F.slice(e, 33, 32), 0.7**0.5))
    return cache(spark, sf_dir).select("row_id", F.round(vectors.norm(v), 6).alias("norm"), vectors.is_zero(v).alias("zero"))


@query("pca_project")
def pca_project(spark, sf_dir):
    """The first four principal components. The axes' signs are fixed, but they come from an eigensolver, so SQL has no counterpart."""
    c = cache(spark, sf_dir).select("row_id", "embedding")
    mean, axes = pca.fit(c, 4)
    return pca.project(c, mean, axes).select("row_id", listed(F.col("projected")).alias("projected"))


@query("pca_variance", f"WITH {CACHE_SQL}, t AS (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM cache) SELECT round(sum(v), 6) AS total FROM (SELECT var_pop(x) AS v FROM t GROUP BY i)")
def pca_variance(spark, sf_dir):
    """The variance over all components, which a full projection must keep: an exact check of the fit."""
    c = cache(spark, sf_dir).select("row_id", "embedding")
    mean, axes = pca.fit(c, 64)
    p = pca.project(c, mean, axes).select(F.posexplode("projected").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v"))
    return p.agg(F.round(F.sum("v"), 6).alias("total"))


@query("soft_targets", f"""WITH {CACHE_SQL}, c AS (SELECT row_id, (px * 16 - floor(px * 16)) * 16 AS cx, (py * 16 - floor(py * 16)) * 16 AS cy FROM cache),
d AS (SELECT row_id, a, exp(-(pow(cx - (a % 16 + 0.5), 2) + pow(cy - (a // 16 + 0.5), 2)) / 0.25) AS e FROM c, range(256) r(a)), s AS (SELECT row_id, a, e / sum(e) OVER (PARTITION BY row_id) AS p FROM d)
SELECT row_id, CAST(a AS INT) AS action, round(p, 6) AS p FROM s WHERE p > 0.05""")
def soft_targets(spark, sf_dir):
    """Distance-weighted targets over the children of a region; shares over 5 %."""
    c = cache(spark, sf_dir).select("row_id", *((geo.fraction(F.col(p), 4) * 16).alias(n) for p, n in (("px", "cx"), ("py", "cy"))))
    t = c.select("row_id", F.posexplode(vectors.soft_targets(F.col("cx"), F.col("cy"), 16, 0.25)).alias("action", "p"))
    return t.where("p > 0.05").select("row_id", "action", F.round("p", 6).alias("p"))


@query("sinusoid_features", f"WITH {CACHE_SQL} SELECT row_id, CAST(k AS INT) AS band, round(sin(pow(2, k) * pi() * px), 6) AS s, round(cos(pow(2, k) * pi() * px), 6) AS c FROM cache, range(4) r(k)")
def sinusoid_features(spark, sf_dir):
    c = cache(spark, sf_dir).select("row_id", vectors.sinusoids(F.col("px"), 4).alias("v"))
    band = F.explode(F.sequence(F.lit(0), F.lit(3)))
    return c.withColumn("band", band).select("row_id", "band", F.round(F.get("v", 2 * F.col("band")), 6).alias("s"), F.round(F.get("v", 2 * F.col("band") + 1), 6).alias("c"))


@query("simplex_grid", "SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(10 - a - b AS INT) AS c FROM range(11) x(a), range(11) y(b) WHERE a + b <= 10")
def simplex_grid(spark, sf_dir):
    """All ways to share ten tenths among three: nested sequences instead of a filtered product."""
    a = spark.range(11).select(F.col("id").cast("int").alias("a"))
    return a.withColumn("b", F.explode(F.sequence(F.lit(0), 10 - F.col("a")))).withColumn("c", 10 - F.col("a") - F.col("b"))


@query("pairing_grid", f"""WITH {KNN_SQL}, w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS w), parts AS (SELECT k.query_id, k.row_id, n.km, list_dot_product(q.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]) AS s0, list_dot_product(q.embedding[33:64]::DOUBLE[], b.embedding[33:64]::DOUBLE[]) AS s1
  FROM knn k JOIN near n ON n.query_id = k.query_id AND n.row_id = k.row_id JOIN cache q ON q.row_id = k.query_id JOIN cache b ON b.row_id = k.row_id),
best AS (SELECT w, km FROM (SELECT w.w, p.km, row_number() OVER (PARTITION BY w.w, p.query_id ORDER BY w.w * p.s0 + (1 - w.w) * p.s1 DESC, p.row_id) AS r FROM parts p, w) WHERE r = 1)
SELECT CAST(w AS DOUBLE) AS w, count(*) AS n, round(quantile_cont(km, 0.5), 5) AS median FROM best GROUP BY w""")
def pairing_grid(spark, sf_dir):
    """Every weighting of two halves scored on the same queries."""
    from .retrieval import near

    e = cache(spark, sf_dir).select("row_id", vectors.doubles("embedding").alias("v"))
    j = near(spark, sf_dir).join(e.select(F.col("row_id").alias("query_id"), F.col("v").alias("qv")), "query_id").join(e, "row_id")
    half = [vectors.dot(F.slice("qv", 32 * i + 1, 32), F.slice("v", 32 * i + 1, 32)) for i in (0, 1)]
    s = j.select("query_id", "row_id", "km", half[0].alias("s0"), half[1].alias("s1")).withColumn("w", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))))
    best = s.groupBy("w", "query_id").agg(F.min(F.struct((-(F.col("w") * F.col("s0") + (1 - F.col("w")) * F.col("s1"))).alias("s"), "row_id", "km")).alias("m"))
    return best.groupBy("w").agg(F.count("*").alias("n"), F.round(F.percentile("m.km", 0.5), 5).alias("median"))


# --- prior ---

ALPHA_SQL = f"""{KNN_SQL}, e AS (SELECT k.query_id, k.row_id, k.sim, exp((k.sim - max(k.sim) OVER (PARTITION BY k.query_id)) / 0.07) AS e, c.x16, c.y16 FROM knn k JOIN cache c USING (row_id)),
alpha AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS alpha FROM e),
tile AS (SELECT row_id AS query_id, CAST(t AS INT) AS step, CAST(least(4 * t, 12) AS INT) AS z, x16 >> (16 - 4 * t) AS x, y16 >> (16 - 4 * t) AS y FROM cache, range(4) r(t) WHERE side = 'query'),
pri AS (SELECT t.query_id, t.step, CASE WHEN a.x16 >> (16 - t.z) = t.x AND a.y16 >> (16 - t.z) = t.y THEN ((a.y16 >> (12 - t.z)) & 15) * 16 + ((a.x16 >> (12 - t.z)) & 15) ELSE -1 END AS child, sum(a.alpha) AS mass FROM tile t JOIN alpha a USING (query_id) GROUP BY ALL)"""


def weighted(spark, sf_dir):
    return prior.weights(knn(spark, sf_dir)).join(cache(spark, sf_dir).select("row_id", "x16", "y16"), "row_id")


def query_tiles(spark, sf_dir):
    c = cache(spark, sf_dir).where("side = 'query'")
    s = F.explode(F.array(*(F.struct(F.lit(t).alias("step"), F.shiftright("x16", 16 - 4 * t).alias("x"), F.shiftright("y16", 16 - 4 * t).alias("y")) for t in range(4))))
    return c.select(F.col("row_id").alias("query_id"), s.alias("s")).select("query_id", "s.*")


def prior_of(spark, sf_dir):
    return prior.child_prior(weighted(spark, sf_dir), query_tiles(spark, sf_dir))


@query("neighbour_weights", f"WITH {ALPHA_SQL} SELECT query_id, row_id, round(alpha, 6) AS alpha FROM alpha")
def neighbour_weights(spark, sf_dir):
    return prior.weights(knn(spark, sf_dir)).select("query_id", "row_id", F.round("alpha", 6).alias("alpha"))


@query("child_prior", f"WITH {ALPHA_SQL} SELECT query_id, step, child, round(mass, 6) AS mass FROM pri")
def child_prior(spark, sf_dir):
    return prior_of(spark, sf_dir).select("query_id", "step", "child", F.round("mass", 6).alias("mass"))


@query("prior_quality", f"""WITH {ALPHA_SQL}, i AS (SELECT *, coalesce(sum(mass) FILTER (WHERE child >= 0) OVER (PARTITION BY query_id, step), 0) AS inside FROM pri),
q AS (SELECT query_id, step, coalesce(max(mass) FILTER (WHERE child >= 0), 0) AS largest, min(inside) AS inside, coalesce(sum(mass) FILTER (WHERE child < 0), 0) AS outside, coalesce(-sum(mass / greatest(inside, 1e-9) * ln(greatest(mass / greatest(inside, 1e-9), 1e-9))) FILTER (WHERE child >= 0), 0) AS ce FROM i GROUP BY ALL),
a AS (SELECT query_id, -sum(alpha * ln(greatest(alpha, 1e-9))) AS we, max(sim) AS top FROM alpha GROUP BY ALL)
SELECT query_id, step, round(largest, 6) AS largest, round(inside, 6) AS inside, round(outside, 6) AS outside, abs(round(ce, 6)) AS cell_entropy, round(we, 6) AS weight_entropy, round(top, 6) AS top FROM q JOIN a USING (query_id)""")
def prior_quality(spark, sf_dir):
    q = prior.quality(prior_of(spark, sf_dir), weighted(spark, sf_dir))
    return q.select("query_id", "step", *(F.round(c, 6).alias(c) for c in ("largest", "inside", "outside")), F.abs(F.round("cell_entropy", 6)).alias("cell_entropy"), *(F.round(c, 6).alias(c) for c in ("weight_entropy", "top")))


@query("prior_bias", f"WITH {ALPHA_SQL}, n AS (SELECT query_id, step, child, mass FROM pri WHERE step % 2 = 0) SELECT p.query_id, p.step, p.child, round(0.8 * ln(p.mass + 0.01) - 0.2 * ln(coalesce(n.mass, 0) + 0.01), 6) AS bias FROM pri p LEFT JOIN n ON n.query_id = p.query_id AND n.step = p.step AND n.child = p.child")
def prior_bias(spark, sf_dir):
    """The prior as a bias on logits, with a negative branch (here the even steps' own masses)."""
    p = prior_of(spark, sf_dir)
    negative = p.where("step % 2 = 0").select("query_id", "step", F.col("child").alias("child"), F.col("mass").alias("mass"))
    return prior.bias(p, 0.8, negative, 0.2).withColumn("bias", F.round("bias", 6))


@query("prior_rank", f"""WITH {ALPHA_SQL}, truth AS (SELECT row_id AS query_id, CAST(t AS INT) AS step, ((y16 >> (12 - 4 * t)) & 15) * 16 + ((x16 >> (12 - 4 * t)) & 15) AS action FROM cache, range(4) r(t) WHERE side = 'query'),
r AS (SELECT query_id, step, child, row_number() OVER (PARTITION BY query_id, step ORDER BY mass DESC, child) AS rank FROM pri WHERE child >= 0)
SELECT t.step, round(avg(CASE WHEN r.rank <= 1 THEN 1.0 ELSE 0 END), 9) AS at1, round(avg(CASE WHEN r.rank <= 4 THEN 1.0 ELSE 0 END), 9) AS at4 FROM truth t LEFT JOIN r ON r.query_id = t.query_id AND r.step = t.step AND r.child = t.action GROUP BY t.step""")
def prior_rank(spark, sf_dir):
    """Recall of the true child among the prior's first k, step by step; a child without mass has no rank."""
    truth = steps(cache(spark, sf_dir).where("side = 'query'").select("row_id", "x16", "y16")).select(F.col("row_id").alias("query_id"), "step", F.col("action").alias("child"))
    p = prior_of(spark, sf_dir).where("child >= 0")
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "step").orderBy(F.desc("mass"), "child")))
    j = truth.join(p, ["query_id", "step", "child"], "left")
    return j.groupBy("step").agg(*(F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), 9).alias(f"at{k}") for k in (1, 4)))


@query("gate_statistics", f"WITH {ALPHA_SQL}, g AS (SELECT step, 1 / (1 + exp(-(mass * 4 - 1))) AS g FROM pri WHERE child >= 0) SELECT step, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS spread, round(exp(max(g)) / exp(min(g)), 6) AS ratio FROM g GROUP BY step")
def gate_statistics(spark, sf_dir):
    g = prior_of(spark, sf_dir).where("child >= 0").select("step", (1 / (1 + F.exp(-(F.col("mass") * 4 - 1)))).alias("g"))
    return g.groupBy("step").agg(F.round(F.avg("g"), 6).alias("mean"), F.round(F.stddev_pop("g"), 6).alias("spread"), F.round(F.exp(F.max("g")) / F.exp(F.min("g")), 6).alias("ratio"))


@query("sink_merge", f"WITH {CACHE_SQL}, s AS (SELECT row_id, embedding[1]::DOUBLE * 4 AS b, embedding[2]::DOUBLE * 4 AS x, embedding[3]::DOUBLE * 4 AS y FROM cache) SELECT row_id, round(b + 0.5 * (ln(exp(b) + exp(x) + exp(y)) - b), 6) AS sink FROM s")
def sink_merge(spark, sf_dir):
    e = vectors.scale(vectors.doubles("embedding"), 4.0)
    return cache(spark, sf_dir).select("row_id", F.round(prior.merged_sink(F.get(e, F.lit(0)), F.slice(e, 2, 2), 0.5), 6).alias("sink"))


# --- beam: logits are a fixed function of the tile, as no learned model is here ---


def made_logits(query_id, z, x, y, step):
    base = query_id * 7919 + z * 31 + x * 131 + y * 1009
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda a: (base + a * 2654435) % 1009 / 100.0)


BEAM_SQL = f"""{CACHE_SQL}, q AS (SELECT row_id AS query_id FROM cache WHERE side = 'query'),
l0 AS (SELECT query_id, a, ((query_id * 7919 + a * 2654435) % 1009) / 100.0::DOUBLE AS s FROM q, range(256) r(a)),
p0 AS (SELECT query_id, a, s - ln(sum(exp(s)) OVER (PARTITION BY query_id)) AS lp FROM l0),
b0 AS (SELECT query_id, a, lp, row_number() OVER (PARTITION BY query_id ORDER BY lp DESC, a) - 1 AS beam FROM p0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lp DESC, a) <= 4),
l1 AS (SELECT b.query_id, b.beam, b.a AS a0, b.lp AS lp0, c.a, ((b.query_id * 7919 + 4 * 31 + (b.a % 16) * 131 + (b.a // 16) * 1009 + c.a * 2654435) % 1009) / 100.0::DOUBLE AS s FROM b0 b, range(256) c(a)),
p1 AS (SELECT *, s - ln(sum(exp(s)) OVER (PARTITION BY query_id, beam)) AS lp FROM l1),
m1 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY query_id, beam ORDER BY lp DESC, a) <= 4),
b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lp0 + lp DESC, beam, a) - 1 AS place FROM m1)"""


@query("beam_two_step", f"WITH {BEAM_SQL} SELECT query_id, CAST(place AS INT) AS beam, round(lp0 + lp, 6) AS score, a0, a AS a1, (a0 % 16) * 16 + a % 16 AS x, (a0 // 16) * 16 + a // 16 AS y FROM b1 WHERE place < 4")
def beam_two_step(spark, sf_dir):
    q = cache(spark, sf_dir).where("side = 'query'").select(F.col("row_id").alias("query_id"))
    b = prior.beam_search(q, made_logits, beams=4, top_m=4, steps=2)
    return b.select("query_id", "beam", F.round("score", 6).alias("score"), F.col("path")[0].alias("a0"), F.col("path")[1].alias("a1"), "x", "y")


@query("beam_descent")
def beam_descent(spark, sf_dir):
    """Four steps with a sink, pruning and scores from the first two steps only, then a place in the finest tile, the best beam and its confidence radius."""
    q = cache(spark, sf_dir).where("side = 'query'").select(F.col("row_id").alias("query_id"))

    def with_sink(query_id, z, x, y, step):
        return F.concat(made_logits(query_id, z, x, y, step), F.array((query_id + x + y) % 13 / 1.0))

    b = prior.beam_search(q, with_sink, beams=4, top_m=4, sink=True, prune=0.6, score_steps=2)
    b = prior.click(b, F.col("x") % 7 / 7.0 - 0.5, F.col("y") % 5 / 5.0 - 0.5)
    best = b.where("beam = 0").select("query_id", "path", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    return best.join(metrics.confidence_radius(b.select("query_id", "lat", "lon", "score")), "query_id").withColumn("radius_km", F.round("radius_km", 4))


@query("negative_siblings", f"""WITH {CACHE_SQL}, d AS (SELECT row_id, draw, CAST(1 + CAST('0x' || substr(md5('17:t:' || row_id || ':' || draw), 1, 8) AS BIGINT) % 2 AS INT) AS step, CAST('0x' || substr(md5('17:a:' || row_id || ':' || draw), 1, 8) AS BIGINT) % 255 AS a FROM cache, range(3) r(draw)),
t AS (SELECT d.*, ((c.y16 >> (12 - 4 * (d.step - 1))) & 15) * 16 + ((c.x16 >> (12 - 4 * (d.step - 1))) & 15) AS truth FROM d JOIN cache c USING (row_id))
SELECT row_id, CAST(draw AS INT) AS draw, step, CASE WHEN a >= truth THEN a + 1 ELSE a END AS action FROM t""")
def negative_siblings(spark, sf_dir):
    return prior.siblings(steps(cache(spark, sf_dir).select("row_id", "x16", "y16")).select("row_id", "step", "action"), 3)


@query("contrastive_pairs", f"WITH {CACHE_SQL} SELECT (a.y16 >> 12) * 16 + (a.x16 >> 12) AS bucket, count(*) AS pairs FROM cache a JOIN cache b ON a.row_id <> b.row_id AND a.seq <> b.seq AND {km_sql('a', 'b')} <= 60 GROUP BY ALL HAVING count(*) >= 2")
def contrastive_pairs(spark, sf_dir):
    """Near pairs of different sequences, counted by the region of the first: the buckets that contrastive batches are drawn from."""
    from ..operators import spatial

    c = cache(spark, sf_dir).select("row_id", "lat", "lon", "seq", geo.cell_id_rows("x16", "y16", 4).alias("bucket"))
    p = spatial.within(c, c, 60.0).where("a <> b")
    p = p.join(c.select(F.col("row_id").alias("a"), F.col("seq").alias("sa"), "bucket"), "a").join(c.select(F.col("row_id").alias("b"), F.col("seq").alias("sb")), "b")
    return p.where("sa <> sb").groupBy("bucket").agg(F.count("*").alias("pairs")).where("pairs >= 2")
