"""Queries over how a policy's scores are put together: gates, dropped neighbours, sinks, probes and fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import prior, probe, search
from .fixtures import CACHE_SQL, cache
from .model import ALPHA_SQL, made_logits, prior_of, query_tiles, weighted
from .registry import query
from .retrieval import KNN_SQL, knn, sides

DRAW_SQL = "CAST('0x' || substr(md5('17:{0}:' || query_id || ':' || row_id), 1, 8) AS BIGINT)"


@query("neighbour_dropout", f"""WITH {KNN_SQL}, d AS (SELECT query_id, row_id, sim, {DRAW_SQL.format('d')} / 4294967296.0 >= 0.7 AS keep, row_number() OVER (PARTITION BY query_id ORDER BY {DRAW_SQL.format('r')}, row_id) AS nth FROM knn),
k AS (SELECT *, keep OR (nth = 1 AND NOT max(keep) OVER (PARTITION BY query_id)) AS kept FROM d), e AS (SELECT *, CASE WHEN kept THEN exp((sim - max(CASE WHEN kept THEN sim END) OVER (PARTITION BY query_id)) / 0.07) ELSE 0 END AS e FROM k)
SELECT query_id, row_id, kept, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS alpha FROM e""")
def neighbour_dropout(spark, sf_dir):
    """Seven in ten neighbours hidden; a query that would lose all keeps one."""
    return prior.dropped(knn(spark, sf_dir), 0.7).select("query_id", "row_id", "kept", F.round("alpha", 6).alias("alpha"))


def gates(spark):
    s = F.col("id")
    return spark.range(4).select(s.cast("int").alias("step"), (0.5 + 0.1 * s).alias("cell"), (0.3 - 0.05 * s).alias("sink"), (0.1 * (s + 1)).alias("neg"))


@query("gated_bias", f"""WITH {ALPHA_SQL}, q AS (SELECT query_id, step, coalesce(max(mass) FILTER (WHERE child >= 0), 0) AS largest, coalesce(sum(mass) FILTER (WHERE child < 0), 0) AS outside FROM pri GROUP BY ALL),
b AS (SELECT p.*, ln(p.mass + 0.01) AS l, 0.2 * q.largest AS cs, -0.1 * q.outside AS ss, ln(CASE WHEN p.step % 2 = 0 THEN p.mass ELSE 0 END + 0.01) AS n FROM pri p JOIN q ON q.query_id = p.query_id AND q.step = p.step)
SELECT query_id, step, child, round(CASE WHEN child >= 0 THEN 0.5 + 0.1 * step ELSE 0.3 - 0.05 * step END * l, 6) AS pos, round(CASE WHEN child >= 0 THEN 0.5 + 0.1 * step + cs ELSE 0.3 - 0.05 * step + ss END * l, 6) AS cond,
  round(CASE WHEN child >= 0 THEN 0.5 + 0.1 * step + cs ELSE 0.3 - 0.05 * step + ss END * l - 0.1 * (step + 1) * n, 6) AS dual FROM b""")
def gated_bias(spark, sf_dir):
    """The prior as a bias with gates for each step, moved by what the prior itself looks like, and with a negative branch (the even steps' masses)."""
    p = prior_of(spark, sf_dir)
    shifts = prior.quality(p, weighted(spark, sf_dir)).select("query_id", "step", (0.2 * F.col("largest")).alias("cell_shift"), (-0.1 * F.col("outside")).alias("sink_shift"))
    keys = ["query_id", "step", "child"]

    def named(name, **how):
        return prior.gated_bias(p, gates(spark), **how).select(*keys, F.round("bias", 6).alias(name))

    return named("pos").join(named("cond", shifts=shifts), keys).join(named("dual", shifts=shifts, negative=p.where("step % 2 = 0")), keys)


@query("policy_logits", f"""WITH {CACHE_SQL}, e AS (SELECT row_id, embedding::DOUBLE[] AS v FROM cache), l AS (SELECT row_id, list_transform(range(1, 8), lambda k: list_dot_product(v[1:8], v[8 * k + 1:8 * k + 8]) / sqrt(8.0)) AS l FROM e)
SELECT row_id, round(l[1], 6) AS l0, round(l[2], 6) AS l1, round(l[3], 6) AS l2, round(l[4] + 0.5 * (ln(exp(l[4]) + exp(l[5]) + exp(l[6]) + exp(l[7])) - l[4]), 6) AS sink FROM l""")
def policy_logits(spark, sf_dir):
    """A query (the first eight numbers of a vector) against three keys, a sink key and three more sink keys that move it."""
    v = vectors.doubles("embedding")
    keys = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.slice(v, 8 * k + 1, F.lit(8)))
    c = cache(spark, sf_dir).select("row_id", prior.policy_logits(F.slice(v, 1, 8), keys, 8).alias("l"))
    return c.select("row_id", *(F.round(F.get("l", F.lit(k)), 6).alias(f"l{k}") for k in range(3)), F.round(prior.merged_sink(F.get("l", F.lit(3)), F.slice("l", 5, 3), 0.5), 6).alias("sink"))


@query("score_compose", f"""WITH {ALPHA_SQL}, p AS (SELECT query_id, step, a AS child, ((query_id * 7919 + step * 4 * 31 + x * 131 + y * 1009 + a * 2654435) % 1009) / 100.0::DOUBLE AS logit FROM tile, range(256) r(a)),
s AS (SELECT p.query_id, p.step, p.child, logit + 0.8 * ln(coalesce(pri.mass, 0) + 0.01) - 0.5 * abs(p.child % 16 - 7.5) / 7.5 AS score FROM p LEFT JOIN pri ON pri.query_id = p.query_id AND pri.step = p.step AND pri.child = p.child)
SELECT query_id, step, CAST(max(child) FILTER (WHERE r = 1) AS BIGINT) AS child, round(max(score), 6) AS score, round(ln(sum(exp(score))), 6) AS whole
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY round(score, 9) DESC, child) AS r FROM s) GROUP BY query_id, step""")
def score_compose(spark, sf_dir):
    """Policy, then the neighbours' prior, then a geographic one: the best child of each tile on the way, its score, and the log of all chances' sum."""
    t = query_tiles(spark, sf_dir)
    logits = made_logits(F.col("query_id"), F.col("step") * 4, F.col("x"), F.col("y"), 0)
    policy = t.select("query_id", "step", F.posexplode(logits).alias("child", "logit")).withColumn("child", F.col("child").cast("long"))
    retrieval = prior.bias(prior_of(spark, sf_dir), 0.8)
    geo_bias = policy.select("query_id", "step", "child", (-0.5 * F.abs(F.col("child") % 16 - 7.5) / 7.5).alias("bias"))
    s = prior.composed(policy, (retrieval, 0.8 * F.log(F.lit(prior.EPS))), (geo_bias, F.lit(0.0)))
    return s.groupBy("query_id", "step").agg(F.max_by(F.col("child"), F.struct(F.round("score", 9), -F.col("child"))).alias("child"), F.round(F.max("score"), 6).alias("score"), F.round(F.log(F.sum(F.exp("score"))), 6).alias("whole"))


@query("token_source", f"WITH {CACHE_SQL}, t AS (SELECT DISTINCT x16 >> 8 AS x, y16 >> 8 AS y FROM cache) SELECT x, y, NOT ((x + y) % 3 > 0 AND x % 5 > 0) AS live, CASE WHEN (x + y) % 3 > 0 AND x % 5 > 0 THEN CAST(x * 1000 + y AS DOUBLE) ELSE CAST(-x AS DOUBLE) END AS value FROM t")
def token_source(spark, sf_dir):
    """Tokens of tiles from the cache where they are there and done, else made on the spot."""
    t = cache(spark, sf_dir).select(F.shiftright("x16", 8).alias("x"), F.shiftright("y16", 8).alias("y")).distinct()
    have = t.where((F.col("x") + F.col("y")) % 3 > 0).select("x", "y", F.array(F.col("x") * 1000.0 + F.col("y")).alias("tokens"), (F.col("x") % 5 > 0).alias("done"))
    out = prior.with_fallback(t, have, ["x", "y"], "tokens", F.array(F.col("x") * -1.0), width=1)
    return out.select("x", "y", "live", F.col("tokens")[0].alias("value"))


@query("top1_change", f"""WITH {CACHE_SQL}, p AS (SELECT q.row_id AS query_id, b.row_id, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS whole, list_dot_product(q.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS half FROM cache q JOIN cache b ON q.side = 'query' AND b.side = 'bank'),
r AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, row_id) AS rw, row_number() OVER (PARTITION BY query_id ORDER BY half DESC, row_id) AS rh FROM p), t AS (SELECT query_id, max(row_id) FILTER (WHERE rw = 1) AS a, max(row_id) FILTER (WHERE rh = 1) AS b FROM r GROUP BY query_id)
SELECT count(*) AS n, round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0 END), 9) AS changed FROM t""")
def top1_change(spark, sf_dir):
    """The share of queries whose best row in the same bank changes when the query is embedded another way (its second half gone)."""
    q, b = sides(spark, sf_dir)
    halved = q.withColumn("embedding", vectors.normalise(F.concat(F.slice("embedding", 1, 32), F.array_repeat(F.lit(0.0), 32))))
    one, other = (search.topk(x, b, 1).select("query_id", F.col("row_id").alias(n)) for x, n in ((q, "a"), (halved, "b")))
    return one.join(other, "query_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") != F.col("b")).cast("double")), 9).alias("changed"))


@query("linear_probe")
def linear_probe(spark, sf_dir):
    """How well a linear model reads the label off a vector: accuracy on the side it was fitted on and on the other."""
    c = cache(spark, sf_dir).select("embedding", "label", (F.col("side") == "bank").alias("train"))
    return probe.linear(c, "embedding", "label", "train")
