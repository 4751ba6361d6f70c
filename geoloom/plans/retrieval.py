"""Queries over similarity search: neighbours, shortlists, merges, oracles, locations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, vectors
from ..operators import search
from ..operators.order import numbered
from .fixtures import CACHE_SQL, cache, km_sql
from .registry import query

K = 8
#: Ranked neighbours in SQL: the smoke split's queries against its bank, never within a sequence.
KNN_SQL = f"""{CACHE_SQL},
pairs AS (SELECT q.row_id AS query_id, b.row_id AS row_id, list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS sim
  FROM cache q JOIN cache b ON q.side = 'query' AND b.side = 'bank' AND q.seq <> b.seq),
knn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id) AS INT) AS rank FROM pairs) WHERE rank <= {K}),
near AS (SELECT n.query_id, n.rank, n.row_id, n.sim, {km_sql("q", "b")} AS km FROM knn n JOIN cache q ON q.row_id = n.query_id JOIN cache b ON b.row_id = n.row_id)"""


def sides(spark, sf_dir):
    """Queries and bank of the smoke split, with unit vectors."""
    c = cache(spark, sf_dir).withColumn("embedding", vectors.normalise(vectors.doubles("embedding")))
    return c.where("side = 'query'"), c.where("side = 'bank'")


def knn(spark, sf_dir, k=K):
    q, b = sides(spark, sf_dir)
    return search.topk(q, b, k, exclude="seq")


def near(spark, sf_dir, k=K):
    """Neighbours with their distance from the query's place: two equi joins on row ids."""
    places = cache(spark, sf_dir)
    q = places.select(F.col("row_id").alias("query_id"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    n = knn(spark, sf_dir, k).join(q, "query_id").join(places.select("row_id", "lat", "lon"), "row_id")
    return n.select("query_id", "rank", "row_id", "sim", geo.haversine_km("qlat", "qlon", "lat", "lon").alias("km"))


@query("knn_topk_excl", f"WITH {KNN_SQL} SELECT query_id, rank, row_id, round(sim, 6) AS sim, round(km, 6) AS km FROM near")
def knn_topk_excl(spark, sf_dir):
    return near(spark, sf_dir).select("query_id", "rank", "row_id", F.round("sim", 6).alias("sim"), F.round("km", 6).alias("km"))


@query("knn_top1", f"WITH {KNN_SQL} SELECT query_id, row_id, round(sim, 6) AS sim FROM knn WHERE rank = 1")
def knn_top1(spark, sf_dir):
    return knn(spark, sf_dir, 1).select("query_id", "row_id", F.round("sim", 6).alias("sim"))


@query("knn_exhaustive", f"""WITH {CACHE_SQL}, q AS (SELECT * FROM cache WHERE row_id = 7), p AS (SELECT b.row_id, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM cache b, q)
SELECT row_id, round(sim, 6) AS sim FROM p ORDER BY sim DESC, row_id LIMIT 20""")
def knn_exhaustive(spark, sf_dir):
    """One query against every row, its own included; a top-n report, so the limit is the feature."""
    c = cache(spark, sf_dir).withColumn("embedding", vectors.normalise(vectors.doubles("embedding")))
    return search.topk(c.where("row_id = 7"), c, 20).select("row_id", F.round("sim", 6).alias("sim"))


DIM, PROBE = 32, 40
SHORT_SQL = f"""{KNN_SQL},
cut AS (SELECT row_id, side, seq, embedding::DOUBLE[] AS e, list_slice(embedding::DOUBLE[], 1, {DIM}) AS t FROM cache),
probed AS (SELECT * FROM (SELECT q.row_id AS query_id, b.row_id, q.e AS qe, b.e AS be, row_number() OVER (PARTITION BY q.row_id ORDER BY list_cosine_similarity(q.t, b.t) DESC, b.row_id) AS r
  FROM cut q JOIN cut b ON q.side = 'query' AND b.side = 'bank' AND q.seq <> b.seq) WHERE r <= {PROBE}),
short AS (SELECT * FROM (SELECT query_id, row_id, list_cosine_similarity(qe, be) AS sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qe, be) DESC, row_id) AS INT) AS rank FROM probed) WHERE rank <= {K})"""


@query("knn_shortlist", f"WITH {SHORT_SQL} SELECT query_id, rank, row_id, round(sim, 6) AS sim FROM short")
def knn_shortlist(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return search.shortlist(q, b, K, DIM, PROBE, exclude="seq").select("query_id", "rank", "row_id", F.round("sim", 6).alias("sim"))


@query("shortlist_recall", f"""WITH {SHORT_SQL} SELECT round(avg(CASE WHEN s.rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS recall,
  round(avg(CASE WHEN k.rank = 1 THEN CASE WHEN s.rank = 1 THEN 1.0 ELSE 0.0 END END), 9) AS top1 FROM knn k LEFT JOIN short s ON s.query_id = k.query_id AND s.row_id = k.row_id""")
def shortlist_recall(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    r = search.recall(search.shortlist(q, b, K, DIM, PROBE, exclude="seq"), search.topk(q, b, K, exclude="seq"), K)
    return r.select(F.round("recall", 9).alias("recall"), F.round("top1", 9).alias("top1"))


@query("knn_short_rows", f"WITH {CACHE_SQL}, n AS (SELECT q.row_id AS query_id, count(b.row_id) AS n FROM cache q LEFT JOIN cache b ON b.side = 'bank' AND b.seq <> q.seq AND b.label = 3 WHERE q.side = 'query' GROUP BY ALL) SELECT query_id, least(n, 48) AS n FROM n WHERE n < 48")
def knn_short_rows(spark, sf_dir):
    """Queries that a small bank leaves with fewer than 48 legal neighbours."""
    q, b = sides(spark, sf_dir)
    return search.short_of(search.topk(q, b.where("label = 3"), 48, exclude="seq"), q, 48)


TOKENS_SQL = f"""{KNN_SQL},
tok AS (SELECT row_id, t AS token, list_slice(embedding::DOUBLE[], t * 16 + 1, t * 16 + 16) AS v FROM cache, range(4) r(t)),
best AS (SELECT k.query_id, k.row_id, q.token, max(list_dot_product(q.v, b.v)) AS s FROM knn k JOIN tok q ON q.row_id = k.query_id JOIN tok b ON b.row_id = k.row_id GROUP BY ALL)"""


@query("set_chamfer", f"WITH {TOKENS_SQL} SELECT query_id, row_id, round(avg(s), 6) AS chamfer, round(max(s), 6) AS best FROM best GROUP BY ALL")
def set_chamfer(spark, sf_dir):
    """Set similarity of the candidates a search has found: a vector's quarters are its tokens."""
    found = knn(spark, sf_dir).select("query_id", "row_id")
    tokens = cache(spark, sf_dir).select("row_id", F.posexplode(F.array(*(F.slice(vectors.doubles("embedding"), 16 * t + 1, 16) for t in range(4)))).alias("token", "v"))
    q = tokens.select(F.col("row_id").alias("query_id"), "token", F.col("v").alias("qv"))
    b = tokens.select("row_id", F.col("v").alias("bv"))
    best = found.join(q, "query_id").join(b, "row_id").groupBy("query_id", "row_id", "token").agg(F.max(vectors.dot(F.col("qv"), F.col("bv"))).alias("s"))
    return best.groupBy("query_id", "row_id").agg(F.round(F.avg("s"), 6).alias("chamfer"), F.round(F.max("s"), 6).alias("best"))


@query("rerank_blend", f"""WITH {KNN_SQL}, parts AS (SELECT k.query_id, k.row_id, list_dot_product(list_slice(q.embedding::DOUBLE[], 1, 32), list_slice(b.embedding::DOUBLE[], 1, 32)) AS s0, list_dot_product(list_slice(q.embedding::DOUBLE[], 33, 64), list_slice(b.embedding::DOUBLE[], 33, 64)) AS s1
  FROM knn k JOIN cache q ON q.row_id = k.query_id JOIN cache b ON b.row_id = k.row_id)
SELECT query_id, row_id, round(0.25 * s0 + 0.75 * s1, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY 0.25 * s0 + 0.75 * s1 DESC, row_id) AS INT) AS rank FROM parts""")
def rerank_blend(spark, sf_dir):
    """The found neighbours again, by a weighted blend of two halves' similarities."""
    e = cache(spark, sf_dir).select("row_id", vectors.doubles("embedding").alias("v"))
    j = knn(spark, sf_dir).select("query_id", "row_id").join(e.select(F.col("row_id").alias("query_id"), F.col("v").alias("qv")), "query_id").join(e, "row_id")
    half = [vectors.dot(F.slice("qv", 32 * i + 1, 32), F.slice("v", 32 * i + 1, 32)) for i in (0, 1)]
    scored = j.select("query_id", "row_id", (0.25 * half[0] + 0.75 * half[1]).alias("score"))
    return search.ranked(scored, "query_id", F.desc("score"), F.col("row_id")).withColumn("score", F.round("score", 6))


@query("knn_location_softmax", f"""WITH {KNN_SQL}, w AS (SELECT query_id, row_id, exp(20 * (sim - max(sim) OVER (PARTITION BY query_id))) AS w FROM knn),
m AS (SELECT query_id, sum(w * cos(radians(lat)) * cos(radians(lon))) / sum(w) AS x, sum(w * cos(radians(lat)) * sin(radians(lon))) / sum(w) AS y, sum(w * sin(radians(lat))) / sum(w) AS z FROM w JOIN cache USING (row_id) GROUP BY query_id)
SELECT query_id, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 5) AS lat, round(degrees(atan2(y, x)), 5) AS lon FROM m""")
def knn_location_softmax(spark, sf_dir):
    """A place for each query: the mean of its neighbours' unit vectors under softmax weights."""
    n = knn(spark, sf_dir).withColumn("w", F.exp(20 * (F.col("sim") - F.max("sim").over(Window.partitionBy("query_id")))))
    n = n.join(cache(spark, sf_dir).select("row_id", "lat", "lon"), "row_id")
    m = n.groupBy("query_id").agg(*((F.sum(F.col("w") * v) / F.sum("w")).alias(a) for a, v in zip("xyz", geo.unit("lat", "lon"), strict=True)))
    return m.select("query_id", F.round(geo.unit_lat(*map(F.col, "xyz")), 5).alias("lat"), F.round(geo.unit_lon(F.col("x"), F.col("y")), 5).alias("lon"))


@query("compare_spaces", f"""WITH {SHORT_SQL}, t AS (SELECT * FROM (SELECT q.row_id AS query_id, b.row_id, row_number() OVER (PARTITION BY q.row_id ORDER BY list_cosine_similarity(q.t, b.t) DESC, b.row_id) AS r FROM cut q JOIN cut b ON q.side = 'query' AND b.side = 'bank' AND q.seq <> b.seq) WHERE r = 1)
SELECT k.query_id, k.row_id AS whole, t.row_id AS short, k.row_id = t.row_id AS same, round({km_sql("a", "b")}, 6) AS km FROM knn k JOIN t USING (query_id) JOIN cache a ON a.row_id = k.row_id JOIN cache b ON b.row_id = t.row_id WHERE k.rank = 1""")
def compare_spaces(spark, sf_dir):
    """The best row by whole vectors and by their first components, and how far apart those places are."""
    q, b = sides(spark, sf_dir)
    cut = [d.withColumn("embedding", vectors.normalise(vectors.truncate(F.col("embedding"), DIM))) for d in (q, b)]
    j = search.topk(q, b, 1, exclude="seq").select("query_id", F.col("row_id").alias("whole")).join(search.topk(*cut, 1, exclude="seq").select("query_id", F.col("row_id").alias("short")), "query_id")
    p = cache(spark, sf_dir)
    for n in ("whole", "short"):
        j = j.join(p.select(F.col("row_id").alias(n), F.col("lat").alias(f"{n}_lat"), F.col("lon").alias(f"{n}_lon")), n)
    return j.select("query_id", "whole", "short", (F.col("whole") == F.col("short")).alias("same"), F.round(geo.haversine_km("whole_lat", "whole_lon", "short_lat", "short_lon"), 6).alias("km"))


GROUP_SQL = f"""{KNN_SQL}, photo AS (SELECT row_id AS query_id, label AS grp, CAST(row_number() OVER (PARTITION BY label ORDER BY row_id) AS INT) AS place FROM cache WHERE side = 'query'),
cand AS (SELECT p.grp, p.place, k.rank, k.row_id, k.sim - max(k.sim) OVER (PARTITION BY k.query_id) AS score FROM knn k JOIN photo p USING (query_id))"""


def photos(spark, sf_dir):
    """The queries of a label as photographs of one place."""
    q = cache(spark, sf_dir).where("side = 'query'")
    return q.select(F.col("row_id").alias("query_id"), F.col("label").alias("group"), F.row_number().over(Window.partitionBy("label").orderBy("row_id")).alias("place"))


@query("merge_round_robin", f"""WITH {GROUP_SQL}, one AS (SELECT grp, row_id, min(rank * 100000 + place) AS o, arg_min(score, rank * 100000 + place) AS score FROM cand GROUP BY ALL),
s AS (SELECT * FROM (SELECT grp, row_id, score, CAST(row_number() OVER (PARTITION BY grp ORDER BY o, row_id) AS INT) AS slot FROM one) WHERE slot <= 16)
SELECT grp AS "group", slot, row_id, round(score, 6) AS score FROM s""")
def merge_round_robin(spark, sf_dir):
    return search.merge_round_robin(knn(spark, sf_dir), photos(spark, sf_dir), 16).withColumn("score", F.round("score", 6))


@query("merge_global", f"""WITH {GROUP_SQL}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, row_id, place) AS INT) AS slot FROM cand)
SELECT grp AS "group", slot, row_id, round(score, 6) AS score FROM s WHERE slot <= 16""")
def merge_global(spark, sf_dir):
    return search.merge_global(knn(spark, sf_dir), photos(spark, sf_dir), 16).withColumn("score", F.round("score", 6))


@query("round_robin_members", f"""WITH {CACHE_SQL}, a AS (SELECT label, min(row_id) AS anchor FROM cache GROUP BY label), o AS (SELECT c.label, c.row_id, c.seq, x.seq = c.seq AS own, min(c.row_id) OVER (PARTITION BY c.label, c.seq) AS seen,
  row_number() OVER (PARTITION BY c.label, c.seq ORDER BY c.row_id) AS r, a.anchor FROM cache c JOIN a USING (label) JOIN cache x ON x.row_id = a.anchor WHERE c.row_id <> a.anchor)
SELECT label, row_id, CAST(row_number() OVER (PARTITION BY label ORDER BY r, own, seen) AS INT) AS place FROM o""")
def round_robin_members(spark, sf_dir):
    """A group's photographs in turn over its sequences, the anchor's own sequence last; sequences in order of their first photograph."""
    c = cache(spark, sf_dir).select("label", "row_id", "seq")
    a = c.groupBy("label").agg(F.min(F.struct("row_id", "seq")).alias("a")).select("label", F.col("a.row_id").alias("anchor"), F.col("a.seq").alias("own"))
    rest = c.join(a, "label").where("row_id <> anchor")
    one = Window.partitionBy("label", "seq")
    rest = rest.withColumns({"turn": F.row_number().over(one.orderBy("row_id")), "seen": F.min("row_id").over(one), "mine": F.col("seq") == F.col("own")})
    return rest.select("label", "row_id", F.row_number().over(Window.partitionBy("label").orderBy("turn", "mine", "seen")).alias("place"))


@query("oracle_any_of_k", f"WITH {KNN_SQL} SELECT k, round(avg(CASE WHEN m < 1 THEN 1.0 ELSE 0 END), 9) AS at1, round(avg(CASE WHEN m < 25 THEN 1.0 ELSE 0 END), 9) AS at25, round(avg(CASE WHEN m < 2500 THEN 1.0 ELSE 0 END), 9) AS at2500 FROM (SELECT query_id, k, min(km) AS m FROM near, (VALUES (1), (2), (4), (8)) v(k) WHERE rank <= k GROUP BY ALL) GROUP BY k")
def oracle_any_of_k(spark, sf_dir):
    """Share of queries with any of the first k neighbours within r km: one pass over the ranks, no join."""
    n = near(spark, sf_dir).groupBy("query_id").agg(*(F.min(F.when(F.col("rank") <= k, F.col("km"))).alias(f"m{k}") for k in (1, 2, 4, 8)))
    long = n.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("m")) for k in (1, 2, 4, 8)))).alias("s")).select("s.*")
    return long.groupBy("k").agg(*(F.round(F.avg((F.col("m") < r).cast("double")), 9).alias(f"at{r}") for r in (1, 25, 2500)))


@query("oracle_at_k_expected", f"""WITH {KNN_SQL}, h AS (SELECT query_id, count(*) AS m, sum(CASE WHEN km < 4000 THEN 1 ELSE 0 END) AS h FROM near GROUP BY ALL)
SELECT k, round(avg(1 - CASE WHEN m - h < k THEN 0.0 ELSE (SELECT product((m - h - i) / (m - i)::DOUBLE) FROM range(k) r(i)) END), 9) AS expected FROM h, (VALUES (1), (2), (4)) v(k) GROUP BY k""")
def oracle_at_k_expected(spark, sf_dir):
    """The expected share of random k-subsets of the neighbours with a hit: 1 - C(m - h, k) / C(m, k), without drawing any."""
    h = near(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("m"), F.count_if(F.col("km") < 4000).alias("h"))
    m, hits = F.col("m"), F.col("h")
    out = []
    for k in (1, 2, 4):
        miss = F.lit(1.0)
        for i in range(k):
            miss = miss * (m - hits - i) / (m - i)
        out.append(F.struct(F.lit(k).alias("k"), (1 - F.when(m - hits < k, 0.0).otherwise(miss)).alias("e")))
    return h.select(F.explode(F.array(*out)).alias("s")).groupBy("s.k").agg(F.round(F.avg("s.e"), 9).alias("expected"))


@query("gate_pick", f"""WITH {KNN_SQL}, g AS (SELECT query_id, max(sim) FILTER (WHERE rank = 1) AS s1, max(sim) FILTER (WHERE rank = 4) AS s4, max(km) FILTER (WHERE rank = 1) AS km1 FROM near GROUP BY ALL)
SELECT query_id, round(s1 - s4, 6) AS margin, round((row_number() OVER (ORDER BY s1, query_id) - 1) / (count(*) OVER ())::DOUBLE, 9) AS pct, s1 - s4 > 0.02 AS trusted, round(km1, 6) AS km FROM g""")
def gate_pick(spark, sf_dir):
    """The margin over the fourth neighbour, and a query's percentile by its best similarity."""
    n = near(spark, sf_dir).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("s1"), F.max(F.when(F.col("rank") == 4, F.col("sim"))).alias("s4"), F.max(F.when(F.col("rank") == 1, F.col("km"))).alias("km"))
    total = n.agg(F.count("*").alias("total"))
    n = numbered(n, [F.col("s1"), F.col("query_id")], "place").crossJoin(F.broadcast(total))
    pct = F.col("place") / F.col("total").cast("double")
    return n.select("query_id", F.round(F.col("s1") - F.col("s4"), 6).alias("margin"), F.round(pct, 9).alias("pct"), (F.col("s1") - F.col("s4") > 0.02).alias("trusted"), F.round("km", 6).alias("km"))


@query("block_similarity", f"""WITH {CACHE_SQL}, p AS (SELECT a.label AS a, b.label AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM cache a JOIN cache b ON a.row_id % 7 = 0 AND b.row_id % 7 = 0 AND a.row_id < b.row_id)
SELECT a, b, count(*) AS n, round(avg(s), 6) AS mean, round(max(s), 6) AS most FROM p GROUP BY ALL""".replace("a.row_id % 7 = 0 AND b.row_id % 7 = 0 AND ", ""))
def block_similarity(spark, sf_dir):
    """Similarity between all rows of two labels, summed up; pairs stay in numpy."""
    c = cache(spark, sf_dir).select("row_id", "label", vectors.normalise(vectors.doubles("embedding")).alias("v"))
    return _blocks(c)


#: Rows of a block, two of which one task scores.
BLOCK = 2048


def _blocks(c):
    """Every pair of rows is scored, by pairs of blocks of bounded size whatever the labels; sums and maxima for pairs of labels leave a task."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n_blocks = max(1, -(-c.count() // BLOCK))
    placed = c.withColumn("own", F.pmod(F.xxhash64("row_id"), F.lit(n_blocks)))
    others = F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))
    a = placed.withColumn("other", F.explode(F.filter(others, lambda o: o >= F.col("own")))).select(F.col("own").alias("i"), F.col("other").alias("j"), "row_id", "label", "v")
    # Under names of their own: both sides of a cogroup must not share a column.
    b = placed.withColumn("other", F.explode(F.filter(others, lambda o: o <= F.col("own")))).select(F.col("other").alias("i"), F.col("own").alias("j"), F.col("row_id").alias("row_b"), F.col("label").alias("label_b"), F.col("v").alias("w"))
    kind = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("most", pa.float64())])

    def score(key, x, y):
        if not x.num_rows or not y.num_rows:
            return pa.Table.from_pylist([], schema=kind)
        mx, my = (pc.list_flatten(t.column(n).combine_chunks()).to_numpy().reshape(t.num_rows, -1) for t, n in ((x, "v"), (y, "w")))
        (ix, lx), (iy, ly) = ((t.column(i).to_numpy(), t.column(l).to_numpy()) for t, i, l in ((x, "row_id", "label"), (y, "row_b", "label_b")))
        s = mx @ my.T
        same = key[0].as_py() == key[1].as_py()
        rows = []
        for p in np.unique(lx).tolist():
            for q in np.unique(ly).tolist():
                r, k = np.flatnonzero(lx == p), np.flatnonzero(ly == q)
                part, first = s[np.ix_(r, k)], ix[r][:, None] < iy[k][None, :]
                # A block with itself has each pair both ways.
                for u, v, mask in ((p, q, first),) if same else ((p, q, first), (q, p, ~first)):
                    if mask.any():
                        rows.append({"a": u, "b": v, "n": int(mask.sum()), "total": float(part[mask].sum()), "most": float(part[mask].max())})
        return pa.Table.from_pylist(rows, schema=kind)

    out = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(score, "a int, b int, n long, total double, most double")
    out = out.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))
    return out.select("a", "b", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.round("most", 6).alias("most"))


@query("leak_rates", f"""WITH {KNN_SQL}, all_pairs AS (SELECT q.row_id AS query_id, b.row_id, q.seq = b.seq AS same, CAST(row_number() OVER (PARTITION BY q.row_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.row_id) AS INT) AS rank FROM cache q JOIN cache b ON q.side = 'query' AND b.side = 'bank'),
t AS (SELECT * FROM all_pairs WHERE rank <= {K}), q AS (SELECT query_id, avg(CASE WHEN same THEN 1.0 ELSE 0 END) AS slots, max(CASE WHEN same THEN 1.0 ELSE 0 END) AS any_, max(CASE WHEN same AND rank = 1 THEN 1.0 ELSE 0 END) AS first, min(CASE WHEN NOT same THEN rank END) AS kept FROM t GROUP BY ALL)
SELECT round(avg(slots), 9) AS slot_share, round(avg(any_), 9) AS any_share, round(avg(first), 9) AS top1_share, round(avg(kept), 9) AS first_kept, count(*) FILTER (WHERE kept IS NULL) AS none_left FROM q""")
def leak_rates(spark, sf_dir):
    """How often a search without the exclusion returns the query's own sequence, and the first rank that survives it."""
    q, b = sides(spark, sf_dir)
    n = search.topk(q, b, K).join(q.select(F.col("row_id").alias("query_id"), F.col("seq").alias("qseq")), "query_id").join(b.select("row_id", "seq"), "row_id")
    same = F.col("qseq").eqNullSafe(F.col("seq"))
    per = n.groupBy("query_id").agg(F.avg(same.cast("double")).alias("slots"), F.max(same.cast("double")).alias("any"), F.max((same & (F.col("rank") == 1)).cast("double")).alias("first"), F.min(F.when(~same, F.col("rank"))).alias("kept"))
    return per.agg(F.round(F.avg("slots"), 9).alias("slot_share"), F.round(F.avg("any"), 9).alias("any_share"), F.round(F.avg("first"), 9).alias("top1_share"), F.round(F.avg("kept"), 9).alias("first_kept"), F.count_if(F.col("kept").isNull()).alias("none_left"))


@query("bank_ext_union", f"""WITH {CACHE_SQL}, held AS (SELECT DISTINCT (x16 >> 8) * 256 + (y16 >> 8) AS cell FROM cache WHERE side = 'query'), n AS (SELECT count(*) AS n FROM cache),
ext AS (SELECT row_id + (SELECT n FROM n) AS row_id, (x16 >> 8) * 256 + (y16 >> 8) AS cell FROM cache WHERE label >= 5)
SELECT row_id, 'release' AS origin FROM cache WHERE side = 'bank' UNION ALL SELECT row_id, 'extension' FROM ext WHERE cell NOT IN (SELECT cell FROM held)""")
def bank_ext_union(spark, sf_dir):
    """Which rows may be retrieved: the release's bank side, then extension rows outside every held-out cell, numbered behind the release."""
    c = cache(spark, sf_dir).withColumn("cell", geo.cell_id("x16", "y16", 8))
    n = c.agg(F.count("*").alias("n"))
    ext = c.where("label >= 5").crossJoin(F.broadcast(n)).select((F.col("row_id") + F.col("n")).alias("row_id"), "cell")
    ext = ext.join(c.where("side = 'query'").select("cell").distinct(), "cell", "left_anti")
    return c.where("side = 'bank'").select("row_id", F.lit("release").alias("origin")).unionByName(ext.select("row_id", F.lit("extension").alias("origin")))


@query("embedding_agreement", f"""WITH {SHORT_SQL}, t AS (SELECT row_id, e, list_concat(t, list_transform(range(32), lambda i: 0.0::DOUBLE)) AS padded FROM cut)
SELECT round(min(list_cosine_similarity(e, padded)), 6) AS least, round(avg(list_cosine_similarity(e, padded)), 6) AS mean FROM t""")
def embedding_agreement(spark, sf_dir):
    """Cosines between two versions of each vector: whole, and with its second half gone."""
    c = cache(spark, sf_dir).select(vectors.doubles("embedding").alias("v"))
    cosine = vectors.dot(F.slice("v", 1, DIM), F.slice("v", 1, DIM)) / (vectors.norm(F.col("v")) * vectors.norm(F.slice("v", 1, DIM)))
    return c.agg(F.round(F.min(cosine), 6).alias("least"), F.round(F.avg(cosine), 6).alias("mean"))
