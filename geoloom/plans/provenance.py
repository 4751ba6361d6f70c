"""Queries over what artefacts were made from: states of caches, banks, stages and splits. Recorded facts are made from the test tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import provenance as prov
from .evaluation import SPLIT_SQL, assigned
from .fixtures import CACHE_SQL, cache
from .registry import query, table

CHECKPOINTS_SQL = """ck AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN 'cache' || c_nationkey END AS name, CASE WHEN c_custkey % 3 > 0 THEN substr(md5(c_nationkey || '-' || c_custkey % 2), 1, 12) END AS recorded,
  CASE WHEN c_custkey % 5 > 0 THEN 1000 + c_custkey % 100 END AS saved, c_custkey % 11 = 0 AS whole FROM customer),
f AS (SELECT 'cache' || n_nationkey AS name, substr(md5(n_nationkey || '-0'), 1, 12) AS digest, 1000 + n_nationkey * 4 AS modified, CASE WHEN n_nationkey % 4 > 0 THEN 100 * n_nationkey END AS n_rows FROM nation WHERE n_name <> 'CHINA')"""


def checkpoints(spark, sf_dir):
    """Checkpoints and the caches they name; one cache is gone."""
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    ck = table(spark, sf_dir, "customer").select(
        i.alias("id"), F.when(i % 7 > 0, F.concat(F.lit("cache"), n)).alias("name"), F.when(i % 3 > 0, F.substring(F.md5(F.concat_ws("-", n, i % 2)), 1, 12)).alias("recorded"),
        F.when(i % 5 > 0, 1000 + i % 100).alias("saved"), (i % 11 == 0).alias("whole"),
    )
    k = F.col("n_nationkey")
    files = table(spark, sf_dir, "nation").where("n_name <> 'CHINA'").select(
        F.concat(F.lit("cache"), k).alias("name"), F.substring(F.md5(F.concat_ws("-", k, F.lit(0))), 1, 12).alias("digest"), (1000 + k * 4).alias("modified"), F.when(k % 4 > 0, 100 * k).alias("n_rows"), F.lit(True).alias("found")
    )
    return ck.join(files, "name", "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("cache_states", f"WITH {CHECKPOINTS_SQL} SELECT id, CASE WHEN ck.name IS NULL THEN 'none needed' WHEN f.name IS NULL THEN 'missing' WHEN recorded = digest THEN 'verified' WHEN recorded IS NOT NULL THEN 'rebuilt' WHEN saved IS NULL THEN 'unknown' WHEN modified > saved THEN 'newer' ELSE 'plausible' END AS state FROM ck LEFT JOIN f ON f.name = ck.name")
def cache_states(spark, sf_dir):
    c = checkpoints(spark, sf_dir)
    return c.select("id", prov.cache_state(*map(F.col, ("name", "found", "recorded", "digest", "saved", "modified"))).alias("state"))


@query("bank_states", f"WITH {CHECKPOINTS_SQL} SELECT CASE WHEN whole THEN 'whole by request' WHEN ck.name IS NULL THEN 'whole, legacy' WHEN f.name IS NULL THEN 'refused: file missing' WHEN n_rows IS NULL THEN 'refused: no rows recorded' ELSE 'recorded' END AS state, count(*) AS n, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ck LEFT JOIN f ON f.name = ck.name GROUP BY ALL")
def bank_states(spark, sf_dir):
    c = checkpoints(spark, sf_dir).withColumn("state", prov.bank_state(*map(F.col, ("whole", "name", "found", "n_rows"))))
    return c.groupBy("state").agg(F.count("*").alias("n"), F.sum("n_rows").cast("long").alias("n_rows"))


@query("arm_exclusions", f"WITH {CHECKPOINTS_SQL}, s AS (SELECT id % 9 AS arm, CASE WHEN ck.name IS NULL THEN 'none needed' WHEN f.name IS NULL THEN 'missing' WHEN recorded = digest THEN 'verified' WHEN recorded IS NOT NULL THEN 'rebuilt' WHEN saved IS NULL THEN 'unknown' WHEN modified > saved THEN 'newer' ELSE 'plausible' END AS state FROM ck LEFT JOIN f ON f.name = ck.name) SELECT arm, count(*) FILTER (WHERE state IN ('verified', 'none needed', 'plausible')) AS used, count(*) FILTER (WHERE state = 'rebuilt') AS rebuilt, count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state IN ('newer', 'unknown')) AS unverified FROM s GROUP BY arm")
def arm_exclusions(spark, sf_dir):
    """How many runs of each arm count, and why the others don't."""
    s = cache_states(spark, sf_dir).withColumn("arm", F.col("id") % 9)
    state = F.col("state")
    return s.groupBy("arm").agg(F.count_if(state.isin("verified", "none needed", "plausible")).alias("used"), F.count_if(state == "rebuilt").alias("rebuilt"), F.count_if(state == "missing").alias("missing"), F.count_if(state.isin("newer", "unknown")).alias("unverified"))


@query("stage_states", """WITH s AS (SELECT c_nationkey AS stage, CASE WHEN c_nationkey % 6 > 0 THEN md5(CAST(c_custkey AS VARCHAR)) END AS recorded, CASE WHEN c_custkey % 131 > 0 THEN md5(CAST(c_custkey + CASE WHEN c_custkey % 97 = 0 THEN 1 ELSE 0 END AS VARCHAR)) END AS now FROM customer),
p AS (SELECT stage, count(recorded) AS known, count(*) FILTER (WHERE recorded IS NOT NULL AND now IS NULL) AS gone, count(*) FILTER (WHERE now <> recorded) AS other FROM s GROUP BY stage)
SELECT CAST(n_nationkey AS BIGINT) AS stage, CASE WHEN coalesce(known, 0) = 0 THEN 'legacy' WHEN gone > 0 THEN 'missing' WHEN other > 0 THEN 'changed' ELSE 'satisfied' END AS state FROM nation LEFT JOIN p ON p.stage = n_nationkey""")
def stage_states(spark, sf_dir):
    """Stages (nations) whose inputs and outputs (customers) are stamped by content."""
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    s = table(spark, sf_dir, "customer").select(
        n.cast("long").alias("stage"), F.when(n % 6 > 0, F.md5(i.cast("string"))).alias("recorded"), F.when(i % 131 > 0, F.md5((i + F.when(i % 97 == 0, 1).otherwise(0)).cast("string"))).alias("now")
    )
    return prov.stage_states(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("stage")), s)


@query("error_caches", """WITH c AS (SELECT c_custkey AS tag, 's' || c_custkey % 5 AS want, CASE WHEN c_custkey % 3 = 0 THEN 'i' || c_custkey % 2 END AS wi, c_custkey % 50 AS saved FROM customer WHERE c_mktsegment <> 'BUILDING'),
f AS (SELECT o_custkey AS tag, o_orderkey AS file, CASE WHEN o_orderkey % 4 > 0 THEN 's' || o_orderkey % 5 END AS stamp, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 = 0 THEN 'i' || o_orderkey % 2 END AS inputs, o_orderkey % 60 AS modified FROM orders),
g AS (SELECT f.tag, f.file, f.modified, CASE WHEN c.tag IS NULL THEN 1 WHEN stamp = want AND inputs IS NOT DISTINCT FROM wi THEN 3 WHEN stamp IS NULL AND wi IS NULL AND modified > saved THEN 2 END AS grade FROM f LEFT JOIN c ON c.tag = f.tag)
SELECT tag, file FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY grade DESC, modified DESC, file DESC) AS r FROM g WHERE grade IS NOT NULL) WHERE r = 1""")
def error_caches(spark, sf_dir):
    """Cached errors (orders) of tags (customers), of which one segment's checkpoints are gone."""
    i, o = F.col("c_custkey"), F.col("o_orderkey")
    c = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(i.alias("tag"), F.concat(F.lit("s"), i % 5).alias("stamp"), F.when(i % 3 == 0, F.concat(F.lit("i"), i % 2)).alias("inputs"), (i % 50).alias("saved"))
    f = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("tag"), o.alias("file"), F.when(o % 4 > 0, F.concat(F.lit("s"), o % 5)).alias("stamp"), F.when((o % 4 > 0) & (o % 3 == 0), F.concat(F.lit("i"), o % 2)).alias("inputs"), (o % 60).alias("modified")
    )
    return prov.error_caches(c, f)


@query("split_read", f"WITH {SPLIT_SQL} SELECT o_orderkey, grp, split FROM rows JOIN assigned USING (grp)")
def split_read(spark, sf_dir):
    """One mode's assignment out of a table that has a column for each; a mode without a column is refused."""
    a = assigned(spark, sf_dir).select("grp", F.col("split").alias("split_customer"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("grp"), "o_totalprice").join(a, "grp")
    return prov.split_column(rows, "customer", ("customer", "nation"), ("o_orderkey", "grp"))


@query("resplit_verdict", """WITH r AS (SELECT md5('17:' || c_custkey) < 'c' AS legacy, md5('17:' || c_custkey) < 'c' AS a, md5('17:' || c_nationkey) < 'c' AS b FROM customer),
s AS (SELECT avg(CASE WHEN a = legacy THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN b = legacy THEN 1.0 ELSE 0 END) AS b FROM r)
SELECT 'row' AS mode, round(a, 9) AS agreement, CASE WHEN a = 1 THEN 'same' WHEN greatest(a, b) = 1 THEN 'other' ELSE 'refused' END AS verdict FROM s UNION ALL SELECT 'nation', round(b, 9), CASE WHEN b = 1 THEN 'same' WHEN greatest(a, b) = 1 THEN 'other' ELSE 'refused' END FROM s""")
def resplit_verdict(spark, sf_dir):
    """Whether a split column may be written anew: some mode has to give just what stands there."""
    def side(c):
        return F.md5(F.concat(F.lit("17:"), F.col(c).cast("string"))) < "c"

    r = table(spark, sf_dir, "customer").select(side("c_custkey").alias("legacy"), side("c_custkey").alias("row"), side("c_nationkey").alias("nation"))
    return prov.resplit(r, "legacy", ["row", "nation"]).withColumn("agreement", F.round("agreement", 9))


@query("prefix_faults", "SELECT vec_id FROM embeddings WHERE vec_id % 50 = 3 OR vec_id % 70 = 5")
def prefix_faults(spark, sf_dir):
    """Vectors that carry a conditioning block behind a retrieval block that isn't the bank's: some were rebuilt, some lack a row."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles("embedding").alias("v"))
    i = F.col("vec_id")
    joined = e.select("vec_id", F.concat(F.when(i % 50 == 3, F.reverse("v")).otherwise(F.col("v")), F.array(F.lit(1.0), F.lit(0.0))).alias("v"))
    return prov.prefix_faults(joined, e.where("vec_id % 70 <> 5"), "vec_id", 64)


@query("join_states", "WITH j AS (SELECT CASE WHEN c_custkey % 10 > 0 THEN c_custkey % 4 END AS a, CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 8 % 5 END AS b FROM customer) SELECT CASE WHEN a IS NULL THEN 'refused: first unstamped' WHEN b IS NULL THEN 'refused: second unstamped' WHEN a <> b THEN 'refused: other rows' ELSE 'joined' END AS state, count(*) AS n FROM j GROUP BY ALL")
def join_states(spark, sf_dir):
    i = F.col("c_custkey")
    j = table(spark, sf_dir, "customer").select(F.when(i % 10 > 0, i % 4).alias("a"), F.when(i % 9 > 0, i % 8 % 5).alias("b"))
    return j.groupBy(prov.join_state(F.col("a"), F.col("b")).alias("state")).agg(F.count("*").alias("n"))


@query("renderer_states", "SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'unstamped' WHEN o_orderkey % 5 = 2 THEN 'current' ELSE 'foreign' END AS state, count(*) AS n FROM orders GROUP BY ALL")
def renderer_states(spark, sf_dir):
    """Tiles (orders) by the renderer that made them, against the one that is asked now."""
    o = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(F.when(o % 13 > 0, F.md5((o % 5).cast("string"))).alias("made_by"))
    return t.groupBy(prov.renderer_state(F.col("made_by"), F.md5(F.lit("2"))).alias("state")).agg(F.count("*").alias("n"))


@query("source_fingerprint", "SELECT sha256(string_agg(n_name || '|' || octet_length(encode(r_name)) || '|' || sha256(r_name), ',' ORDER BY n_name || '|' || octet_length(encode(r_name)) || '|' || sha256(r_name))) AS digest FROM nation JOIN region ON r_regionkey = n_regionkey")
def source_fingerprint(spark, sf_dir):
    """One digest of a few named sources (here nations and their region's name)."""
    s = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return prov.fingerprint(s, "n_name", "r_name")


RESOLVE_SQL = """a AS (SELECT 's' || c_custkey % 30 || '_' || c_custkey AS stem, CASE WHEN c_custkey % 6 = 1 THEN 500 + c_nationkey % 9 ELSE 40 + c_custkey % 12 * 10 END AS n, CASE WHEN c_custkey % 17 = 0 THEN 40 + c_custkey % 12 * 10 END AS own_n,
  CASE WHEN c_custkey % 4 = 0 THEN 40 + c_custkey % 12 * 10 END AS rows_n, c_custkey % 700 AS rows_max FROM customer), a2 AS (SELECT stem, CASE WHEN n = 150 THEN 500 ELSE n END AS n, own_n, rows_n, rows_max FROM a),
m AS (SELECT 's' || n_nationkey AS meta, CASE WHEN n_nationkey % 2 = 0 THEN 40 + n_nationkey * 10 ELSE n_nationkey % 9 END AS len FROM nation)"""


@query("resolved_rows", f"""WITH {RESOLVE_SQL}, p AS (SELECT a2.stem, m.meta, m.len, row_number() OVER (PARTITION BY a2.stem ORDER BY length(m.meta) DESC) AS r FROM a2 JOIN m ON starts_with(a2.stem, m.meta) AND ((coalesce(rows_n = n, false) AND rows_max < len) OR len = n)),
e AS (SELECT len + 500 AS n, count(*) AS several, min(meta) AS ext FROM m GROUP BY len)
SELECT a2.stem, CASE WHEN own_n = a2.n THEN 'own' WHEN p.meta IS NOT NULL AND coalesce(rows_n = a2.n, false) AND rows_max < p.len THEN 'index into ' || p.meta WHEN p.meta IS NOT NULL THEN 'rows of ' || p.meta WHEN coalesce(rows_n = a2.n, false) AND rows_max < 500 THEN 'index into the release'
  WHEN a2.n = 500 THEN 'release' WHEN several = 1 THEN 'release and ' || ext WHEN several > 1 THEN 'by content' ELSE 'unknown' END AS source FROM a2 LEFT JOIN p ON p.stem = a2.stem AND p.r = 1 LEFT JOIN e ON e.n = a2.n""")
def resolved_rows(spark, sf_dir):
    """Whose ids unstamped artefacts (customers) hold, given metadata (nations) and a release of 500 rows."""
    i, n = F.col("c_custkey"), F.col("n_nationkey")
    size = 40 + i % 12 * 10
    a = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), i % 30, F.lit("_"), i).alias("stem"), F.when(i % 6 == 1, 500 + F.col("c_nationkey") % 9).otherwise(F.when(size == 150, 500).otherwise(size)).alias("n"), F.when(i % 17 == 0, size).alias("own_n"), F.when(i % 4 == 0, size).alias("rows_n"), (i % 700).alias("rows_max")
    )
    m = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), n).alias("meta"), F.when(n % 2 == 0, 40 + n * 10).otherwise(n % 9).alias("len"))
    return prov.resolve_rows(a, m, 500)


@query("argument_refusals", """WITH a AS (SELECT c_custkey AS id, c_custkey % 3 > 0 AS retr, c_custkey % 5 - 1 AS k, (c_custkey % 13 - 1) / 10.0 AS dr, c_custkey % 4 AS sink, c_custkey % 2 AS neg, c_custkey % 7 AS soft FROM customer)
SELECT id, concat_ws(',', CASE WHEN retr AND k <= 0 THEN 'neighbours' END, CASE WHEN dr < 0 OR dr >= 1 THEN 'drop range' END, CASE WHEN dr > 0 AND NOT retr THEN 'drop alone' END, CASE WHEN sink < 1 THEN 'sink count' END, CASE WHEN sink > 1 AND neg <= 0 THEN 'sink alone' END,
  CASE WHEN soft = 0 THEN 'soft unread' END, CASE WHEN soft IN (1, 2) AND neg > 0 THEN 'soft with sink' END) AS broken FROM a""")
def argument_refusals(spark, sf_dir):
    """Which rules the arguments of a run break; none, and it may start."""
    i = F.col("c_custkey")
    soft = F.element_at(F.array(*map(F.lit, ("0,x", "0,0.5", "1", "0", "0,0", "0", "0,0,0"))), (i % 7 + 1).cast("int"))
    a = table(spark, sf_dir, "customer").select(i.alias("id"), (i % 3 > 0).alias("retr"), (i % 5 - 1).alias("retr_k"), ((i % 13 - 1) / 10.0).alias("retr_drop"), (i % 4).alias("sink_k"), (i % 2).alias("neg"), soft.alias("soft"))
    return a.select("id", prov.refusals(prov.training_rules()).alias("broken"))


@query("external_set", f"WITH {CACHE_SQL} SELECT row_id, ((y16 >> 12) & 15) * 16 + ((x16 >> 12) & 15) AS a0, ((y16 >> 8) & 15) * 16 + ((x16 >> 8) & 15) AS a1, ((y16 >> 4) & 15) * 16 + ((x16 >> 4) & 15) AS a2, (y16 & 15) * 16 + (x16 & 15) AS a3 FROM cache")
def external_set(spark, sf_dir):
    """Rows from elsewhere as an evaluation takes them: the true action of each step read off their place."""
    from .tiles import steps

    s = steps(cache(spark, sf_dir).select("row_id", "x16", "y16")).select("row_id", "step", "action")
    return s.groupBy("row_id").agg(*(F.max(F.when(F.col("step") == t, F.col("action"))).alias(f"a{t}") for t in range(4)))
