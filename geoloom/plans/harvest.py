"""Queries over harvested records, matrices, archives and stores that are written more than once."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import harvest, select
from ..operators.order import shared
from ..sources import matrices, readers
from .registry import query, table

RECORDS_SQL = """r AS (SELECT event_id, event_id // 2 AS id, user_id, event_type = 'click' AS pano, CASE WHEN event_id % 11 > 0 THEN value END AS quality,
  CASE WHEN event_id % 5 > 0 THEN 'c' || event_id END AS computed, CASE WHEN event_id % 7 > 0 THEN 'g' || event_id END AS given, CASE WHEN event_id % 3 > 0 THEN 'u2' END AS large, 'u1' AS small,
  CASE WHEN event_id % 13 > 0 THEN 200 + (event_id * 37) % 1900 END AS w, 200 + (event_id * 53) % 1100 AS h FROM events)"""


def records(spark, sf_dir):
    """Shots as a harvest would list them, two to an id, some without quality, position or sides."""
    i = F.col("event_id")

    def unless(n, value):
        return F.when(i % n > 0, value)

    return table(spark, sf_dir, "events").select(
        "event_id", F.floor(i / 2).alias("id"), "user_id", (F.col("event_type") == "click").alias("pano"), unless(11, F.col("value")).alias("quality"), unless(5, F.concat(F.lit("c"), i)).alias("computed"),
        unless(7, F.concat(F.lit("g"), i)).alias("given"), unless(3, F.lit("u2")).alias("large"), F.lit("u1").alias("small"), unless(13, 200 + (i * 37) % 1900).alias("w"), (200 + (i * 53) % 1100).alias("h"),
    )


@query("harvest_filters", f"WITH {RECORDS_SQL}, p AS (SELECT *, coalesce(computed, given) AS place, row_number() OVER (PARTITION BY id ORDER BY event_id) AS k FROM r WHERE NOT pano AND coalesce(quality, 0) >= 5 AND coalesce(computed, given) IS NOT NULL) SELECT id, event_id, place, coalesce(large, small) AS url FROM p WHERE k = 1")
def harvest_filters(spark, sf_dir):
    """No panoramas, quality of 5 or more, placed one way or the other; the first of an id."""
    r = records(spark, sf_dir)
    kept = harvest.accept(r, "id", "event_id", F.col("quality"), 5, F.col("pano"), F.coalesce("computed", "given"))
    return kept.select("id", "event_id", "place", F.coalesce("large", "small").alias("url"))


@query("harvest_sides", f"WITH {RECORDS_SQL} SELECT event_id, w, h FROM r WHERE w IS NOT NULL AND least(w, h) >= 640")
def harvest_sides(spark, sf_dir):
    return harvest.wide_enough(records(spark, sf_dir), "w", "h", 640).select("event_id", "w", "h")


@query("seeds_behind", "SELECT c_custkey, CAST(n AS INT) AS n FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('17:' || c_custkey), c_custkey) - 1 AS n FROM customer) WHERE n >= 40 AND n < 100")
def seeds_behind(spark, sf_dir):
    """The sixty seeds behind the forty that an earlier run has visited."""
    from ..operators.order import numbered

    c = table(spark, sf_dir, "customer").select("c_custkey")
    return numbered(harvest.seeds(c, "c_custkey", 60, 40).withColumn("m", F.md5(F.concat_ws(":", F.lit(17), F.col("c_custkey").cast("string")))), [F.col("m"), F.col("c_custkey")], "n").select("c_custkey", (F.col("n") + 40).cast("int").alias("n"))


@query("quota_rounds")
def quota_rounds(spark, sf_dir):
    """At most 400 shots that load (errors don't), 3 for each drive, 60 for each seed, an hour apart within a drive, in up to three rounds."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", ((F.col("event_id") * 31) % 16).alias("seed"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") != "error").alias("ok"))
    return harvest.quota_rounds(e, "event_id", "user_id", "seed", "t", "ok", 400, 3, 60, 3600).select("event_id", "user_id", "seed", "round")


@query("cohort_replay", "SELECT c_custkey, md5('17:' || c_custkey) AS hash FROM customer ORDER BY md5('17:' || c_custkey), c_custkey LIMIT 50")
def cohort_replay(spark, sf_dir):
    """A cohort is drawn once and written down; when the table has grown, the same fifty are replayed."""
    place = f"{shared(spark)}/cohort-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer").select("c_custkey")
    select.frozen(c, "c_custkey", 50, place)
    grown = c.unionByName(c.select((F.col("c_custkey") + 1_000_000_000).alias("c_custkey")))
    return select.frozen(grown, "c_custkey", 50, place).withColumn("hash", F.md5(F.concat_ws(":", F.lit(17), F.col("c_custkey").cast("string"))))


@query("cache_lookups", "WITH e AS (SELECT event_id, user_id, epoch(ts) AS t, event_type = 'purchase' AS written FROM events), l AS (SELECT *, max(CASE WHEN written THEN t END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM e), r AS (SELECT *, coalesce(t - last <= 86400, false) AS fresh FROM l WHERE NOT written) SELECT user_id, count(*) FILTER (WHERE fresh) AS hits, count(*) FILTER (WHERE NOT fresh) AS misses, count(DISTINCT CASE WHEN NOT fresh THEN CAST(floor(t / 3600) AS BIGINT) END) AS renders, CAST(floor(max(t) FILTER (WHERE fresh)) AS BIGINT) AS used FROM r GROUP BY user_id")
def cache_lookups(spark, sf_dir):
    """Reads of entries that live for a day: hits, misses, how many renders the misses of an hour share, and when an entry was last of use."""
    ts = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(ts) / 1_000_000.0).alias("t"), (F.col("event_type") == "purchase").alias("written"))
    r = harvest.lookups(e, "user_id", "t", F.col("written"), 86400, 3600)
    return r.groupBy("user_id").agg(F.count_if("fresh").alias("hits"), F.count_if(~F.col("fresh")).alias("misses"), F.count_distinct("flight").alias("renders"), F.floor(F.max(F.when(F.col("fresh"), F.col("t")))).alias("used"))


@query("npy_rows", "SELECT label, vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total, CAST(len(embedding) AS INT) AS width FROM embeddings")
def npy_rows(spark, sf_dir):
    """Vectors written as .npy blocks (one for each label and hundred ids) beside an .npz with their ids, and read back as rows."""
    import numpy as np

    e = table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 100).alias("block"), "vec_id", vectors.doubles("embedding").alias("v"))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id").combine_chunks()
        m = np.array(rows.column("v").to_pylist())
        ids = io.BytesIO()
        np.savez(ids, ids=rows.column("vec_id").to_numpy())
        name = f"{rows.column('label')[0].as_py()}/{rows.column('block')[0].as_py()}"
        return pa.table({"path": [f"{name}.npy", f"{name}.npz"], "content": pa.array([matrices.npy_bytes(m), ids.getvalue()], pa.binary())})

    files = e.groupBy("label", "block").applyInArrow(build, "path string, content binary")
    got = matrices.rows(files).withColumn("name", F.regexp_replace("path", r"\.np[yz]$", ""))
    ids = got.where("member = 'ids'").select("name", "row", F.col("v")[0].cast("long").alias("vec_id"))
    vals = got.where("member = ''").select("name", "row", "v")
    return ids.join(vals, ["name", "row"]).select(F.split("name", "/")[0].cast("int").alias("label"), "vec_id", F.round(vectors.total(F.col("v")), 5).alias("total"), F.size("v").alias("width"))


@query("zip_members", "SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS pos, CASE WHEN page_id % 9 > 0 THEN CAST(octet_length(encode(html)) AS BIGINT) END AS bytes, CASE WHEN page_id % 9 > 0 THEN md5(html) END AS digest, page_id % 9 = 0 AS missing FROM pages")
def zip_members(spark, sf_dir):
    """Pages packed into archives, one in nine left out, and wanted back in the order of their addresses: members are read archive by archive."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.concat(F.lit("p/"), F.col("page_id"), F.lit(".html")).alias("name"))

    def build(rows: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, h in sorted(zip(rows.column("name").to_pylist(), rows.column("html").to_pylist(), strict=True)):
                z.writestr(n, h or "")
        return pa.table({"path": [f"{rows.column('pack')[0].as_py()}.zip"], "content": pa.array([out.getvalue()], pa.binary())})

    archives = p.where("page_id % 9 > 0").select("name", "html", F.floor(F.col("page_id") / 64).cast("int").alias("pack")).groupBy("pack").applyInArrow(build, "path string, content binary")
    from ..operators.order import numbered

    wanted = numbered(p.select("page_id", "url", "name"), [F.col("url"), F.col("page_id")], "pos").withColumn("pos", F.col("pos") + 1)
    got = readers.pick(readers.unzip(archives), wanted)
    return got.select("page_id", "pos", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"), F.col("content").isNull().alias("missing"))


@query("resumed_rows", "SELECT o_orderkey, CASE WHEN md5(CAST(o_orderkey AS VARCHAR)) < '8' THEN 'first' ELSE 'second' END AS run FROM orders")
def resumed_rows(spark, sf_dir):
    """A run that dies: half of its rows are written and marked, some more are written only. The next run does what isn't marked, and each row counts once."""
    place = f"{shared(spark)}/resume-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("m"))
    matrices.resume(o.where("m < '8'").select("o_orderkey", F.lit("first").alias("run_name")), place, "o_orderkey")
    matrices.resume(o.where("m < 'a'").select("o_orderkey", F.lit("died").alias("run_name")), place, "o_orderkey", mark=False)
    matrices.resume(o.select("o_orderkey", F.lit("second").alias("run_name")), place, "o_orderkey")
    return matrices.read_resumed(spark, place, "o_orderkey").select("o_orderkey", F.col("run_name").alias("run"))


@query("crop_lefts", "WITH c AS (SELECT c_custkey, CAST(224 + c_custkey % 700 AS INT) AS w, CAST(1 + c_custkey % 4 AS INT) AS crops FROM customer), l AS (SELECT c_custkey, crops, w, unnest(range(crops)) AS i FROM c) SELECT c_custkey, CAST(i AS INT) AS crop, CASE WHEN crops = 1 THEN CAST((w - 224) // 2 AS BIGINT) ELSE CAST(round_even(i * (w - 224) / (crops - 1), 0) AS BIGINT) END AS lft, CASE WHEN crops = 1 THEN 0.5 ELSE round(round_even(i * (w - 224) / (crops - 1), 0) / greatest(w - 224, 1), 6) END AS place FROM l")
def crop_lefts(spark, sf_dir):
    """Where the crops of a resized picture begin, and each one's place between the edges."""
    i = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", (224 + i % 700).cast("int").alias("w"), (1 + i % 4).cast("int").alias("crops"))
    c = c.select("c_custkey", "w", "crops", F.posexplode(vectors.crop_lefts(F.col("w"), 224, F.col("crops"))).alias("crop", "lft"))
    return c.select("c_custkey", "crop", "lft", F.when(F.col("crops") == 1, 0.5).otherwise(F.round(F.col("lft") / F.greatest(F.col("w") - 224, F.lit(1)), 6)).alias("place"))


@query("axial_tables", "WITH a AS (SELECT range AS action FROM range(256)), p AS (SELECT range AS k FROM range(8)), t AS (SELECT action, k, 2 * pi() / (2 * pow(16, k / 7.0)) AS theta FROM a, p) SELECT action, CAST(k AS INT) AS pair, round(cos((action % 16) * theta), 6) AS c, round(sin((action % 16) * theta), 6) AS s FROM t UNION ALL SELECT action, CAST(k + 8 AS INT), round(cos((action // 16) * theta), 6), round(sin((action // 16) * theta), 6) FROM t")
def axial_tables(spark, sf_dir):
    """Rotation tables of a 16 by 16 grid for vectors of 32: half the pairs turn with the column, half with the row."""
    return vectors.axial_tables(spark, 256, 32).select("action", "pair", F.round("c", 6).alias("c"), F.round("s", 6).alias("s"))


@query("cosine_rates", "SELECT l_linenumber, round(0.1 + (1.0 - 0.1) * 0.5 * (1 + cos(least(l_linenumber / 5.0, 1.0) * pi())), 6) AS rate, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def cosine_rates(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    return n.select("l_linenumber", F.round(vectors.cosine_rate(F.col("l_linenumber"), 5, 1.0, 0.1), 6).alias("rate"), "n")


@query("next_starts", "SELECT event_id, CAST(epoch(CASE WHEN date_trunc('day', ts) + INTERVAL 7 HOUR + INTERVAL 30 MINUTE > ts THEN date_trunc('day', ts) + INTERVAL 7 HOUR + INTERVAL 30 MINUTE ELSE date_trunc('day', ts) + INTERVAL 31 HOUR + INTERVAL 30 MINUTE END) AS BIGINT) AS start FROM events")
def next_starts(spark, sf_dir):
    """The next 07:30 behind each event."""
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(text.next_clock(F.col("ts").cast("timestamp"), "07:30")).alias("start"))


@query("cache_names", "SELECT c_custkey, 'knn_s' || (c_custkey % 5) || CASE WHEN c_custkey % 3 > 0 THEN '_cell' ELSE '' END || '_k' || (c_custkey % 32) || '.npz' AS name FROM customer")
def cache_names(spark, sf_dir):
    """File names put together from what an artefact was made with; parts that don't apply are left out."""
    i = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", text.cache_name(F.lit("knn"), F.concat(F.lit("s"), i % 5), F.when(i % 3 > 0, "cell"), F.concat(F.lit("k"), i % 32), suffix=".npz").alias("name"))


@query("sql_functions", "SELECT c_custkey, CAST(least(greatest(floor(((c_custkey % 360) - 180 + 180.0) / 360.0 * 65536), 0), 65535) AS BIGINT) AS x, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(1.0) - radians(0.0)) / 2), 2) + cos(radians(0.0)) * cos(radians(1.0)) * pow(sin((radians((c_custkey % 90)::DOUBLE) - radians(0.0)) / 2), 2)))), 3) AS km FROM customer")
def sql_functions(spark, sf_dir):
    """The functions under their names in SQL."""
    from ..functions import sql

    sql.register(spark)
    table(spark, sf_dir, "customer").createOrReplaceTempView("sql_functions_customer")
    return spark.sql("SELECT c_custkey, geo_tile_x(CAST(c_custkey % 360 AS DOUBLE) - 180, 16) AS x, round(geo_km(0, 0, 1, c_custkey % 90), 3) AS km FROM sql_functions_customer")
