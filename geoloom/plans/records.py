"""Queries over text, selection, caches, sets and integrity audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, text, vectors
from ..operators import select, splits
from .evaluation import ARMS_SQL, SPLIT_SQL, arms, assigned
from .fixtures import CACHE_SQL, cache
from .registry import query, table
from .retrieval import KNN_SQL, knn

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
TOKENS_SQL = f"""folded AS (SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS f FROM documents),
words AS (SELECT doc_id, unnest(string_split(f, ' ')) AS w FROM folded), toks AS (SELECT doc_id, w FROM words WHERE length(w) >= 3 AND NOT list_contains({STOP_SQL}, w))"""


@query("text_tokens", f"WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n, count(DISTINCT w) AS kinds, min(w) AS first, max(w) AS last FROM toks GROUP BY doc_id")
def text_tokens(spark, sf_dir):
    d = text.exploded(table(spark, sf_dir, "documents"), "text", "doc_id", name="w")
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("w").alias("kinds"), F.min("w").alias("first"), F.max("w").alias("last"))


def idf(docs):
    """token, df, idf: ln(N / (1 + df)) + 1 over documents."""
    t = text.exploded(docs, "text", "doc_id", distinct=True).groupBy("token").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(n)).select("token", "df", (F.log(F.col("n") / (1 + F.col("df"))) + 1).alias("idf"))


@query("text_idf", f"WITH {TOKENS_SQL}, d AS (SELECT w AS token, count(DISTINCT doc_id) AS df FROM toks GROUP BY w) SELECT token, df, round(ln((SELECT count(*) FROM documents) / (1 + df)) + 1, 6) AS idf FROM d")
def text_idf(spark, sf_dir):
    return idf(table(spark, sf_dir, "documents")).withColumn("idf", F.round("idf", 6))


#: Fixed value: how alike two words have to be.
LEAST_RATIO = 0.82


@query("fuzzy_match")
def fuzzy_match(spark, sf_dir):
    """How well each turn of a conversation echoes the turn before: the IDF-weighted sum of its tokens' best fuzzy ratios of 0.82 or more.

    Equal tokens have ratio 1 by an equi join; only the others are compared as pairs, and aligned only where their edit distance leaves that ratio open.
    """
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "conv_id", "turn", "text")
    weights = idf(c.select("doc_id", "text")).select("token", "idf")
    t = c.select("conv_id", "turn", F.array_distinct(text.tokens("text")).alias("mine"))
    prev = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("mine").alias("theirs"))
    p = t.join(prev, ["conv_id", "turn"]).select("conv_id", "turn", F.explode("mine").alias("token"), "theirs")
    exact = p.where(F.array_contains("theirs", F.col("token"))).select("conv_id", "turn", "token", F.lit(1.0).alias("ratio"))
    rest = p.where(~F.array_contains("theirs", F.col("token"))).select("conv_id", "turn", "token", F.explode("theirs").alias("other"))
    # Matched letters stay, and at most all others are taken out or put in, so 2 matched <= both lengths - edits, which bounds the ratio.
    sizes = F.length("token") + F.length("other")
    rest = rest.where(sizes - F.levenshtein("token", "other") >= LEAST_RATIO * sizes)
    near = rest.withColumn("ratio", text.fuzzy_ratio("token", "other")).groupBy("conv_id", "turn", "token").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)
    return exact.unionByName(near).join(weights, "token").groupBy("conv_id", "turn").agg(F.round(F.sum(F.col("idf") * F.col("ratio")), 6).alias("score"), F.count("*").alias("matched"))


OVERLAY_SQL = f"""{CACHE_SQL}, o AS (SELECT row_id, translate(CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ' ' || CAST(floor(abs(lat)) AS BIGINT) || '.' || lpad(CAST(CAST(round((abs(lat) - floor(abs(lat))) * 10000) AS BIGINT) AS VARCHAR), 4, '0'), '01', 'Ol') || '  ' ||
  translate(CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || CAST(floor(abs(lon)) AS BIGINT) || ', ' || lpad(CAST(CAST(round((abs(lon) - floor(abs(lon))) * 10000) AS BIGINT) AS VARCHAR), 4, '0'), '18', 'IB') || ' speed 50' AS t FROM cache)"""


def overlays(spark, sf_dir):
    """Places as a camera would write them into a picture, with letters that readers mistake."""
    def part(c):
        return F.floor(F.abs(c)).cast("string"), F.lpad(F.round((F.abs(c) - F.floor(F.abs(c))) * 10000).cast("long").cast("string"), 4, "0")

    (la, lf), (oa, of) = part(F.col("lat")), part(F.col("lon"))
    lat = F.translate(F.concat(F.when(F.col("lat") >= 0, "N ").otherwise("S "), la, F.lit("."), lf), "01", "Ol")
    lon = F.translate(F.concat(F.when(F.col("lon") >= 0, "E").otherwise("W"), oa, F.lit(", "), of), "18", "IB")
    return cache(spark, sf_dir).select("row_id", F.concat(lat, F.lit("  "), lon, F.lit(" speed 50")).alias("t"))


@query("overlay_coords", f"""WITH {OVERLAY_SQL}, m AS (SELECT row_id, regexp_extract(t, '([NS])\\s*([0-9oOlIB]{{1,3}})[.,\\s]{{1,3}}([0-9oOlIB]{{3,8}})', ['h', 'd', 'f']) AS a, regexp_extract(t, '([EW])\\s*([0-9oOlIB]{{1,3}})[.,\\s]{{1,3}}([0-9oOlIB]{{3,8}})', ['h', 'd', 'f']) AS b FROM o)
SELECT row_id, round(CASE WHEN a.h = 'N' THEN 1 ELSE -1 END * (CAST(translate(a.d, 'oOlISB', '001158') AS DOUBLE) + CAST('0.' || translate(a.f, 'oOlISB', '001158') AS DOUBLE)), 6) AS lat,
  round(CASE WHEN b.h = 'E' THEN 1 ELSE -1 END * (CAST(translate(b.d, 'oOlISB', '001158') AS DOUBLE) + CAST('0.' || translate(b.f, 'oOlISB', '001158') AS DOUBLE)), 6) AS lon FROM m WHERE a.h <> '' AND b.h <> ''""")
def overlay_coords(spark, sf_dir):
    o = overlays(spark, sf_dir).select("row_id", text.overlay("t").alias("c")).where("c is not null")
    return o.select("row_id", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query("shot_seconds", "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, NULL::BIGINT AS bad FROM events")
def shot_seconds(spark, sf_dir):
    """Seconds of a written time; what can't be read is null."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("s"))
    return e.select("event_id", text.shot_seconds("s").alias("t"), text.shot_seconds(F.concat(F.lit("x"), "s")).alias("bad"))


@query("parse_names", "SELECT c_custkey, CAST(64 * (1 + c_custkey % 12) AS INT) AS width, CAST(c_custkey % 400 AS INT) AS bank, CAST(c_custkey % 9 AS INT) AS epochs, CASE WHEN c_custkey % 2 = 0 THEN 'cell8' END AS extra, lpad(CAST(c_custkey % 100 AS VARCHAR), 4, '0') AS pack, CAST(1 + c_custkey % 16 AS BIGINT) * 1073741824 AS bytes, printf('%.1f GB', (1 + c_custkey % 16)::DOUBLE) AS shown FROM customer")
def parse_names(spark, sf_dir):
    """Run names, pack numbers and sizes written and read back."""
    i = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("d"), 64 * (1 + i % 12), F.lit("-b"), i % 400, F.lit("-e"), i % 9, F.when(i % 2 == 0, "-cell8").otherwise("")).alias("tag"), F.concat(1 + i % 16, F.lit("GB")).alias("size"))
    n = text.run_name("tag")
    c = c.withColumn("n", n).withColumn("bytes", text.size_bytes("size"))
    return c.select("c_custkey", "n.width", "n.bank", "n.epochs", "n.extra", text.pack_name(i % 100).alias("pack"), "bytes", text.human_size("bytes").alias("shown"))


# --- selection ---

GAP_SQL = """e AS (SELECT user_id, list(struct_pack(i := event_id, t := CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END) ORDER BY (event_id * 7919) % 1000003) AS l FROM events GROUP BY user_id),
w AS (SELECT user_id, list_reduce(list_prepend([struct_pack(i := CAST(-1 AS BIGINT), t := CAST(-1000000000 AS BIGINT))], list_transform(l, lambda s: [s])), lambda acc, x: CASE WHEN x[1].t IS NULL OR len(list_filter(acc, lambda k: abs(k.t - x[1].t) < 20000)) = 0 THEN list_concat(acc, x) ELSE acc END) AS kept FROM e)"""


@query("drive_gaps", f"WITH {GAP_SQL}, k AS (SELECT user_id, unnest(kept).i AS event_id FROM w) SELECT user_id, event_id FROM k WHERE event_id >= 0")
def drive_gaps(spark, sf_dir):
    """Shots of a drive (user) at least 20,000 s from every shot kept before, in a scrambled order of arrival; a shot without time is always kept."""
    t = F.when(F.col("event_id") % 29 != 0, F.unix_timestamp(F.col("ts").cast("timestamp")))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", t.alias("t"), ((F.col("event_id") * 7919) % 1000003).alias("arrival"))
    return select.drive_gaps(e, "user_id", "t", "arrival", 20000).where("kept").select("user_id", "event_id")


@query("quota_select")
def quota_select(spark, sf_dir):
    """At most 500 shots in order of arrival, 3 for each drive, 40 for each seed, an hour apart within a drive."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.hash("props") % 16).alias("seed"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return select.quota(e, "event_id", "user_id", "seed", "t", 500, 3, 40, 3600).select("event_id", "user_id", "seed")


@query("eligibility", "SELECT event_id, event_type <> 'error' AND (value = 0 OR value <= 20) AS ok FROM (SELECT event_id, event_type, CASE WHEN event_id % 10 = 0 THEN 99 ELSE value END AS value FROM events)".replace("(value = 0 OR value <= 20)", "(CASE WHEN value = 0 THEN 99 ELSE value END <= 20)"))
def eligibility(spark, sf_dir):
    """Candidates with a plane or unstated projection, a name, and a good enough position; a missing accuracy counts as 99."""
    e = table(spark, sf_dir, "events")
    projection = F.when(F.col("event_type") == "error", "SPHERE").when(F.col("event_type") == "view", "PLANE")
    accuracy = F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.col("value"))
    return e.select("event_id", select.eligible(projection, F.col("event_type"), accuracy, 20.0).alias("ok"))


@query("dedup_first", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def dedup_first(spark, sf_dir):
    """The first record of each id: an aggregate, so copies are combined before the shuffle."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("m"))
    return e.select("user_id", "m.event_id", "m.value")


@query("dedup_last", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("m"))
    return e.select("user_id", "m.event_id", "m.value")


@query("lru_evict", "WITH e AS (SELECT page_id AS id, length(html) AS bytes, (page_id * 7919) % 10007 AS used FROM pages), t AS (SELECT sum(bytes) AS total FROM e), b AS (SELECT e.*, coalesce(sum(bytes) OVER (ORDER BY used, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e) SELECT id, CAST(bytes AS BIGINT) AS bytes, total > 0.6 * total AND total - before > 0.9 * (0.6 * total) AS evicted FROM b, t")
def lru_evict(spark, sf_dir):
    """A cache of pages over its cap (60 % of their sizes): the longest unused go down to 90 % of the cap."""
    e = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.char_length("html").cast("long").alias("bytes"), ((F.col("page_id") * 7919) % 10007).alias("used"))
    cap = 0.6 * (e.agg(F.sum("bytes")).first()[0] or 0)
    return select.evict(e, "used", "bytes", cap).select("id", "bytes", "evicted")


@query("pack_assign", "WITH p AS (SELECT doc_id || '.jpg' AS name, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) SELECT name, lpad(CAST(3 + n // 64 AS VARCHAR), 4, '0') AS pack FROM p")
def pack_assign(spark, sf_dir):
    """Members numbered in order of their id, 64 to a pack, packs from 0003 on."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return select.packs(d, "id", 64, 3).select(F.concat("id", F.lit(".jpg")).alias("name"), text.pack_name("pack").alias("pack"))


@query("archive_members", "SELECT page_id, lpad(CAST(page_id % 7 AS VARCHAR), 2, '0') AS shard, CAST(page_id AS VARCHAR) AS id, page_id % 7 = 0 AS missing FROM pages")
def archive_members(spark, sf_dir):
    """Member paths taken apart, and those an archive lacks (here shard 00): a left join and a null check."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lpad((F.col("page_id") % 7).cast("string"), 2, "0"), F.lit("/"), "page_id", F.lit(".jpg")).alias("path"))
    have = p.select("path").where("not startswith(path, '00/')").withColumn("have", F.lit(True))
    m = text.member("path")
    return p.join(have, "path", "left").select("page_id", m["shard"].alias("shard"), m["id"].alias("id"), F.col("have").isNull().alias("missing"))


@query("labels_top_rank", "WITH f AS (SELECT c_mktsegment AS layer, c_custkey, c_name AS text, CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal) AS BIGINT) END AS rank FROM customer WHERE c_custkey % 10 > 0) SELECT layer, text, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY coalesce(rank, 1000000), c_custkey) AS place FROM f) WHERE place <= 5")
def labels_top_rank(spark, sf_dir):
    """Named features by prominence, five to a layer (the limit is the feature); a missing rank comes last, ties in source order, features without a name go."""
    c = table(spark, sf_dir, "customer")
    name, local = F.when(F.col("c_custkey") % 10 > 0, F.col("c_name")), F.lit(None).cast("string")
    f = c.select(F.col("c_mktsegment").alias("layer"), "c_custkey", F.coalesce(local, name).alias("text"), F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal")).alias("rank")).where("text is not null")
    order = Window.partitionBy("layer").orderBy(F.coalesce("rank", F.lit(1_000_000)), "c_custkey")
    return f.withColumn("place", F.row_number().over(order)).where("place <= 5").select("layer", "text", "place")


@query("labels_in_frame", "WITH l AS (SELECT event_id, (event_id * 37) % 640 AS x, (event_id * 91) % 560 AS y, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) SELECT event_id, CAST(x AS INT) AS px, CAST(y AS INT) AS py, CAST(((x + y) % 12) * 23 AS INT) AS class FROM l WHERE x < 512 AND y < 512 AND k IS NOT NULL")
def labels_in_frame(spark, sf_dir):
    """Labels decoded from JSON, anchors outside the tile dropped, and the class of the pixel under each anchor by an equi join."""
    schema = "array<struct<event_id:long,x:int,y:int,k:int>>"
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    doc = e.select(F.to_json(F.array(F.struct("event_id", ((F.col("event_id") * 37) % 640).cast("int").alias("x"), ((F.col("event_id") * 91) % 560).cast("int").alias("y"), F.col("p.k").alias("k")))).alias("labels"))
    labels = doc.select(F.explode(F.from_json("labels", schema)).alias("l")).select("l.*").where("x between 0 and 511 and y between 0 and 511 and k is not null")
    pixels = spark.range(512 * 512).select((F.col("id") % 512).cast("int").alias("x"), F.floor(F.col("id") / 512).cast("int").alias("y")).withColumn("class", (((F.col("x") + F.col("y")) % 12) * 23).cast("int"))
    return labels.join(pixels, ["x", "y"]).select("event_id", F.col("x").alias("px"), F.col("y").alias("py"), "class")


@query("stage_utilisation", "SELECT event_type AS stage, round(avg(value) FILTER (WHERE event_id % 13 > 0), 6) AS mean, max(value) FILTER (WHERE event_id % 13 > 0) AS peak, count(*) AS samples FROM events GROUP BY event_type")
def stage_utilisation(spark, sf_dir):
    """Mean and peak of a gauge by stage; -1 stands for a missing sample."""
    g = F.when(F.col("event_id") % 13 == 0, -1.0).otherwise(F.col("value"))
    e = table(spark, sf_dir, "events").select("event_type", F.nullif(g, F.lit(-1.0)).alias("g"))
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.round(F.avg("g"), 6).alias("mean"), F.max("g").alias("peak"), F.count("*").alias("samples"))


@query("log_last_attempt", "WITH m AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'signup') AS mark FROM events GROUP BY user_id) SELECT e.user_id, count(*) AS n, round(max(value), 2) AS most FROM events e JOIN m USING (user_id) WHERE e.event_id >= coalesce(mark, -1) GROUP BY e.user_id")
def log_last_attempt(spark, sf_dir):
    """Only what follows the last start marker of each run counts; a run without marker counts whole."""
    e = table(spark, sf_dir, "events")
    m = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("mark"))
    return e.join(m, "user_id").where(F.col("event_id") >= F.coalesce("mark", F.lit(-1))).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("most"))


@query("cohort_frozen", "SELECT doc_id, CAST(r AS INT) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('17:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 50")
def cohort_frozen(spark, sf_dir):
    """A seeded cohort of 50 (a sampling operator): the least hashes, so it can be drawn again anywhere."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.lit("17:"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(50)
    return d.select("doc_id", F.row_number().over(Window.orderBy("h", "doc_id")).alias("place"))


@query("most_common", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def most_common(spark, sf_dir):
    """The five most frequent sources: a top-n report."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


# --- sets, blocklists and joins of tables ---


@query("blocklist_merge", "WITH a AS (SELECT doc_id, 'toxic' AS why FROM labels WHERE toxic = 1), b AS (SELECT doc_id, 'junk' AS why FROM labels WHERE quality = 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.why, a.why) AS why FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def blocklist_merge(spark, sf_dir):
    """Two blocklists: all ids, the later detail wins."""
    l = table(spark, sf_dir, "labels")
    a, b = l.where("toxic = 1").select("doc_id", F.lit("toxic").alias("a")), l.where("quality = 0").select("doc_id", F.lit("junk").alias("b"))
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce("b", "a").alias("why"))


@query("blocklist_apply", "SELECT lang, count(*) AS kept FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang")
def blocklist_apply(spark, sf_dir):
    """Blocked ids go before anything is grouped."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("kept"))


@query("bank_rows_semi", f"WITH {CACHE_SQL} SELECT label, count(*) AS n FROM cache WHERE row_id IN (SELECT doc_id FROM labels) GROUP BY label")
def bank_rows_semi(spark, sf_dir):
    c = cache(spark, sf_dir).select("row_id", "label")
    return c.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id")), "row_id", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


@query("missing_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("lut_join", f"WITH {CACHE_SQL}, l AS (SELECT DISTINCT x16 >> 8 AS x, y16 >> 8 AS y FROM cache WHERE side = 'bank') SELECT c.row_id, l.x IS NOT NULL AS cached FROM cache c LEFT JOIN l ON l.x = c.x16 >> 8 AND l.y = c.y16 >> 8")
def lut_join(spark, sf_dir):
    """Each row's tile looked up in a cache by its packed key; a miss is null and would go to a live source."""
    c = cache(spark, sf_dir).select("row_id", "side", geo.tile_key(8, F.shiftright("x16", 8), F.shiftright("y16", 8)).alias("key"))
    lut = c.where("side = 'bank'").select("key").distinct().withColumn("have", F.lit(True))
    return c.join(lut, "key", "left").select("row_id", F.col("have").isNotNull().alias("cached"))


@query("seed_cache", f"WITH {CACHE_SQL}, t AS (SELECT row_id, x16 >> 8 AS x, y16 >> 8 AS y, side FROM cache), src AS (SELECT x, y, min(row_id) AS src FROM t WHERE side = 'bank' AND row_id % 5 > 0 GROUP BY ALL), dst AS (SELECT x, y, min(row_id) AS dst FROM t WHERE side = 'query' GROUP BY ALL) SELECT dst, src, src IS NULL AS todo FROM dst LEFT JOIN src USING (x, y)")
def seed_cache(spark, sf_dir):
    """A cache filled from another release where that one is done; the rest is the to-do list."""
    t = cache(spark, sf_dir).select("row_id", "side", F.shiftright("x16", 8).alias("x"), F.shiftright("y16", 8).alias("y"))
    src = t.where("side = 'bank' and row_id % 5 > 0").groupBy("x", "y").agg(F.min("row_id").alias("src"))
    dst = t.where("side = 'query'").groupBy("x", "y").agg(F.min("row_id").alias("dst"))
    return dst.join(src, ["x", "y"], "left").select("dst", "src", F.col("src").isNull().alias("todo"))


@query("batch_assembly", f"""WITH {KNN_SQL} SELECT c.row_id, round(c.px, 6) AS px, l.label AS region, list(k.row_id ORDER BY k.rank) AS neighbours FROM cache c JOIN knn k ON k.query_id = c.row_id JOIN (SELECT vec_id, label FROM embeddings) l ON l.vec_id = c.row_id GROUP BY ALL""")
def batch_assembly(spark, sf_dir):
    """Everything about one image in one row: its place, its region and its neighbours in order."""
    c = cache(spark, sf_dir).select("row_id", F.round("px", 6).alias("px"), F.col("label").alias("region"))
    n = knn(spark, sf_dir).groupBy(F.col("query_id").alias("row_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "row_id"))), lambda s: s["row_id"]).alias("neighbours"))
    return c.join(n, "row_id")


@query("corpora_sets", f"WITH {CACHE_SQL}, a AS (SELECT DISTINCT seq FROM cache WHERE side = 'bank'), b AS (SELECT DISTINCT seq FROM cache WHERE side = 'query') SELECT 'both' AS what, count(*) AS n FROM (SELECT seq FROM a INTERSECT SELECT seq FROM b) UNION ALL SELECT 'bank only', count(*) FROM (SELECT seq FROM a EXCEPT SELECT seq FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT seq FROM a UNION SELECT seq FROM b)")
def corpora_sets(spark, sf_dir):
    c = cache(spark, sf_dir)
    a, b = (c.where(F.col("side") == s).select("seq").distinct() for s in ("bank", "query"))
    parts = {"both": a.intersect(b), "bank only": a.subtract(b), "all": a.union(b).distinct()}
    out = None
    for what, d in parts.items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("arm_headline", f"WITH {ARMS_SQL}, r AS (SELECT 'first' AS arm, avg(CASE WHEN a < 4000 THEN 1.0 ELSE 0 END) AS hit, quantile_cont(a, 0.5) AS median, 'proven' AS state FROM arms UNION ALL SELECT 'best of three', avg(CASE WHEN b < 4000 THEN 1.0 ELSE 0 END), quantile_cont(b, 0.5), 'proven' FROM arms UNION ALL SELECT 'lost', 1.0, 0.0, 'missing') SELECT arm, round(hit, 9) AS hit, round(median, 5) AS median FROM r WHERE state = 'proven' ORDER BY hit DESC, arm LIMIT 1")
def arm_headline(spark, sf_dir):
    """The arm with the best hit rate among those that can be verified; arms whose tops tie within 0.005 go by their median."""
    a = arms(spark, sf_dir)
    rows = [a.agg(F.avg((F.col(c) < 4000).cast("double")).alias("hit"), F.percentile(c, 0.5).alias("median")).select(F.lit(n).alias("arm"), "hit", "median", F.lit("proven").alias("state")) for c, n in (("a", "first"), ("b", "best of three"))]
    lost = spark.range(1).select(F.lit("lost").alias("arm"), F.lit(1.0).alias("hit"), F.lit(0.0).alias("median"), F.lit("missing").alias("state"))
    known = rows[0].unionByName(rows[1]).unionByName(lost).where("state = 'proven'")
    top = F.max("hit").over(Window.partitionBy())
    near = known.withColumn("near", top - F.col("hit") <= 0.005).where("near")
    return near.orderBy("median", "arm").limit(1).select("arm", F.round("hit", 9).alias("hit"), F.round("median", 5).alias("median"))


# --- audits: each returns what breaks a rule ---


@query("audit_neighbours", f"""WITH {KNN_SQL}, broken AS (SELECT query_id, rank, CASE WHEN rank = 2 AND query_id % 5 = 0 THEN query_id WHEN rank = 3 AND query_id % 7 = 0 THEN query_id + 7 ELSE row_id END AS row_id FROM knn)
SELECT b.query_id, b.rank, b.row_id = b.query_id AS self, coalesce(c.seq = q.seq, FALSE) AS same_group, c.row_id IS NULL OR c.side <> 'bank' AS outside FROM broken b JOIN cache q ON q.row_id = b.query_id LEFT JOIN cache c ON c.row_id = b.row_id
WHERE b.row_id = b.query_id OR coalesce(c.seq = q.seq, FALSE) OR c.row_id IS NULL OR c.side <> 'bank'""")
def audit_neighbours(spark, sf_dir):
    """A neighbour table with planted faults: rows that match themselves, their own group, or lie outside the bank."""
    q = F.col("query_id")
    broken = knn(spark, sf_dir).select("query_id", "rank", F.when((F.col("rank") == 2) & (q % 5 == 0), q).when((F.col("rank") == 3) & (q % 7 == 0), q + 7).otherwise(F.col("row_id")).alias("row_id"))
    return neighbour_faults(broken, cache(spark, sf_dir))


def neighbour_faults(found, places):
    """query_id, rank, self, same_group, outside of every neighbour that breaks a rule; places has row_id, seq and side."""
    b = found.select("query_id", "rank", "row_id").join(places.select(F.col("row_id").alias("query_id"), F.col("seq").alias("qseq")), "query_id").join(places.select("row_id", "seq", "side"), "row_id", "left")
    out = b.select("query_id", "rank", (F.col("row_id") == F.col("query_id")).alias("self"), F.coalesce(F.col("seq") == F.col("qseq"), F.lit(False)).alias("same_group"), (F.col("side").isNull() | (F.col("side") != "bank")).alias("outside"))
    return out.where("self or same_group or outside")


@query("audit_bank_rows", "WITH b AS (SELECT event_id, event_id % 9000 - 3 AS row_id FROM events), n AS (SELECT count(*) AS n FROM labels) SELECT count(*) FILTER (WHERE row_id < 0) AS negative, count(*) FILTER (WHERE row_id >= n) AS beyond, count(*) - count(DISTINCT row_id) AS repeated FROM b, n")
def audit_bank_rows(spark, sf_dir):
    b = table(spark, sf_dir, "events").select((F.col("event_id") % 9000 - 3).alias("row_id"))
    n = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"))
    return b.crossJoin(F.broadcast(n)).agg(F.count_if(F.col("row_id") < 0).alias("negative"), F.count_if(F.col("row_id") >= F.col("n")).alias("beyond"), (F.count("*") - F.count_distinct("row_id")).alias("repeated"))


@query("audit_ineligible", f"WITH {CACHE_SQL}, held AS (SELECT DISTINCT (x16 >> 8) * 256 + (y16 >> 8) AS cell FROM cache WHERE side = 'query') SELECT row_id, 'not train' AS why FROM cache WHERE label < 5 AND side <> 'bank' UNION ALL SELECT row_id, 'held-out cell' FROM cache WHERE label >= 5 AND (x16 >> 8) * 256 + (y16 >> 8) IN (SELECT cell FROM held)")
def audit_ineligible(spark, sf_dir):
    """Bank rows that the split forbids: release rows outside the bank side, extension rows in held-out cells."""
    c = cache(spark, sf_dir).select("row_id", F.when(F.col("side") == "bank", "train").otherwise("test").alias("split"), F.when(F.col("label") < 5, "release").otherwise("extension").alias("origin"), geo.cell_id("x16", "y16", 8).alias("cell"), "side")
    return splits.ineligible(c, held=c.where("side = 'query'").select("cell"))


@query("audit_duplicate_ids", "WITH a AS (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM labels), c AS (SELECT id, count(*) AS n FROM a GROUP BY id) SELECT id, n FROM c WHERE n > 1")
def audit_duplicate_ids(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).unionByName(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    return a.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query("audit_masks", "SELECT o_orderpriority AS part, count(*) AS n, count(*) FILTER (WHERE m NOT IN (0, 1)) AS illegal, count(*) FILTER (WHERE m = 1) = count(*) AS complete FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 97 = 0 THEN 2 WHEN o_orderpriority LIKE '1%' THEN 1 ELSE o_orderkey % 2 END AS m FROM orders) GROUP BY ALL")
def audit_masks(spark, sf_dir):
    """Done masks: values other than 0 and 1, and whether all is done."""
    m = F.when(F.col("o_orderkey") % 97 == 0, 2).when(F.col("o_orderpriority").startswith("1"), 1).otherwise(F.col("o_orderkey") % 2)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), m.alias("m"))
    return o.groupBy("part").agg(F.count("*").alias("n"), F.count_if(~F.col("m").isin(0, 1)).alias("illegal"), (F.count_if(F.col("m") == 1) == F.count("*")).alias("complete"))


@query("audit_targets", f"WITH {CACHE_SQL}, t AS (SELECT row_id, count(*) AS n FROM cache, range(5) r(t) WHERE NOT (row_id % 50 = 0 AND t = 4) GROUP BY row_id) SELECT row_id, n FROM t WHERE n <> 5")
def audit_targets(spark, sf_dir):
    """Images that don't have their five target rows (planted: every fiftieth lacks its click)."""
    from .tiles import targets

    t = targets(cache(spark, sf_dir).select("row_id", "px", "py", "x16", "y16")).where("not (row_id % 50 = 0 and step = 4)")
    return t.groupBy("row_id").agg(F.count("*").alias("n")).where("n <> 5")


DIGEST_SQL = "b AS (SELECT doc_id // 64 AS block, substr(sha256('rows' || chr(0) || count(*) || chr(0) || string_agg(CAST(doc_id AS VARCHAR), chr(0) ORDER BY doc_id)), 1, 12) AS digest FROM documents GROUP BY ALL)"


@query("rows_digest", f"WITH {DIGEST_SQL} SELECT CAST(block AS BIGINT) AS block, digest FROM b")
def rows_digest(spark, sf_dir):
    """Digests of the ids in order, a block at a time, so no list outgrows a task; equal digests mean the same rows."""
    d = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 64).alias("block")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    parts = F.concat(F.array(F.lit("rows"), F.size("ids").cast("string")), F.col("ids").cast("array<string>"))
    return d.select("block", text.digest(parts).alias("digest"))


@query("digest_compare", "WITH d AS (SELECT doc_id // 64 AS block, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS a, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE doc_id <> 130) AS b FROM documents GROUP BY ALL) SELECT CAST(block AS BIGINT) AS block FROM d WHERE a IS DISTINCT FROM b")
def digest_compare(spark, sf_dir):
    """Blocks whose digests differ between a table and a copy that lacks one row."""
    def blocks(d, name):
        b = d.groupBy(F.floor(F.col("doc_id") / 64).alias("block")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
        return b.select("block", text.digest(F.col("ids").cast("array<string>")).alias(name))

    d = table(spark, sf_dir, "documents").select("doc_id")
    j = blocks(d, "a").join(blocks(d.where("doc_id <> 130"), "b"), "block", "full")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select("block")


@query("split_digest", f"WITH {SPLIT_SQL}, s AS (SELECT stratum, string_agg(split, chr(0) ORDER BY grp) AS whole, string_agg(substr(split, 1, 1), '' ORDER BY grp) AS legacy FROM assigned GROUP BY stratum) SELECT stratum, substr(sha256(whole), 1, 12) AS digest, substr(sha256(legacy), 1, 12) AS legacy FROM s")
def split_digest(spark, sf_dir):
    """Digests of the split labels of each stratum, and the legacy form that keeps first letters only and so can't tell train from test."""
    a = assigned(spark, sf_dir).groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("grp", "split"))).alias("l"))
    labels = F.transform("l", lambda s: s["split"])
    return a.select("stratum", text.digest(labels).alias("digest"), F.substring(F.sha2(F.array_join(F.transform(labels, lambda s: F.substring(s, 1, 1)), ""), 256), 1, 12).alias("legacy"))


@query("audit_comparable", f"WITH {CACHE_SQL}, a AS (SELECT country, count(*) AS n, min(row_id) AS lo, max(row_id) AS hi FROM cache WHERE side = 'bank' GROUP BY ALL), b AS (SELECT country, count(*) AS n, min(row_id) AS lo, max(row_id) AS hi FROM cache WHERE side = 'bank' AND row_id <> 3 GROUP BY ALL) SELECT a.country, a.n <> b.n AS size, a.lo <> b.lo OR a.hi <> b.hi AS rows FROM a JOIN b USING (country) WHERE a.n <> b.n OR a.lo <> b.lo OR a.hi <> b.hi")
def audit_comparable(spark, sf_dir):
    """Parts of two banks that can't be compared: other sizes or other rows."""
    def described(d):
        return d.groupBy("country").agg(F.count("*").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))

    c = cache(spark, sf_dir).where("side = 'bank'").select("country", "row_id")
    a, b = described(c).alias("a"), described(c.where("row_id <> 3")).alias("b")
    size, rows = F.col("a.n") != F.col("b.n"), (F.col("a.lo") != F.col("b.lo")) | (F.col("a.hi") != F.col("b.hi"))
    return a.join(b, F.col("a.country") == F.col("b.country")).where(size | rows).select("a.country", size.alias("size"), rows.alias("rows"))


@query("audit_zero_rows", f"WITH {CACHE_SQL} SELECT row_id FROM cache WHERE row_id % 61 = 0")
def audit_zero_rows(spark, sf_dir):
    """Vectors that failed to decode and would score as zeros (planted: every sixty-first)."""
    v = vectors.doubles("embedding")
    c = cache(spark, sf_dir).select("row_id", F.when(F.col("row_id") % 61 == 0, vectors.scale(v, 0.0)).otherwise(v).alias("v"))
    return c.where(vectors.is_zero(F.col("v"))).select("row_id")


@query("probe_rows", f"WITH {CACHE_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE row_id % 5 = 0) AS probed, CAST(0 AS BIGINT) AS zero, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS shape FROM cache")
def probe_rows(spark, sf_dir):
    """Shape of a vector table and whether evenly spaced rows hold anything."""
    c = cache(spark, sf_dir).select("row_id", vectors.doubles("embedding").alias("v"))
    probe = F.col("row_id") % 5 == 0
    return c.agg(F.count("*").alias("rows"), F.count_if(probe).alias("probed"), F.count_if(probe & vectors.is_zero(F.col("v"))).alias("zero"), ((F.min(F.size("v")) == 64) & (F.max(F.size("v")) == 64)).alias("shape"))


@query("cache_scan", "SELECT o_orderpriority AS dir, count(*) AS files, CAST(sum(o_custkey) AS BIGINT) AS bytes, count(*) FILTER (WHERE o_orderstatus = 'P') AS stale FROM orders GROUP BY ALL")
def cache_scan(spark, sf_dir):
    """A listing by folder: files, bytes, and leftovers to drop."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dir")).agg(F.count("*").alias("files"), F.sum("o_custkey").alias("bytes"), F.count_if(F.col("o_orderstatus") == "P").alias("stale"))


@query("attribution_vote", "WITH t AS (SELECT l_orderkey % 500 AS tile, abs(l_quantity - 25) AS a, abs(l_discount * 500 - 25) AS b FROM lineitem), e AS (SELECT tile, max(a) AS a, max(b) AS b FROM t GROUP BY tile) SELECT CASE WHEN a < b THEN 'a' WHEN b < a THEN 'b' ELSE 'tie' END AS renderer, count(*) AS tiles FROM e GROUP BY ALL")
def attribution_vote(spark, sf_dir):
    """Which of two renderers made each tile: the one with the smaller largest error; tiles on which both agree prove nothing."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("tile")).agg(F.max(F.abs(F.col("l_quantity") - 25)).alias("a"), F.max(F.abs(F.col("l_discount") * 500 - 25)).alias("b"))
    return t.groupBy(F.when(F.col("a") < F.col("b"), "a").when(F.col("b") < F.col("a"), "b").otherwise("tie").alias("renderer")).agg(F.count("*").alias("tiles"))


@query("train_test_gap", f"WITH {ARMS_SQL}, p AS (SELECT c.country, avg(CASE WHEN a < 4000 THEN 1.0 ELSE 0 END) AS train, avg(CASE WHEN b < 4000 THEN 1.0 ELSE 0 END) AS test FROM arms x JOIN cache c ON c.row_id = x.id GROUP BY ALL) SELECT country, round(train, 9) AS train, round(test, 9) AS test, round(train - test, 9) AS gap FROM p")
def train_test_gap(spark, sf_dir):
    p = arms(spark, sf_dir).join(cache(spark, sf_dir).select(F.col("row_id").alias("id"), "country"), "id")
    rate = [F.avg((F.col(c) < 4000).cast("double")) for c in "ab"]
    return p.groupBy("country").agg(F.round(rate[0], 9).alias("train"), F.round(rate[1], 9).alias("test"), F.round(rate[0] - rate[1], 9).alias("gap"))


@query("hit_batches", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS hits, count(DISTINCT user_id) AS keys FROM events GROUP BY ALL")
def hit_batches(spark, sf_dir):
    """Cache hits gathered in tumbling windows: how many, and how many distinct keys."""
    e = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("hits"), F.count_distinct("user_id").alias("keys"))
    return e.select(F.unix_timestamp("w.start").alias("hour"), "hits", "keys")
