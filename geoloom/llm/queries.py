"""The registered queries of the training-data operators, one op<N>_<name> for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lines, lzprint, packing, pivots, quality, secrets, setjoin, substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near(table(spark, sf_dir, "embeddings"), 0.95)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.bytes_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.follow(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar(table(spark, sf_dir, "documents"), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op6_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.words_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Runs of two lines or more that occur earlier; the kept lines joined again.
OP8_SQL = r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
flat AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM raw),
real AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM flat WHERE trim(line) <> ''),
runs AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM real),
placed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, i) AS k FROM runs WHERE nxt IS NOT NULL),
gone AS (SELECT doc_id, i FROM placed WHERE k > 1 UNION SELECT doc_id, i + 1 FROM placed WHERE k > 1),
marked AS (SELECT f.doc_id, f.pos, f.line, r.i, g.i IS NOT NULL AS removed
  FROM flat f LEFT JOIN real r ON f.doc_id = r.doc_id AND f.pos = r.pos LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.i = r.i),
heads AS (SELECT g.doc_id, count(*) AS n FROM gone g LEFT JOIN gone p ON p.doc_id = g.doc_id AND p.i = g.i - 1 WHERE p.i IS NULL GROUP BY g.doc_id)
SELECT m.doc_id, CAST(count(m.i) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE m.removed) AS BIGINT) AS n_removed,
  CAST(coalesce(any_value(h.n), 0) AS BIGINT) AS n_runs,
  sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.removed), '')) AS kept_sha256
FROM marked m LEFT JOIN heads h ON h.doc_id = m.doc_id GROUP BY m.doc_id
"""


#: Cosines of all pairs, and what links reach.
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(c.component_id AS BIGINT) AS component_id, c.component_id = v.vec_id AS kept FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""

#: Bytes as pairs of hexadecimal digits, from stretches of 200 with 100 more behind them; a window is known by its md5. A byte goes if a window that came before starts at most 99 bytes ahead of it.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
k AS (SELECT doc_id, n, k, substr(x, 400 * k + 1, 600) AS x FROM (SELECT doc_id, n, x, unnest(range((n + 199) // 200)) AS k FROM d)),
p AS (SELECT doc_id, n, k, unnest(range(least(200, n - 200 * k))) AS j, x FROM k), b AS (SELECT doc_id, n, 200 * k + j AS i, substr(x, 2 * j + 1, 2) AS b, CASE WHEN 200 * k + j + 100 <= n THEN md5(substr(x, 2 * j + 1, 200)) END AS w FROM p),
r AS (SELECT doc_id, n, i, b, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM b),
c AS (SELECT doc_id, n, i, b, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 100, false) AS gone FROM r),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
o AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

#: Shingles as words with spaces between them, of which no word has any; documents that share one are counted.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_ WHERE 100 * k >= 90 * (nx + ny - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, CAST(min(r.y) AS BIGINT) AS component_id FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id
"""

#: A window is known by the md5 of its words; a word goes if a window that an earlier document has starts at most 49 words ahead of it.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), b AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i : i + 49], ' ')) END AS g FROM p),
r AS (SELECT doc_id, i, word, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM b),
c AS (SELECT doc_id, i, word, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 50, false) AS gone FROM r),
o AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_near": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op5_jaccard_join": OP5_SQL, "op6_super_kmers": OP6_SQL, "op8_line_runs": OP8_SQL}
