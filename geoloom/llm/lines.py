"""Removal of repeated line runs.

A document is the sequence of its lines that aren't blank (blank: spaces only); a line's id is its 128-bit hash. Suffixes of all
sequences are ranked by distributed prefix doubling: a suffix's rank at depth 2d comes from its rank at depth d and that of the
suffix d lines on, by a range-partitioned sort of the distinct pairs with running sums, so a rank is a place in the suffix array and the
suffixes of equal rank are a longest-common-prefix interval. Doubling stops at depth `min_lines`: a run of lines is repeated if an
interval of that depth holds a start of it, and the maximal repeated runs are what such starts cover together.
In each interval the first place (least id, then line) keeps its lines; lines covered from any other place go, judged on the input.

Only pairs and counts are sorted, so a line that a third of all documents hold is one row there; the join back to places is left to
Spark's skew handling, and an interval's first place is found in salted parts. Null texts stay null and empty texts empty; equal rows (same id and text) count once and get equal results; a document of
fewer than min_lines lines stays as it is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import NULL_ID, arrow_map, cut, fresh

MIN_LINES = 2


def places(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """key, h, i, line (its place in the text), rank (the line's id) and next (the id of the line after it) of every line that isn't blank."""
    split = F.split(F.col(text), "\n", -1)
    kept = F.filter(F.transform(split, lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("blank"), x.alias("x"))), lambda s: s["blank"] != "")
    ids = F.transform(kept, lambda s: F.struct(s["line"].alias("line"), F.unhex(F.md5(s["x"])).alias("rank")))
    # The array is bound once; a lambda would compute it again for each element.
    pairs = F.get(F.transform(F.array(ids), lambda a: F.arrays_zip(a.alias("s"), F.slice(a, 2, F.greatest(F.size(a), F.lit(0))).alias("n"))), F.lit(0))
    named = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(F.col(text)).alias("h"), F.posexplode(pairs).alias("i", "p"))
    return named.select("key", "h", "i", "p.s.line", "p.s.rank", F.col("p.n.rank").alias("next"))


def ranked(pairs: DataFrame) -> DataFrame:
    """Distinct (rank, ahead, n) rows with place: how many suffixes come before them. Offsets between partitions are the only thing that meets."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = cut(pairs.repartitionByRange(n, "rank", "ahead").withColumn("part", F.spark_partition_id()))
    # One row for each partition.
    sums = ordered.groupBy("part").agg(F.sum("n").alias("sum"))
    offsets = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("offset"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("rank", "ahead")) - F.col("n")
    return ordered.withColumn("within", within).join(F.broadcast(offsets), "part").select("rank", "ahead", "n", (F.col("offset") + F.col("within")).alias("place"))


def intervals(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """key, h, i, rank and n of every suffix of min_lines lines or more: n suffixes share its first min_lines lines."""
    t = places(docs, text, doc_id).select("key", "h", "i", "rank", F.col("next" if min_lines > 1 else "rank").alias("ahead"))
    depth = min(2, min_lines)
    while True:
        t = t.where("ahead is not null")
        pairs = t.groupBy("rank", "ahead").agg(F.count("*").alias("n"))
        t = t.join(ranked(pairs), ["rank", "ahead"]).select("key", "h", "i", F.col("place").alias("rank"), "n")
        if depth >= min_lines:
            return t
        step = min(depth, min_lines - depth)
        # Equal rows hold equal places once.
        t = cut(t.dropDuplicates(["key", "h", "i"]).drop("n"))
        t = t.withColumn("ahead", F.lead("rank", step).over(Window.partitionBy("key", "h").orderBy("i")))
        depth += step


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """key, h and removed: the numbers of the lines (as in places().i) that later copies of runs cover."""
    place = F.struct("key", "h", "i")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    some = intervals(docs, min_lines, text, doc_id).where("n > 1").select("key", "h", "i", "rank")
    # First within a salted part of an interval, then among the firsts of the parts, so that no interval meets in one task.
    salted = Window.partitionBy("rank", F.pmod(F.xxhash64("key", "h", "i"), F.lit(n)))
    parts = cut(some.withColumn("first", F.min(place).over(salted)))
    heads = parts.where(place == F.col("first")).withColumn("first", F.min(place).over(Window.partitionBy("rank")))
    later = parts.where(place != F.col("first")).unionByName(heads.where(place != F.col("first")))
    lines = later.select("key", "h", F.explode(F.sequence(F.col("i"), F.col("i") + min_lines - 1)).alias("i"))
    return lines.groupBy("key", "h").agg(F.sort_array(F.collect_set("i")).alias("removed"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, its text without the repeated lines, and n_lines, n_removed (of lines that aren't blank) and n_runs behind its columns; columns of docs by those names are replaced."""
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    gone = repeated_lines(docs, min_lines, text, doc_id)
    key, h, gone_ = (fresh(docs, x) for x in ("key", "h", "removed"))
    named = docs.select("*", F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias(key), F.xxhash64(F.col(text)).alias(h))
    joined = named.join(gone.select(F.col("key").alias(key), F.col("h").alias(h), F.col("removed").alias(gone_)), [key, h], "left").select(*docs.columns, gone_)
    names = docs.columns
    at = names.index(text)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        out, counts = [], []
        for t, removed in zip(rows.column(at).to_pylist(), rows.column(len(names)).to_pylist(), strict=True):
            lines = (t or "").split("\n")
            real = [i for i, x in enumerate(lines) if x.strip(" ")]
            removed = removed or []
            runs = sum(i == 0 or removed[i - 1] + 1 != r for i, r in enumerate(removed))
            counts.append((len(real), len(removed), runs))
            if removed:
                drop = {real[i] for i in removed}
                t = "\n".join(x for i, x in enumerate(lines) if i not in drop)
            out.append(t)
        cols = [c if i != at else pa.array(out, pa.string()) for i, c in enumerate(rows.columns[: len(names)])]
        cols += [pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else ([], [], []))]
        return pa.RecordBatch.from_arrays(cols, names=[*names, "n_lines", "n_removed", "n_runs"])

    schema = StructType([*docs.schema.fields])
    for n in ("n_lines", "n_removed", "n_runs"):
        schema = schema.add(n, "long")
    return arrow_map(joined, run, schema)
