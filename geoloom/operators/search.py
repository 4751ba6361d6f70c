"""Exact and two-stage nearest neighbours with group exclusion.

topk: queries are cut into blocks of bounded bytes. Where all of them fit in BROADCAST bytes (checked by a count) they
travel to the bank's tasks; each task keeps a running top k, so the bank is read once, nothing of it is shuffled, and only
k rows for each query and task meet. Beyond that size, blocks of queries meet blocks of the bank in a shuffle, and the same merge follows.
Ties go to the lower row id. Scores are dot products in double precision; normalise first for cosines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors

BROADCAST = 64 << 20
#: Rows of a block of queries, and of a batch of the bank, that one product scores.
BLOCK = 2048
SCHEMA = "query_id long, row_id long, sim double"


def _matrix(col: pa.Array) -> np.ndarray:
    values = pc.list_flatten(col).to_numpy(zero_copy_only=False)
    return values.reshape(len(col), -1).astype(np.float64)


class _Best:
    """The best k of each query so far."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, groups: list, k: int) -> None:
        self.ids, self.vecs, self.k = ids, vecs, k
        self.groups = np.array(groups, dtype=object)
        self.row = np.full((len(ids), 0), -1, np.int64)
        self.sim = np.full((len(ids), 0), -np.inf)

    def add(self, row: np.ndarray, vec: np.ndarray, groups: list) -> None:
        codes = {g: i for i, g in enumerate(dict.fromkeys(self.groups.tolist()))}
        mine = np.array([codes[g] for g in self.groups.tolist()])
        theirs = np.array([codes.get(g, -1) for g in groups])
        sim = self.vecs @ vec.T
        sim[mine[:, None] == theirs[None, :]] = -np.inf
        row = np.concatenate([self.row, np.broadcast_to(row, sim.shape)], axis=1)
        sim = np.concatenate([self.sim, sim], axis=1)
        if sim.shape[1] > self.k:
            # Everything that could still tie with the k-th stays until the order by row decides.
            floor = -np.partition(-sim, self.k - 1, axis=1)[:, self.k - 1]
            sure = np.where(sim >= floor[:, None], sim, -np.inf)
            order = np.lexsort((row, -sure), axis=1)[:, : self.k]
            row, sim = np.take_along_axis(row, order, axis=1), np.take_along_axis(sim, order, axis=1)
        self.row, self.sim = row, sim

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.sim))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.row[i, j]), pa.array(self.sim[i, j])], names=["query_id", "row_id", "sim"])


def _shaped(df: DataFrame, vector: str, group: str | None) -> DataFrame:
    """row_id, v and g of the rows that have a vector: null, empty ones and those with null or not-a-number in them find nothing and are found by nothing."""
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    usable = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    return df.select("row_id", vectors.doubles(vector).alias("v"), g.alias("g")).where(F.col("v").isNotNull() & usable)


def _groups(col: pa.Array, side: str) -> list:
    """Group values; a missing group is a group of its own, alike on both sides only where groups are compared."""
    return [f"{side}:" if g is None else f"={g}" for g in col.to_pylist()]


def topk(queries: DataFrame, bank: DataFrame, k: int, vector: str = "embedding", exclude: str | None = None, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """query_id, rank (from 1), row_id, sim: the k best rows of bank for each query, none of the query's own group.

    Both sides have row_id and the vector; exclude names a column of both. Null groups differ from every group but
    another null, which they equal. Rows without a vector, and those of another length than most queries', take no part.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    side = "n"
    q, b = _shaped(queries, vector, exclude), _shaped(bank, vector, exclude)
    grouped = exclude is not None
    lengths = q.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return q.select(F.col("row_id").alias("query_id"), F.lit(1).alias("rank"), "row_id", F.lit(0.0).alias("sim"))
    first, n = lengths[0], lengths[0].n
    q, b = q.where(F.size("v") == first.d), b.where(F.size("v") == first.d)

    def merge(best: _Best, batches: Iterator[pa.RecordBatch]) -> None:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                groups = _groups(part.column(2), side) if grouped else [None] * part.num_rows
                best.add(part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1)), groups if grouped else ["b"] * part.num_rows)

    if n * (8 * first.d + 64) <= broadcast_bytes:
        rows = q.toArrow().combine_chunks()
        ids = rows.column(0).to_numpy()
        vecs = _matrix(rows.column(1).combine_chunks())
        groups = _groups(rows.column(2), side) if grouped else ["q"] * len(ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [_Best(ids[i : i + BLOCK], vecs[i : i + BLOCK], groups[i : i + BLOCK], k) for i in range(0, len(ids), BLOCK)]
            for batch in batches:
                for best in blocks:
                    merge(best, iter([batch]))
            for best in blocks:
                yield best.rows()

        found = b.mapInArrow(run, SCHEMA)
    else:
        size = max(1, broadcast_bytes // (8 * first.d + 64))
        q_blocks, b_blocks = -(-n // size), max(1, -(-bank.count() // size))
        left = q.withColumn("qb", F.pmod(F.xxhash64("row_id"), F.lit(q_blocks))).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(b_blocks - 1))))
        # Under names of their own: both sides of a cogroup must not share a column.
        right = b.select(F.col("row_id").alias("rb"), F.col("v").alias("w"), F.col("g").alias("h"), F.pmod(F.xxhash64("row_id"), F.lit(b_blocks)).alias("bb"))
        right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        kind = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("sim", pa.float64())])

        def meet(_: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
            mine = mine.combine_chunks()
            if not mine.num_rows or not theirs.num_rows:
                return pa.Table.from_batches([], kind)
            groups = _groups(mine.column("g"), side) if grouped else ["q"] * mine.num_rows
            best = _Best(mine.column("row_id").to_numpy(), _matrix(mine.column("v").combine_chunks()), groups, k)
            merge(best, iter(theirs.select(["rb", "w", "h"]).to_batches()))
            return pa.Table.from_batches([best.rows()])

        keys = ["qb", "bb"]
        found = left.withColumn("bb", F.col("bb").cast("long")).groupBy(*keys).cogroup(right.withColumn("qb", F.col("qb").cast("long")).groupBy(*keys)).applyInArrow(meet, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "sim")


def shortlist(queries: DataFrame, bank: DataFrame, k: int, dim: int = 128, probe: int = 128, vector: str = "embedding", exclude: str | None = None) -> DataFrame:
    """Two stages: the best max(probe, k) by the first dim components renormalised, then the best k of those by whole vectors."""

    def short(df: DataFrame) -> DataFrame:
        return df.withColumn(vector, vectors.normalise(vectors.truncate(vectors.doubles(vector), dim)))

    found = topk(short(queries), short(bank), max(probe, k), vector, exclude)
    q = queries.select(F.col("row_id").alias("query_id"), vectors.doubles(vector).alias("qv"))
    b = bank.select("row_id", vectors.doubles(vector).alias("bv"))
    scored = found.select("query_id", "row_id").join(q, "query_id").join(b, "row_id").select("query_id", "row_id", vectors.dot(F.col("qv"), F.col("bv")).alias("sim"))
    return ranked(scored, "query_id", F.desc("sim"), F.col("row_id")).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "sim")


def ranked(df: DataFrame, by: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def short_of(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries with fewer than k legal neighbours: an exact search should refuse to go on with any."""
    have = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select(F.col("row_id").alias("query_id")).join(have, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact top k that found has, and of queries whose best row agrees."""
    a = exact.where(F.col("rank") <= k).select("query_id", "row_id", F.col("rank").alias("want"))
    b = found.where(F.col("rank") <= k).select("query_id", "row_id", F.col("rank").alias("got"))
    j = a.join(b, ["query_id", "row_id"], "left")
    first = F.when(F.col("want") == 1, (F.coalesce("got", F.lit(0)) == 1).cast("double"))
    return j.agg(F.avg(F.col("got").isNotNull().cast("double")).alias("recall"), F.avg(first).alias("top1"))


def merge_round_robin(found: DataFrame, photos: DataFrame, k: int, calibrate: bool = True) -> DataFrame:
    """group, slot (from 1), row_id, score: candidates of a group's photographs by rank and then photograph, each row once, the best k.

    photos has query_id, group and place (order within the group). Scores lose their photograph's best where calibrate. Groups with fewer
    rows than k repeat the last at -10000, a score that no softmax notices.
    """
    c = found.join(photos, "query_id")
    top = F.max("sim").over(Window.partitionBy("query_id"))
    c = c.withColumn("score", F.col("sim") - (top if calibrate else F.lit(0.0)))
    one = c.groupBy("group", "row_id").agg(F.min(F.struct("rank", "place", "score")).alias("m"))
    order = Window.partitionBy("group").orderBy("m.rank", "m.place", "row_id")
    slots = one.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= k).select("group", "slot", "row_id", F.col("m.score").alias("score"))
    last = slots.groupBy("group").agg(F.max(F.struct("slot", "row_id")).alias("l"))
    pads = last.where(F.col("l.slot") < k).select("group", F.explode(F.sequence(F.col("l.slot") + 1, F.lit(k))).alias("slot"), F.col("l.row_id").alias("row_id"), F.lit(-1e4).alias("score"))
    return slots.unionByName(pads)


def merge_global(found: DataFrame, photos: DataFrame, k: int, calibrate: bool = True) -> DataFrame:
    """group, slot, row_id, score: the k best of all candidates, repeats included."""
    c = found.join(photos, "query_id")
    top = F.max("sim").over(Window.partitionBy("query_id"))
    c = c.withColumn("score", F.col("sim") - (top if calibrate else F.lit(0.0)))
    order = Window.partitionBy("group").orderBy(F.desc("score"), "row_id", "place")
    return c.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= k).select("group", "slot", "row_id", "score")
