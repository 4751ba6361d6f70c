"""Near-duplicate vectors by a pivot-permutation index.

Equal vectors are one, with a weight. Pivots are reference vectors from a bounded sample, no two of them alike. A vector is described by its LISTED nearest
pivots in order. Each pivot has an inverted list of the vectors that name it; two vectors are compared if they share
SHARED pivots or more, in the list of the first pivot they share, so each pair is verified once, by cosine in double precision.
A list over BLOCK vectors is split by the second shared pivot; what is still over BLOCK then (many vectors around one place) is dealt out as pairs of
sub-lists. Pairs stay inside the task that verifies them: out come counts for each vector and links that join up what the task has found.

Broadcast: the pivots, PIVOTS at most, and the sizes of their lists. Vectors that are null, zero or hold null or non-finite components link with
nothing but stay in the result. Each length has pivots and lists of its own. Rows are told apart by id and vector, vectors by two 64-bit
hashes: rows that share both share their links and count once, and rows that share an id only have links of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import NULL_ID, cut
from .graph import components

PIVOTS = 4096
LISTED = 8
SHARED = 2
BLOCK = 2048
#: Parts that the rows of one vector are dealt into.
SALTS = 16
#: Rows for each pivot, while that gives fewer than PIVOTS.
ROWS_PER_PIVOT = 32
#: Pivots closer than this are one.
APART = 0.6


def choose_pivots(sample: np.ndarray, apart: float = APART) -> np.ndarray:
    """Sampled unit vectors, each less than apart alike to all before it."""
    left = np.ones(len(sample), bool)
    out = []
    for i in range(len(sample)):
        if left[i]:
            out.append(i)
            left &= sample @ sample[i] < apart
    return sample[out]


def usable(vector: str):
    """Whether a vector has a direction."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def near(vectors: DataFrame, least: float = 0.95, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NULL_ID)).alias("key"), F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    good = rows.where(usable("v"))
    sizes = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()
    ids = F.when(F.col("key") != NULL_ID, F.col("key"))
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), ids.alias("component_id"), F.lit(True).alias("kept"))

    def shares(v, by):
        """v over by(v), which is computed once and not for each element."""
        return F.get(F.transform(F.array(by(v)), lambda n: F.transform(v, lambda x: x / n)), F.lit(0))

    # Scaled first, so that neither huge nor tiny components overflow the norm.
    unit = good.select("key", "h", "h2", shares(F.col("v"), lambda v: F.array_max(F.transform(v, F.abs))).alias("v"))
    unit = unit.select("key", "h", "h2", shares(F.col("v"), lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))).alias("v"))
    # Equal rows once, then equal vectors once under their least id; both are combined before they travel.
    same = unit.groupBy("h", "h2", "key").agg(F.first("v").alias("v")).groupBy("h", "h2").agg(F.min("key").alias("key"), F.count("*").alias("weight"), F.first("v").alias("v"))
    unit = cut(same)
    #: For each length its pivots, and the number of its first one.
    books: dict[int, tuple[np.ndarray, int]] = {}
    at = 0
    for dim, n in sizes:
        wanted = max(16, min(PIVOTS, n // ROWS_PER_PIVOT))
        sample = unit.where(F.size("v") == dim).orderBy(F.xxhash64("key"), "key", "h").limit(wanted).collect()
        books[dim] = choose_pivots(np.array([r.v for r in sample])), at
        at += len(books[dim][0])
    floor = least

    def matrix(col: pa.Array) -> np.ndarray:
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)

    def describe(batches):
        """A row for each pivot a vector names, with all it names."""
        for b in batches:
            dims = pa.compute.list_value_length(b.column(2))
            for dim in dims.unique().to_pylist():
                pivots, base = books[dim]
                m = len(pivots)
                listed = min(LISTED, m)
                same = b.filter(pa.compute.equal(dims, dim))
                for at in range(0, same.num_rows, 2048):
                    part = same.slice(at, 2048)
                    like = matrix(part.column(2)) @ pivots.T
                    best = np.argpartition(-like, listed - 1, axis=1)[:, :listed] if listed < m else np.argsort(-like, axis=1)
                    order = np.take_along_axis(like, best, axis=1).argsort(axis=1)[:, ::-1]
                    best = np.take_along_axis(best, order, axis=1).astype(np.int32)
                    where = pa.array(np.repeat(np.arange(part.num_rows), listed))
                    names = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * listed, pa.int32()), pa.array(best.ravel() + np.int32(base)))
                    cols = [part.column(k).take(where) for k in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.array(best.ravel() + np.int32(base)), *cols, names.take(where)], names=["pivot", "key", "h", "v", "weight", "names"])

    postings = unit.select("key", "h", "v", "weight").mapInArrow(describe, "pivot int, key long, h long, v array<double>, weight long, names array<int>")
    # The size of each list: as many rows as pivots, which is bounded, so it is broadcast.
    length = F.broadcast(cut(postings.groupBy("pivot").agg(F.count("*").alias("n"))))
    listed_ = postings.join(length, "pivot")
    # Of a long list every pair that counts shares a further pivot, and is compared where the second one is at hand.
    further = F.filter("names", lambda q: q > F.col("pivot"))
    seconds = F.when((F.col("n") <= BLOCK) | (F.size("names") < SHARED), F.array(F.lit(-1))).otherwise(further)
    listed_ = listed_.withColumn("second", F.explode(seconds)).drop("n")
    crowded = listed_.groupBy("pivot", "second").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    subs = crowded.select("pivot", "second", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("some"))
    listed_ = listed_.join(cut(subs), ["pivot", "second"], "left").withColumn("subs", F.coalesce("some", F.lit(1))).drop("some")
    sub = F.pmod(F.xxhash64("key", "h"), F.col("subs")).cast("int")
    both = F.when(F.col("subs") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.expr("transform(sequence(0, subs - 1), s -> struct(least(s, sub) as x, greatest(s, sub) as y))")
    )
    dealt = listed_.withColumn("sub", sub).withColumn("pair", F.explode(both)).select("pivot", "second", "pair", "sub", "key", "h", "v", "weight", "names")

    def verify(rows: pa.Table) -> pa.Table:
        """In one list, or a pair of its sub-lists: links whose first shared pivot (and second, where the list is split) this is."""
        rows = rows.sort_by([("key", "ascending"), ("h", "ascending")]).combine_chunks()
        pair = rows.column("pair")[0].as_py()
        key, h, side, weight = (rows.column(c).to_numpy() for c in ("key", "h", "sub", "weight"))
        v, names = matrix(rows.column("v")), matrix(rows.column("names"))
        pivots, base = books[v.shape[1]]
        m, pivot, second = len(pivots), rows.column("pivot")[0].as_py() - base, rows.column("second")[0].as_py()
        names = names - base
        shared = min(SHARED, LISTED, m)
        n = len(key)
        degree = np.zeros(n, np.int64)
        root = np.arange(n)
        step = 512
        member = np.zeros((n, m), np.float32)
        member[np.arange(n)[:, None], names] = 1
        # Pivots that the two may not share.
        earlier = member[:, : pivot if second < 0 else second - base].copy()
        if second >= 0:
            earlier[:, pivot] = 0
        apart = pair["x"] != pair["y"]
        for a in range(0, n, step):
            like = v[a : a + step] @ v.T
            hit = like >= floor
            if earlier.shape[1]:
                hit &= (earlier[a : a + step] @ earlier.T) == 0
            if shared > 1 and second < 0:
                hit &= (member[a : a + step] @ member.T) >= shared
            if apart:  # the pairs inside a sub-list belong to the task that has it twice
                hit &= side[a : a + step, None] != side[None, :]
            hit[np.arange(len(hit)), np.arange(a, a + len(hit))] = False
            degree[a : a + step] += hit @ weight
            # Each row joins the least row it links with; a few rounds over all rows settle the rest below.
            x, y = np.nonzero(hit)
            join_up(root, x + a, y)
        links = root != np.arange(n)
        out = np.flatnonzero((degree > 0) | links)
        to = root[out]
        return pa.table({"key": pa.array(key[out]), "h": pa.array(h[out]), "n": pa.array(degree[out]), "to": pa.array(key[to]), "to_h": pa.array(h[to])})

    found = cut(dealt.groupBy("pivot", "second", "pair").applyInArrow(verify, "key long, h long, n long, to long, to_h long"))
    degree = found.groupBy("key", "h").agg(F.sum("n").alias("n_links"))
    # Nodes are in the order of their ids, so a component's least node has its least id.
    links = found.select(F.struct("key", "h").alias("a"), F.struct(F.col("to").alias("key"), F.col("to_h").alias("h")).alias("b")).where("a != b")
    joined = components(links).select("node.key", "node.h", F.col("component.key").alias("component"))
    # Back to the rows, by vector: a vector that many rows have is there for each salt, so that none of them has to meet all.
    whole = unit.select("key", "h", "h2", "weight").join(degree, ["key", "h"], "left").join(joined, ["key", "h"], "left")
    salted = whole.select("h", "h2", (F.col("weight") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    component = F.coalesce("component", "key")
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["h", "h2", "salt"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(component != NULL_ID, component).alias("component_id"), (component == F.col("key")).alias("kept"))
    )


def join_up(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the trees of x and y, in place; each tree's root is its least row and all rows point at it afterwards."""
    while len(x):
        a, b = root[x], root[y]
        other = a != b
        if not other.any():
            return
        x, y, a, b = x[other], y[other], a[other], b[other]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
