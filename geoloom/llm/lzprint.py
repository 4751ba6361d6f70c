"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each the shortest stretch not yet in its
dictionary); the fingerprint is the K least 32-bit hashes of the phrase set, so
two fingerprints estimate the phrase sets' Jaccard likeness, as a compressor would see it.

follow() also compares each document with an edited text that ends in the start of the next
document. Documents are dealt out once, by stretches of their order, whose bounds are quantiles of a bounded sample of names, so ids may lie
as they like and one id may have many rows; the first document of a stretch
goes to the stretch before it as well, so every successor is at hand without a second shuffle.
An empty or null text has the empty fingerprint; two empty fingerprints have likeness 1, an
empty and another 0. Rows with equal ids follow each other by text hash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bucket_count, documents, sliced

K = 64
#: Stretches of the order of documents at most, and names of documents (a sample by hash) that their bounds are taken from, or twice that.
BINS = 1 << 12
SAMPLE = 1 << 15


class Parse:
    """The phrases of a text, which may go on with one of several tails."""

    def __init__(self, text: str) -> None:
        self.phrases: set[str] = set()
        self.rest = ""
        self.hashes = self._feed(text)

    def _feed(self, text: str) -> list[int]:
        known, p, new = self.phrases, self.rest, []
        for c in text:
            p += c
            if p not in known:
                known.add(p)
                new.append(p)
                p = ""
        self.rest = p
        self.new = new
        return list(map(xxhash.xxh32_intdigest, new))

    def sketch_with(self, tail: str) -> bytes:
        """The fingerprint of the text and this tail; the parse is then as before."""
        rest = self.rest
        hashes = self.hashes + self._feed(tail)
        self.phrases.difference_update(self.new)
        self.rest = rest
        return least(hashes)


def least(hashes: list[int]) -> bytes:
    return np.array(sorted(set(hashes))[:K], "<u4").tobytes()


def fingerprint(text: str) -> bytes:
    return Parse(text).sketch_with("")


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard likeness of two phrase sets, exact for sets of at most K phrases."""
    x, y = (set(np.frombuffer(v, "<u4").tolist()) for v in (a, b))
    if not x and not y:
        return 1.0
    # Beyond its K-th value a full fingerprint says nothing, so only the K least of both count.
    both = sorted(x | y)[:K]
    return sum(v in x and v in y for v in both) / len(both)


def shown(sketch: bytes) -> str:
    return base64.b64encode(sketch).decode()


def sketches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint of every row, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches):
            prints = [shown(fingerprint(t)) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, fingerprint string")


def stretches(d: DataFrame, wanted: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """d with its stretch of the order by (key, h), and (stretch, key, h) of each one's first row. The driver sees SAMPLE names and a row for each stretch at most."""
    rows = d.count()
    every = max(1, -(-rows // SAMPLE))
    taken = d.select("key", "h").where(F.pmod(F.xxhash64("h", "key"), F.lit(every)) == 0).distinct().orderBy(F.xxhash64("key", "h")).limit(2 * SAMPLE).collect()
    names = sorted((r.key, r.h) for r in taken)
    bounds = sorted({names[k * len(names) // wanted] for k in range(1, wanted)}) if names else []
    keys, hashes = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def place(key: pd.Series, h: pd.Series) -> pd.Series:
        """How many bounds aren't behind (key, h): only these two columns travel."""
        k, t = key.to_numpy(), h.to_numpy()
        at, behind = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for i in np.flatnonzero(behind > at):  # bounds inside one id
            at[i] += np.searchsorted(hashes[at[i] : behind[i]], t[i], "right")
        return pd.Series(at.astype(np.int32))

    placed = d.withColumn("part", place("key", "h") if bounds else F.lit(0))
    heads = placed.groupBy("part").agg(F.min(F.struct("key", "h")).alias("m")).select("part", "m.key", "m.h").collect()
    return placed, sorted((r.part, r.key, r.h) for r in heads)


def follow(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = documents(docs, text, doc_id)
    wanted = min(BINS, 8 * bucket_count(docs, 64 << 20))
    d, heads = stretches(d, wanted)
    # Where the first document of each stretch goes a second time: behind the end of the stretch before (the first one's, behind the last).
    parts = [p for p, _, _ in heads] or [0]
    before = dict(zip(parts, [parts[-1], *parts[:-1]], strict=True))
    again = d.sparkSession.createDataFrame([(key, h, before[p]) for p, key, h in heads], "key long, h long, there int")
    here = F.struct(F.col("part").alias("at"), F.lit(0).alias("tail"))
    there = F.struct(F.col("there").alias("at"), F.lit(1).alias("tail"))
    dealt = (
        d.join(F.broadcast(again), ["key", "h"], "left")  # a row for each stretch, of which there are BINS at most
        .withColumn("to", F.explode(F.when(F.col("there").isNotNull(), F.array(here, there)).otherwise(F.array(here))))
        .select(F.col("to.at").alias("at"), F.col("to.tail").alias("tail"), "key", "h", "doc_id", "text")
        .repartition(F.col("at"))
        .sortWithinPartitions("at", "tail", "key", "h")
    )
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor: stretch, id, text, parse of what stays, fingerprint
        for rows in sliced(batches):
            out = []
            for at, tail, id_, t in zip(*(rows.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True):
                cut = len(t) - len(t) // 4
                parse = print_ = None
                if not tail:
                    parse = Parse(t[:cut])
                    print_ = parse.sketch_with(t[cut:])
                if held is not None and held[0] == at:
                    print_ = fingerprint(t) if print_ is None else print_
                    end = t[: len(held[2]) // 4]
                    edited = held[3].sketch_with(end)
                    whole = held[2][: len(held[2]) - len(held[2]) // 4] + end
                    out.append((held[1], len(held[2]), hashlib.sha256(whole.encode()).hexdigest(), shown(held[4]), shown(edited), likeness(held[4], edited), likeness(held[4], print_)))
                held = None if tail else (at, id_, t, parse, print_)
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, schema)
