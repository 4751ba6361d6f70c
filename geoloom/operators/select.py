"""Stateful selection: time gaps within a drive, quotas, caches."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .areas import connected
from .order import running


class Gaps:
    """Kept times of one drive; a time is free if it is at least gap from all of them. Null times are free and not kept."""

    def __init__(self, gap: float, times: list[float] | None = None) -> None:
        self.gap = gap
        self.times = sorted(times or [])

    def free(self, t: float | None) -> bool:
        if t is None:
            return True
        at = bisect_left(self.times, t)
        # Sorted, so only the two neighbours can be too near.
        return all(abs(t - self.times[i]) >= self.gap for i in (at - 1, at) if 0 <= i < len(self.times))

    def keep(self, t: float | None) -> None:
        if t is not None:
            insort(self.times, t)


def drive_gaps(rows: DataFrame, drive: str, time: str, arrival: str, gap: float) -> DataFrame:
    """rows with kept: greedy in order of arrival, a row is kept if its time is at least gap from every kept one of its drive.

    Rows stream through in order of (drive, arrival); only a drive's kept times are held.
    """
    names = rows.columns
    at = [names.index(c) for c in (drive, time)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gaps = object(), Gaps(gap)
        for b in batches:
            kept = []
            for d, t in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist(), strict=True):
                if d != now:
                    now, gaps = d, Gaps(gap)
                ok = gaps.free(t)
                if ok:
                    gaps.keep(t)
                kept.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept)], names=[*names, "kept"])

    from pyspark.sql.types import StructType

    schema = StructType([*rows.schema.fields]).add("kept", "boolean")
    return rows.repartition(drive).sortWithinPartitions(drive, arrival).mapInArrow(run, schema)


def eligible(projection: Column, name: Column, accuracy: Column, most: float) -> Column:
    """Plane or unstated projection, a name, and a position accuracy of at most `most`; an accuracy that is missing, empty or 0 counts as 99, one that can't be read as too bad."""
    a = accuracy.cast("string")
    read = F.when(a.isNull() | (a == "") | (a.try_cast("double") == 0), F.lit(99.0)).otherwise(a.try_cast("double"))
    plane = F.coalesce(F.nullif(projection, F.lit("")), F.lit("PLANE")) == "PLANE"
    return F.coalesce(plane & (F.coalesce(F.length(name), F.lit(0)) > 0) & (read <= most), F.lit(False))


def quota(rows: DataFrame, arrival: str, sequence: str, seed: str, time: str, budget: int, per_sequence: int, per_seed: int, gap: float) -> DataFrame:
    """The rows that a walk in order of arrival selects under a cap for each sequence and each seed, a time gap within sequences, and a budget.

    Caps couple sequences with the seeds they share, and nothing else couples: each connected set of sequences and seeds is walked by
    itself, and the budget then takes the first by arrival. Gaps count only where a sequence may give more than one row.
    """
    named = rows.withColumns({"__s": F.xxhash64(F.lit("sequence"), F.col(sequence).cast("string")), "__d": F.xxhash64(F.lit("seed"), F.col(seed).cast("string"))})
    area = connected(named.select(F.col("__s").alias("a"), F.col("__d").alias("b")).distinct()).withColumnsRenamed({"node": "__s", "component": "__area"})
    names = rows.columns
    order = [F.col("__area"), F.col(arrival)]
    placed = named.join(area, "__s").repartition("__area").sortWithinPartitions(*order).select("__area", *names)
    at = [names.index(c) + 1 for c in (sequence, seed, time)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = object()
        for b in batches:
            take = []
            for i, (area_, s, d, t) in enumerate(zip(b.column(0).to_pylist(), *(b.column(k).to_pylist() for k in at), strict=True)):
                if area_ != now:
                    now, in_seq, in_seed, gaps = area_, defaultdict(int), defaultdict(int), defaultdict(lambda: Gaps(gap))
                if in_seq[s] >= per_sequence or in_seed[d] >= per_seed or (per_sequence > 1 and not gaps[s].free(t)):
                    continue
                if per_sequence > 1:
                    gaps[s].keep(t)
                in_seq[s] += 1
                in_seed[d] += 1
                take.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(take, pa.int32())) for c in b.columns[1:]], names=names)

    return placed.mapInArrow(run, rows.schema).orderBy(arrival).limit(budget)


def evict(entries: DataFrame, used: str, size: str, cap: float, low: float = 0.9) -> DataFrame:
    """entries with evicted: over cap, the longest unused go while the total is above low * cap. Ties go by id."""
    total = entries.agg(F.sum(size).alias("__total"))
    before = running(entries, [F.col(used), F.col("id")], F.col(size), "__before")
    left = F.col("__total") - F.col("__before")
    return before.crossJoin(F.broadcast(total)).withColumn("evicted", (F.col("__total") > cap) & (left > low * cap)).drop("__before", "__total")


def packs(ids: DataFrame, id_: str, size: int, start: int = 0) -> DataFrame:
    """ids with pack: numeric ids in order of their number, others behind them by text, size to a pack from start on."""
    number = F.col(id_).try_cast("long")
    placed = running(ids, [number.isNull(), number, F.col(id_)], F.lit(1).cast("long"), "__n")
    return placed.withColumn("pack", (F.floor(F.col("__n") / size) + start).cast("int")).drop("__n")


def frozen(ids: DataFrame, id_: str, n: int, path: str, seed: int = 17) -> DataFrame:
    """A cohort of the n least hashes of (seed, id), written to path the first time and replayed from there ever after; ids that have gone since are refused."""
    spark = ids.sparkSession
    try:
        have = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        ids.select(id_).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string"))), id_).limit(n).write.parquet(path)
        have = spark.read.parquet(path)
    gone = have.join(ids.select(id_), id_, "left_anti").limit(1).collect()
    if gone:
        raise ValueError(f"the frozen cohort names {gone[0][0]}, which the table no longer holds")
    return have
