"""Which harvested records count: filters, seeds drawn in a fixed order, and quotas that only a success uses up."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .areas import connected
from .order import cut
from .select import Gaps


def accept(records: DataFrame, id_: str, arrival: str, quality: Column, least: float, panorama: Column, geometry: Column, keep_panoramas: bool = False) -> DataFrame:
    """records with place (the geometry, first of those given that is there): no panoramas, good enough (no quality is 0), placed; of one id the first such record by arrival."""
    ok = F.coalesce(quality, F.lit(0.0)) >= least
    if not keep_panoramas:
        ok &= ~F.coalesce(panorama, F.lit(False))
    good = records.withColumn("place", geometry).where(ok & F.col("place").isNotNull())
    names = good.columns
    return good.groupBy(id_).agg(F.min_by(F.struct(*names), arrival).alias("r")).select("r.*")


def wide_enough(records: DataFrame, width: str, height: str, least: int) -> DataFrame:
    """Records whose shorter side has at least so many pixels; unknown sides don't."""
    return records.where(F.when(F.col(width).isNotNull() & F.col(height).isNotNull(), F.least(width, height) >= least).otherwise(False))


def seeds(pool: DataFrame, id_: str, n: int, skip: int = 0, seed: int = 17) -> DataFrame:
    """The n rows behind the first skip ones of a permutation that only the seed and the ids decide, so that a later run visits others."""
    return pool.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string"))), id_).offset(skip).limit(n)


def quota_rounds(rows: DataFrame, arrival: str, sequence: str, seed: str, time: str, success: str, budget: int, per_sequence: int, per_seed: int, gap: float, rounds: int = 3) -> DataFrame:
    """The rows that succeed, with round: each round walks untried rows in order of arrival under caps for sequences and seeds and a time
    gap, up to what the budget leaves; all it picks are tried, and only those with `success` count against caps and gaps in the next one.

    Caps couple sequences with the seeds they share and nothing else, so each connected set of them is walked by itself; the
    budget takes the first picks by arrival. Gaps count only where a sequence may give more than one row.
    """
    named = rows.withColumns({"__s": F.xxhash64(F.lit("sequence"), F.col(sequence).cast("string")), "__d": F.xxhash64(F.lit("seed"), F.col(seed).cast("string"))})
    area = connected(named.select(F.col("__s").alias("a"), F.col("__d").alias("b")).distinct()).withColumnsRenamed({"node": "__s", "component": "__area"})
    names = rows.columns
    at = [names.index(c) + 2 for c in (sequence, seed, time)]
    # state: 0 untried, otherwise the round it was tried in, negative if it failed
    now = cut(named.join(area, "__s").select("__area", F.lit(0).alias("__state"), *names))
    left = budget
    for number in range(1, rounds + 1):
        if left <= 0:
            break

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = object()
            for b in batches:
                take = []
                for i, (area_, state, s, d, t) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, *at)), strict=True)):
                    if area_ != here:
                        here, in_seq, in_seed, gaps = area_, defaultdict(int), defaultdict(int), defaultdict(lambda: Gaps(gap))
                    if not state and (in_seq[s] >= per_sequence or in_seed[d] >= per_seed or (per_sequence > 1 and not gaps[s].free(t))):
                        continue
                    if per_sequence > 1:
                        gaps[s].keep(t)
                    in_seq[s] += 1
                    in_seed[d] += 1
                    if not state:
                        take.append(i)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(take, pa.int32())) for c in b.columns], names=b.schema.names)

        # Rows kept before come first, whatever their arrival; failed ones are out.
        live = now.where("__state >= 0").repartition("__area").sortWithinPartitions("__area", (F.col("__state") == 0), arrival)
        picked = live.mapInArrow(walk, now.schema).orderBy(arrival).limit(left).select(F.col(arrival).alias("__arrival"), F.lit(number).alias("__round"))
        tried = F.when(F.col("__round").isNull(), F.col("__state")).otherwise(F.when(F.col(success), F.col("__round")).otherwise(-F.col("__round")))
        # At most the budget's rows.
        now = cut(now.join(picked, F.col(arrival) == F.col("__arrival"), "left").select("__area", tried.alias("__state"), *names))
        n = now.agg(F.count_if(F.col("__state") > 0), F.count_if(F.abs("__state") == number)).first()
        left = budget - n[0]
        if not n[1]:
            break
    return now.where("__state > 0").select(*names, F.col("__state").alias("round"))


def lookups(events: DataFrame, key: str, time: str, written: Column, ttl: float, touch: float) -> DataFrame:
    """events (of a cache, in seconds) that read, with fresh (an entry was written for the key at most ttl before) and flight: misses of a key in one
    stretch of touch seconds are one render. By a running window over each key's times; nothing is gathered.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(written, F.col(time))).over(before)
    marked = events.withColumn("last", last).where(~written)
    fresh = F.coalesce(F.col(time) - F.col("last") <= ttl, F.lit(False))
    return marked.withColumn("fresh", fresh).withColumn("flight", F.when(~F.col("fresh"), F.floor(F.col(time) / touch)))
