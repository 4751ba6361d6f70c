"""Structured Streaming: windowed counts, duplicates, time gaps, running neighbours.

The surveyed system has stateful selection but no stream engine; windows, sessions and watermarks are additions of this one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.select import Gaps


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark are dropped by Spark, as streams must end somewhere."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if e.isStreaming else e
    return e.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if e.isStreaming else e
    return e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.unix_timestamp("w.start").alias("start"), "n")


def first_of_each(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows without repeats of keys; in a stream, within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def gap_filter(events: DataFrame, drive: str, time: str, arrival: str, gap: float, name: str | None = None) -> DataFrame:
    """drive and arrival of kept rows, as select.drive_gaps keeps them, over a stream: the state of a drive is its kept times.

    name, the number of a row, comes along if given; rows that arrive together are then taken by it. Spark hands a drive's rows
    of a batch over in pieces and in no order, so those (three or four numbers a row) are held until all of them are there.
    """
    names = [drive, arrival] + ([name] if name else [])
    none = f"__{drive}_none"  # a null among long numbers would make pandas round them all to doubles

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gaps = Gaps(gap, list(state.get[0]) if state.exists else [])
        f = pd.concat(frames, ignore_index=True)
        order = np.lexsort([f[c].to_numpy() for c in reversed(names[1:])])
        keep = []
        for i, t in zip(order, f[time].to_numpy()[order], strict=True):
            t = None if np.isnan(t) else float(t)
            if gaps.free(t):
                gaps.keep(t)
                keep.append(i)
        if keep:
            yield f.loc[keep, [none, *names]]
        state.update((gaps.times,))

    schema = f"{none} boolean, " + ", ".join(f"{c} long" for c in names)
    rows = events.select(F.col(drive).isNull().alias(none), F.col(time).cast("double").alias(time), *(F.col(c).cast("long").alias(c) for c in names)).fillna(0, [drive])
    kept = rows.groupBy(none, drive).applyInPandasWithState(step, schema, "times array<double>", "append", GroupStateTimeout.NoTimeout)
    return kept.select(F.when(~F.col(none), F.col(drive)).cast(events.schema[drive].dataType).alias(drive), *names[1:])


def merge_topk(best: DataFrame | None, new: DataFrame, k: int) -> DataFrame:
    """The best k of each query so far: the fold of a foreachBatch sink. best and new have query_id, row_id, sim."""
    both = new if best is None else best.unionByName(new)
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "row_id")
    return both.dropDuplicates(["query_id", "row_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
