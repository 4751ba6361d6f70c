"""Holding whole groups out, and the audits that prove it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value: each group's most frequent value, the smallest of those that tie."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    # Of equal counts the least value: the first in the order (-n, value).
    return n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(group, F.col("m.v").alias(value))


def hashed_order(seed: int, *parts: Column | str) -> Column:
    """A shuffled order that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def assign(rows: DataFrame, group: str, stratum: str, seed: int = 17, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """group, split: groups of each stratum in hashed order; one goes to train while the share placed before it is
    under train, then to val, then to test. A group's stratum is its majority value, so no group spans splits.

    The running sum goes over groups of a stratum, not rows.
    """
    size = rows.groupBy(group).agg(F.count("*").alias("n"))
    g = size.join(majority(rows, group, stratum), group)
    order = Window.partitionBy(stratum).orderBy(hashed_order(seed, group), group).rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("n").over(order), F.lit(0)) / F.sum("n").over(Window.partitionBy(stratum))
    split = F.when(share < train, "train").when(share < train + val, "val").otherwise("test")
    return g.select(group, F.col(stratum), "n", split.alias("split"))


def spans(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where(F.col("splits") > 1)


def overlap(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """a, b, shared: distinct keys that two splits have in common."""
    k = rows.select(key, split).distinct()
    a, b = k.select(key, F.col(split).alias("a")), k.select(key, F.col(split).alias("b"))
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def ineligible(bank: DataFrame, split: str = "split", origin: str = "origin", cell: str = "cell", held: DataFrame | None = None) -> DataFrame:
    """Bank rows that a split forbids: release rows outside train, extension rows in a held-out cell."""
    wrong = bank.where((F.col(origin) == "release") & ~F.col(split).eqNullSafe(F.lit("train"))).select("row_id", F.lit("not train").alias("why"))
    if held is None:
        return wrong
    leak = bank.where(F.col(origin) == "extension").join(held.select(cell).distinct(), cell, "left_semi")
    return wrong.unionByName(leak.select("row_id", F.lit("held-out cell").alias("why")))
