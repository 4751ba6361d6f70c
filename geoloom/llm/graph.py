"""Connected components by alternating small-star and large-star steps over frames.

Links are never collected: each round is a few shuffles of (child, parent) rows, written to the shared
checkpoint folder, and rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("child", "parent")), F.sum(F.xxhash64("parent", "child").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that links reach) of every node with a link to another."""
    x, y = F.col(a), F.col(b)
    now = cut(links.where(x != y).select(F.greatest(x, y).alias("child"), F.least(x, y).alias("parent")).distinct())
    before = _state(now)
    while before[0]:
        least = F.min("parent").over(Window.partitionBy("child"))
        small = now.withColumn("least", least).select(
            F.explode(F.array(F.struct("child", F.col("least").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("least").alias("parent")))).alias("l")
        )
        small = small.select("l.child", "l.parent").where("child > parent").distinct()
        # A parent that is itself a child gives way to its own least parent. Many children may share a parent: its side has one row for each.
        up = small.groupBy("child").agg(F.min("parent").alias("top")).withColumnRenamed("child", "parent")
        now = cut(small.join(up, "parent", "left").select("child", F.coalesce("top", "parent").alias("parent")).distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    found = now.groupBy("child").agg(F.min("parent").alias("component"))
    roots = found.select("component").distinct()
    return found.select(F.col("child").alias("node"), "component").unionByName(roots.select(F.col("component").alias("node"), "component"))
