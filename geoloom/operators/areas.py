"""Connected components over frames, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import cut


def connected(links: DataFrame) -> DataFrame:
    """node, component (its least node) for links (a, b); a link to itself names a lone node.

    Every round each node takes the least label among its neighbours, and then that label's own label, so the rounds grow with the logarithm of the longest path.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        spread = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(spread, "a").select("a", F.least("label", "l").alias("label"))
        jump = step.join(step.select(F.col("a").alias("label"), F.col("label").alias("up")), "label", "left").select("a", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = cut(jump)
        moved = new.join(labels.withColumnRenamed("label", "old"), "a").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
