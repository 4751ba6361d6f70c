"""Running sums and row numbers over a global order, without bringing all rows to one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh one only in local mode, where none is set."""
    sc = spark.sparkContext._jsc.sc()
    if not sc.getCheckpointDir().isDefined():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(place or tempfile.mkdtemp(prefix="geoloom-"))
    return sc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows that come before in the order.

    Rows are sorted within range partitions, which are written down once; the only thing that meets is one sum for each partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = cut(df.withColumn("__v", value).repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    sums = placed.groupBy("__p").agg(F.sum("__v").alias("__s"))
    offsets = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__o"))
    within = F.sum("__v").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__v")
    return placed.withColumn("__w", within).join(F.broadcast(offsets), "__p").select(*df.columns, (F.col("__w") + F.col("__o")).alias(name))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with row numbers from 0 in the order, which should leave no ties."""
    return running(df, order, F.lit(1).cast("long"), name)
