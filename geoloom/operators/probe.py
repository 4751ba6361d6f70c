"""Linear probes: how much a frozen vector says about a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def linear(rows: DataFrame, vector: str, label: str, train: str, rounds: int = 30, ridge: float = 1e-3) -> DataFrame:
    """One row: train and val accuracy of a multinomial logistic model fitted where `train` holds. Gradients are summed by tree over partitions."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = rows.select(array_to_vector(vectors.doubles(vector)).alias("features"), F.col(label).cast("double").alias("label"), F.col(train).alias("train"))
    model = LogisticRegression(maxIter=rounds, regParam=ridge, family="multinomial").fit(x.where("train"))
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return model.transform(x).agg(F.avg(F.when(F.col("train"), hit)).alias("train"), F.avg(F.when(~F.col("train"), hit)).alias("val"), F.count("*").alias("n"))
