"""Principal components from distributed sums: one pass, d x d numbers from each task, no rows on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def fit(rows: DataFrame, k: int, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the k leading directions as columns, each with its largest component positive."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = pc.list_flatten(b.column(0)).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"part": [0], "n": [n], "v": [np.concatenate([s, ss.ravel()]).tolist()]}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("v", pa.list_(pa.float64()))]))

    parts = rows.select(vectors.doubles(vector).alias("v")).where(F.col("v").isNotNull()).mapInArrow(sums, "part int, n long, v array<double>")
    # Sums are added up across tasks place by place, so the driver gets one row for each place.
    total = parts.select("n", F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    if not total:
        raise ValueError("no row has a vector, so there are no directions")
    n = total[0].n
    flat = np.array([r.x for r in total])
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    mean = flat[:d] / n
    value, axes = np.linalg.eigh(flat[d:].reshape(d, d) / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-value)[:k]]
    return mean, axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


def project(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, vector: str = "embedding", name: str = "projected") -> DataFrame:
    """rows with (v - mean) times the axes, by array expressions; the axes are d x k literals."""
    centred = F.zip_with(vectors.doubles(vector), F.lit(mean.tolist()), lambda a, b: a - b)
    return rows.withColumn("__c", centred).withColumn(name, F.array(*(vectors.dot(F.col("__c"), F.lit(axes[:, j].tolist())) for j in range(axes.shape[1])))).drop("__c")
