"""Numeric matrices in .npy and .npz files as rows, and a sink that goes on where a run stopped.

Files come as (path, content) rows, from Spark's binaryFile reader or from a table; a file is one task's, up to the 2 GB a binary cell
may have. A larger .npy file that every executor can open by its path is read in blocks of rows, each by a task of its own.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, member string, row long, v array<double>"
#: Rows of a matrix that leave a task at once.
BLOCK = 4096


def _batches(path: str, member: str, m: np.ndarray, start: int = 0) -> Iterator[pa.RecordBatch]:
    m = m.reshape(len(m), -1) if m.ndim else m.reshape(1, 1)
    for at in range(0, len(m), BLOCK):
        part = np.ascontiguousarray(m[at : at + BLOCK], dtype=np.float64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([member] * n), pa.array(np.arange(n) + start + at), lists], names=["path", "member", "row", "v"])


def rows(files: DataFrame) -> DataFrame:
    """path, member (of an .npz; empty for .npy), row and v of every matrix in files (path, content). Pickled objects are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if content[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            yield from _batches(path, name.removesuffix(".npy"), np.load(io.BytesIO(z.read(name)), allow_pickle=False))
                else:
                    yield from _batches(path, "", np.load(io.BytesIO(content), allow_pickle=False))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def npy(spark: SparkSession, path: str) -> DataFrame:
    """rows() of all files under a path or glob that Spark can read."""
    return rows(spark.read.format("binaryFile").load(path))


def mapped(spark: SparkSession, path: str, n: int, block: int = 1 << 16) -> DataFrame:
    """rows() of one .npy file with n rows on storage that every executor has mounted, read through a memory map, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield from _batches(path, "", np.load(path, mmap_mode="r", allow_pickle=False)[k * block : (k + 1) * block], k * block)

    blocks = -(-n // block)
    return spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(run, SCHEMA)


def npy_bytes(matrix: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, matrix, allow_pickle=False)
    return out.getvalue()


def _if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def done(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys that a run has marked as done under path."""
    return _if_there(spark, f"{path}/mask", f"{key} long").select(key)


def resume(df: DataFrame, path: str, key: str, mark: bool = True) -> None:
    """Append the rows of df that aren't marked, then mark them: a run that dies between leaves rows that the next one writes again.

    Both appends are atomic by Spark's commit protocol; rows carry the number of their run, and read_resumed takes a key's rows from the last run
    only. One run at a time.
    """
    spark = df.sparkSession
    before = _if_there(spark, f"{path}/data", "run int").agg(F.max("run")).first()[0]
    run = 0 if before is None else before + 1
    new = df.join(done(spark, path, key), key, "left_anti")
    new.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{path}/data")
    if mark:
        spark.read.parquet(f"{path}/data").where(F.col("run") == run).select(key).write.mode("append").parquet(f"{path}/mask")


def read_resumed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows written under path whose keys are marked, one for each key."""
    data = spark.read.parquet(f"{path}/data").join(done(spark, path, key).distinct(), key, "left_semi")
    rest = [c for c in data.columns if c not in (key, "run")]
    return data.groupBy(key).agg(F.max_by(F.struct(*rest), "run").alias("r")).select(key, "r.*")
