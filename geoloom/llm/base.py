"""Shared plumbing of the training-data operators: sizing, checkpoints, Arrow rows.

Conventions used by every operator here:

* a null text is an empty text; a null id sorts before every other id;
* columns besides those an operator names are ignored, whatever they are called;
* rows that share an id are told apart by a hash of their text, so equal rows get
  equal results and nothing is multiplied by a join.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null id inside an operator: it sorts first.
NULL_ID = -(1 << 63)
#: Bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; in local mode, where one machine has it all, fall back to a fresh one."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(place or tempfile.mkdtemp(prefix="geoloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size; for a file scan, the size of its files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0  # no estimate


def bucket_count(df: DataFrame, per_bucket: int = 8 << 20) -> int:
    """Buckets so that each holds about per_bucket bytes of df, never fewer than shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, min(1 << 20, -(-input_bytes(df) // per_bucket)))


def names_of(text: str = "text", doc_id: str = "doc_id") -> tuple[Column, Column]:
    """key and h of a row."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs hasn't."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """key, h, doc_id and text of every row; (key, h) names a document, key orders them."""
    key, h = names_of(text, doc_id)
    return docs.select(
        key.alias("key"),
        h.alias("h"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over bounded slices of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back to the system: workers outlive tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most about limit bytes; a row larger than that comes alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.nbytes <= limit or n == 1:
            yield batch
            continue
        weight = np.zeros(n)
        for col in batch.columns:
            if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type):
                weight += np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
            else:
                weight += col.nbytes / n
        total = np.cumsum(weight)
        at = 0
        while at < n:
            base = total[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column on end, and the offsets of its rows (one more than rows)."""
    col = pa.compute.fill_null(col, "") if col.null_count else col
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def batch(schema: dict[str, pa.DataType], **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema[n]) for n, c in ((n, cols[n]) for n in schema)], names=list(schema))

