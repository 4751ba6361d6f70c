"""Sources and sinks: CSV, Parquet globs, JSON lines, sidecars, archives and packs.

All paths go through Spark's readers, so they may lie in any store that Spark can open.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text


def write(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet under path, in folders by columns if any; either all of it is there afterwards or, as files are moved in on commit only, none."""
    out = df.write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def write_sidecar(df: DataFrame, path: str, key: str, **facts: str) -> None:
    """One JSON file under path that says which rows a table has: their number, a digest of their keys by blocks, and what else is given."""
    blocks = stamped(df, key)
    one = blocks.agg(F.sum("rows").alias("rows"), text.digest(F.transform(F.sort_array(F.collect_list(F.struct("block", "digest"))), lambda b: b["digest"])).alias("rows_digest"))
    one.select("rows", "rows_digest", *(F.lit(v).alias(k) for k, v in facts.items())).coalesce(1).write.mode("errorifexists").json(path)


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; give the schema where it is known, as inference reads the file once more."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def places(spark: SparkSession, path: str, wanted: DataFrame, schema: str = "id long, latitude double, longitude double, country string, sequence string") -> DataFrame:
    """Rows of a CSV with a position, for wanted ids (a frame with id): the filter goes to the scan, the join is Spark's to choose."""
    return csv(spark, path, schema).where("latitude is not null and longitude is not null").join(wanted.select("id").distinct(), "id")


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None, merge: bool = True) -> DataFrame:
    """Parquet files or globs, united by column name, only the columns asked for. Without merge, which reads every footer, the files have one schema."""
    df = spark.read.option("mergeSchema", merge).parquet(*paths)
    return df.select(*columns) if columns else df


def json_lines(spark: SparkSession, path: str, key: str = "id", keep: str = "last", schema: str | None = None) -> DataFrame:
    """One JSON object a line; lines that don't parse go; of lines with the same key the last (or first) counts.

    Order is that of a line in its file, and files go by name. Files are split like any text; Spark's row number
    within a task and the start of the task's stretch of the file, both from the reader, say where a line stands.
    """
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    raw = spark.read.text(path).select("value", F.struct(*(c.alias(n) for c, n in zip(place, ("file", "start", "line"), strict=True))).alias("place")).where(F.length(F.trim("value")) > 0)
    if schema is None:
        schema = spark.read.json(path).drop("_corrupt_record").schema
    rows = raw.withColumn("r", F.from_json("value", schema)).where(F.col("r").isNotNull() & F.col(f"r.{key}").isNotNull())
    pick_ = F.max_by if keep == "last" else F.min_by
    return rows.groupBy(F.col(f"r.{key}").alias("__key")).agg(pick_("r", "place").alias("r")).select("r.*")


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file and parsed content of JSON sidecars; content is null where a file is corrupt."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.withColumn("p", parsed).select("file", F.when(F.col("p._bad").isNull(), F.col("p").dropFields("_bad")).alias("content"))


def unzip(archives: DataFrame, names: list[str] | None = None) -> DataFrame:
    """archive, name, content of the zip members of archives (path, content), all or those named; an archive is opened by one task and its members stream out one by one."""
    wanted = set(names) if names is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir() and (wanted is None or info.filename in wanted):
                            yield pa.RecordBatch.from_pydict({"archive": [place], "name": [info.filename], "content": [z.read(info)]})

    return archives.select("path", "content").mapInArrow(run, "archive string, name string, content binary")


def archive(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """unzip() of all archives under a path; each is one binary cell, so at most 2 GB."""
    return unzip(spark.read.format("binaryFile").load(path), names)


def pick(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name, pos) with content from the first archive that has the member; null where none has."""
    one = found.groupBy("name").agg(F.min_by("content", "archive").alias("content"))
    return wanted.join(one, "name", "left")


def members(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (name, pos) with content, in an order given by pos; content is null for a member no archive has."""
    return pick(archive(spark, path), wanted)


def missing(wanted: DataFrame) -> DataFrame:
    """Members that members() found nowhere."""
    return wanted.where(F.col("content").isNull()).select("name")


def write_packs(files: DataFrame, path: str) -> None:
    """files (name, content, pack) as zip bytes, one row for each pack, as Parquet partitioned by pack. A pack is bounded by the size packs() was given."""

    def build(rows: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in sorted(zip(rows.column("name").to_pylist(), rows.column("content").to_pylist(), strict=True)):
                z.writestr(zipfile.ZipInfo(name), content)
        return pa.table({"pack": pa.array([rows.column("pack")[0].as_py()], pa.int32()), "blob": pa.array([out.getvalue()], pa.binary())})

    files.select("name", "content", F.col("pack").cast("int").alias("pack")).groupBy("pack").applyInArrow(build, "pack int, blob binary").write.mode("errorifexists").parquet(path)


def pack_faults(files: DataFrame, packs: DataFrame) -> DataFrame:
    """Files that packs (blob) lack or hold with other bytes; only with none may originals go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for n in z.namelist():
                        yield pa.RecordBatch.from_pydict({"name": [n], "packed": [z.read(n)]})

    have = packs.select("blob").mapInArrow(run, "name string, packed binary").select("name", F.sha2("packed", 256).alias("digest"))
    return files.select("name", F.sha2("content", 256).alias("digest")).join(have, ["name", "digest"], "left_anti").select("name")


def last_attempt(spark: SparkSession, path: str, marker: str, pattern: str) -> DataFrame:
    """file and all matches of a pattern in what follows the last marker of each log."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    tail = F.element_at(F.split("value", marker), -1)
    return raw.select("file", F.regexp_extract_all(tail, F.lit(pattern), F.lit(1)).alias("matches"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """dir, files, bytes and stale (leftover .tmp) files under a folder, from the file listing alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return f.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("path").endswith(".tmp")).alias("stale"))


def stamped(df: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """block, rows, digest of a table's keys in order: what a sidecar keeps to recognise it."""
    n = df.select(F.col(key).alias("k"), F.floor(F.col(key) / block).alias("block"))
    return n.groupBy("block").agg(F.count("*").alias("rows"), text.digest(F.sort_array(F.collect_list("k")).cast("array<string>")).alias("digest"))
