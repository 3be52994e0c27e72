"""Finding versions: the listing of a directory, formats by magic bytes, what is new or changed."""

from __future__ import annotations

import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import not_transient, sniff, version_id
from ..operators.store import first_version_wins

_FILES = "path string, name string, length long, modified string, head binary"


def list_directory(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length, modified (ISO, nanoseconds kept as text) and the first 8 bytes of each regular file. The driver
    lists, so that names which Spark's file index hides are seen; contents are read by path in tasks."""
    rows = []
    for e in sorted(os.scandir(folder), key=lambda e: e.path):
        if e.is_file():
            s = e.stat()
            at = datetime.fromtimestamp(s.st_mtime_ns // 10**9, UTC).strftime("%Y-%m-%dT%H:%M:%S")
            with open(e.path, "rb") as f:
                rows.append((e.path, e.name, s.st_size, f"{at}.{s.st_mtime_ns % 10**9:09d}Z", f.read(8)))
    return spark.createDataFrame(rows, _FILES)


def candidates(files: DataFrame) -> DataFrame:
    """Archives among files (path, name, length, head): id, format and rank; rank 1 is the version, the others collide."""
    f = files.filter(not_transient(F.col("name"))).withColumn("format", sniff(F.col("head"), F.col("length"))).filter("format IS NOT NULL")
    return first_version_wins(f.withColumn("id", version_id(F.col("name"))))


def pending(files: DataFrame, index: DataFrame, blueprints: DataFrame) -> DataFrame:
    """files (id, length, modified) with action: new, adopt (indexed without a date), skip, reingest. Indexed means the
    same size and a blueprint that is there."""
    i = index.select("id", F.col("size").alias("_size"), F.col("file_modified").alias("_date"), F.lit(True).alias("_in"))
    f = files.join(i, "id", "left").join(blueprints.select("id", F.lit(True).alias("_bp")), "id", "left")
    whole = F.col("_in").isNotNull() & F.col("_bp").isNotNull() & (F.col("_size") == F.col("length"))
    action = F.when(F.col("_in").isNull(), "new").when(whole & F.col("_date").isNull(), "adopt").when(whole & (F.col("_date") == F.col("modified")), "skip").otherwise("reingest")
    return f.withColumn("action", action).drop("_size", "_date", "_in", "_bp")


def read_slice(path: str, offset: int = 0, length: int | None = None) -> bytes:
    """Bytes of a file in any store that Arrow reaches; for files beyond the 2 GiB of a binary value, slice by slice."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(inner) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)


def payloads(files: DataFrame) -> DataFrame:
    """version_id, payload of files (id, path), each read in its own task."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for i, path in zip(b.column("id").to_pylist(), b.column("path").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([read_slice(path)], pa.binary())], ["version_id", "payload"])

    return files.select("id", "path").repartition("id").mapInArrow(read, "version_id string, payload binary")
