"""New versions as a stream: the file source only triggers, and the batch comparison decides what is new or changed, since
a file source never gives the same path twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import scan

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, checkpoint: str, index: Callable[[], tuple[DataFrame, DataFrame]], ingest: Callable[[DataFrame], None]) -> StreamingQuery:
    """Run `ingest` on pending versions (new, reingest) whenever files have arrived; index() gives (versions, blueprints).
    Processes what is there and ends; call it again, with the same checkpoint, for what comes later."""
    arrived = spark.readStream.schema(_FILES).format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path", "length")

    def batch(_: DataFrame, epoch: int) -> None:
        versions, blueprints = index()
        found = scan.candidates(scan.list_directory(spark, folder)).filter("rank = 1")
        ingest(scan.pending(found, versions, blueprints).filter("action IN ('new', 'reingest')"))

    return arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
