"""Taking versions apart: containers are opened level by level, every one of a level in its own task; leaves are cut
into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..codecs import codec_of, sevenz
from ..functions.chunker import DEFAULT_PARAMS, chunk
from ..functions.scalars import sniff_bytes
from ..model import MAX_DEPTH, MIN_CONTAINER, ChunkParams, ContainerFormat, DecomposeLimits
from .store import distinct_blocks

_STEP = "version_id string, path array<int>, depth int, kind string, format int, meta binary, size long, payload binary, opaque string"


def open_level(rows: DataFrame, limits: DecomposeLimits) -> DataFrame:
    """rows: version_id, path, depth, payload. A payload that opens gives one 'container' row and an 'open' row for each
    part; any other is a 'blob' (opaque: the format it looked like, where it looked like one)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.string())
        for b in batches:
            for i in range(b.num_rows):
                version, path, depth = (b.column(c)[i].as_py() for c in ("version_id", "path", "depth"))
                data = b.column("payload")[i].as_py() or b""
                fmt = sniff_bytes(data[:8], len(data)) if depth < MAX_DEPTH and len(data) >= MIN_CONTAINER else None
                opened = codec_of(ContainerFormat[fmt]).decompose(data, limits) if fmt in ("ZIP", "CAB") else None
                if opened:
                    meta, parts = opened
                    out = [(version, path, depth, "container", int(ContainerFormat[fmt]), meta, len(data), None, None)]
                    out += [(version, [*path, k], depth + 1, "open", None, None, len(p), p, None) for k, p in enumerate(parts)]
                else:
                    out = [(version, path, depth, "blob", None, None, len(data), data, fmt)]
                for x in out:  # a row a batch: payloads can be large
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, types)], [n.split()[0] for n in _STEP.split(", ")])

    return rows.mapInArrow(step, _STEP)


def open_seven_z(step: DataFrame, limits: DecomposeLimits, scratch: str) -> DataFrame:
    """step with its 7z blobs of up to the limit opened, one after the other on the driver (see codecs.sevenz); one that
    can't be repeated exactly stays as it is. Only 7z payloads travel, and the rows of one archive are written to `scratch`
    before the next is opened, so the driver holds one archive."""
    spark, shut = step.sparkSession, (F.col("kind") == "blob") & (F.col("opaque") == "SEVEN_Z") & (F.col("size") <= limits.max_seven_z)
    done = []
    for r in step.filter(shut).toLocalIterator():
        opened = sevenz.decompose(spark, bytes(r.payload), limits)
        if opened:
            meta, parts = opened
            rows = [(r.version_id, r.path, r.depth, "container", int(ContainerFormat.SEVEN_Z), bytearray(meta), r.size, None, None)]
            rows += [(r.version_id, [*r.path, k], r.depth + 1, "open", None, None, len(p), bytearray(p), None) for k, p in enumerate(parts)]
            spark.createDataFrame(rows, _STEP).write.mode("append").parquet(scratch)
            done.append((r.version_id, r.path))
    if not done:
        return step
    opened = spark.createDataFrame(done, "version_id string, path array<int>")
    return step.join(opened, ["version_id", "path"], "left_anti").select(step.columns).unionByName(spark.read.schema(_STEP).parquet(scratch))


class Decomposed:
    """nodes, refs, blocks and events of some versions, as tables in `scratch`."""

    def __init__(self, archives: DataFrame, scratch: str, params: ChunkParams = DEFAULT_PARAMS, limits: DecomposeLimits = DecomposeLimits()) -> None:
        """archives: version_id, payload. At most MAX_DEPTH + 1 rounds; a round is written before the next reads it, so a
        lost executor costs its part of one round."""
        spark, done = archives.sparkSession, []
        level = archives.select("version_id", F.array(F.lit(0)).alias("path"), F.lit(0).alias("depth"), "payload")
        for k in range(MAX_DEPTH + 1):
            open_level(level, limits).write.mode("overwrite").parquet(f"{scratch}/level-{k}")
            step = spark.read.schema(_STEP).parquet(f"{scratch}/level-{k}")
            step = open_seven_z(step, limits, f"{scratch}/seven-{k}")
            done.append(step.filter("kind != 'open'"))
            level = step.filter("kind = 'open'").select("version_id", "path", "depth", "payload")
            if not level.head(1):
                break
        rows = done[0]
        for d in done[1:]:
            rows = rows.unionByName(d)
        names = [n.split()[0] if "array" not in n else "path" for n in model.NODES.split(", ")]
        self.nodes = rows.select(*names)
        self.events = rows.select("version_id", F.when(F.col("kind") == "container", "container").when(F.col("opaque").isNotNull(), "opaque").alias("event"), "depth", "size").filter("event IS NOT NULL")
        chunk(rows.filter("kind = 'blob'"), params, ("version_id", "path")).write.mode("overwrite").parquet(f"{scratch}/chunks")
        chunks = spark.read.parquet(f"{scratch}/chunks")
        self.refs = chunks.select("version_id", "path", "seq", "hash", "length")
        self.blocks = distinct_blocks(chunks)
