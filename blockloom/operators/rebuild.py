"""Rebuilding payloads and containers from blocks, verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import codec_of, sevenz
from ..model import ContainerFormat


def concat_blocks(refs: DataFrame, blocks: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """keys, payload: the blocks of each key in order (blocks: one row a hash, see store.distinct_blocks). References meet blocks by hash; a key's blocks are then streamed
    in sorted order through one task, so a task holds the payload it is making and no other. A missing block fails."""
    found = refs.select(*keys, order, "hash").join(blocks.select("hash", "payload"), "hash", "left")
    found = found.withColumn("payload", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("block missing from every source: "), F.lower(F.hex("hash"))))))
    schema = refs.select(*keys).schema.add("payload", "binary")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (*keys, "payload"))))
        for key, group in groupby(rows, key=lambda r: tuple(map(str, r[:-1]))):
            group = list(group)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*group[0][:-1], b"".join(r[-1] for r in group)), arrow)], schema=arrow)

    return found.select(*keys, order, "payload").repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, "payload").mapInArrow(join, schema)


def verify(rebuilt: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sha256, verified: whether the rebuilt payload has the expected digest (hex)."""
    got = rebuilt.select(*keys, F.sha2("payload", 256).alias("sha256"))
    return got.join(expected.select(*keys, F.col("sha256").alias("_want")), keys).withColumn("verified", F.col("sha256") == F.col("_want")).drop("_want")


def verified(rebuilt: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """The payloads; one whose digest differs fails the query."""
    both = rebuilt.join(expected.select(*keys, F.col("sha256").alias("_want")), keys)
    return both.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("_want"), F.col("payload")).otherwise(F.raise_error(F.lit("the rebuilt payload has another digest")))).drop("_want")


def rebuild_versions(nodes: DataFrame, refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """version_id, payload: containers are rebuilt from the deepest level up, every one of a level in its own task."""
    blobs = nodes.filter("kind = 'blob'").select("version_id", "path", "depth")
    made = concat_blocks(refs, blocks, ["version_id", "path"])
    now = blobs.join(made, ["version_id", "path"], "left").withColumn("payload", F.coalesce("payload", F.lit(b"")))
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    for d in range(depth - 1, -1, -1):
        boxes = nodes.filter((F.col("kind") == "container") & (F.col("depth") == d)).select("version_id", "path", "depth", "format", "meta")
        kids = now.filter(F.col("depth") == d + 1).select("version_id", F.expr("slice(path, 1, size(path) - 1)").alias("path"), F.element_at("path", -1).alias("_k"), "payload")
        head = boxes.select("version_id", "path", F.lit(-1).alias("_k"), F.col("meta").alias("payload"), "format")
        rows = head.unionByName(kids.withColumn("format", F.lit(None).cast("int")))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("version_id", "path", "payload", "format"))))
            for (version, path), group in groupby(rows, key=lambda r: (r[0], tuple(r[1]))):
                (_, _, meta, fmt), *parts = group
                data = codec_of(fmt).rebuild(meta, [p[2] for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array([version]), pa.array([list(path)], pa.list_(pa.int32())), pa.array([len(path) - 1], pa.int32()), pa.array([data], pa.binary())], ["version_id", "path", "depth", "payload"])

        seven = boxes.filter(F.col("format") == int(ContainerFormat.SEVEN_Z)).select("version_id", "path")
        late, rows = rows.join(seven, ["version_id", "path"], "left_semi"), rows.join(seven, ["version_id", "path"], "left_anti")
        built = rows.select("version_id", "path", "_k", "payload", "format").repartition("version_id", "path").sortWithinPartitions("version_id", "path", "_k").mapInArrow(build, "version_id string, path array<int>, depth int, payload binary")
        now = now.filter(F.col("depth") <= d).unionByName(built)
        if seven.head(1):
            now = now.unionByName(_seven_z(late))
    return now.filter("depth = 0").select("version_id", "payload")


def _seven_z(rows: DataFrame) -> DataFrame:
    """7z containers are put together on the driver, one at a time."""
    out = []
    ordered = rows.orderBy("version_id", "path", "_k").toLocalIterator()
    for (version, path), group in groupby(ordered, key=lambda r: (r.version_id, tuple(r.path))):
        meta, *parts = [bytes(r.payload) for r in group]
        out.append((version, list(path), len(path) - 1, bytearray(sevenz.rebuild(rows.sparkSession, meta, parts))))
    return rows.sparkSession.createDataFrame(out, "version_id string, path array<int>, depth int, payload binary")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
