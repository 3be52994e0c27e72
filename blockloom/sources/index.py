"""The version index: a strict JSON document and the versions table."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.scalars import human
from ..model import ChunkParams

#: (column, name in JSON), in the order of the document.
FIELDS = (
    ("id", "id"), ("file_name", "fileName"), ("size", "size"), ("sha256", "sha256"), ("blueprint_sha256", "blueprintSha256"), ("blueprint_bytes", "blueprintBytes"),
    ("block_refs", "blockRefs"), ("distinct_blocks", "distinctBlocks"), ("containers", "containers"), ("opaque_containers", "opaqueContainers"), ("ingested_at", "ingestedAt"), ("file_modified", "fileModified"),
)


def save(versions: DataFrame, params: ChunkParams, path: str) -> None:
    """Ordered by id, without fileModified where it is null; appears at once. One row a version: small enough for a driver."""
    rows = [{name: r[c] for c, name in FIELDS if not (c == "file_modified" and r[c] is None)} for r in versions.orderBy("id").collect()]
    doc = {"formatVersion": 1, "hashAlgorithm": model.HASH_ALGORITHM, "chunkMin": params.min, "chunkAvg": params.avg, "chunkMax": params.max, "versions": rows}
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2)
    os.replace(f"{path}.tmp", path)


def load(spark: SparkSession, path: str) -> tuple[ChunkParams, DataFrame]:
    types = dict(x.split(" ", 1) for x in model.VERSIONS.split(", "))
    inner = ", ".join(f"{name}: {types[c]}" for c, name in FIELDS)
    doc = spark.read.schema(f"formatVersion int, hashAlgorithm string, chunkMin int, chunkAvg int, chunkMax int, versions array<struct<{inner}>>").json(path, multiLine=True)
    head = doc.first()
    if head is None or head.formatVersion != 1:
        raise ValueError("an index of another format version")
    rows = doc.select(F.explode("versions").alias("v")).select(*[F.col(f"v.{name}").alias(c) for c, name in FIELDS])
    return ChunkParams(head.chunkMin, head.chunkAvg, head.chunkMax), rows


def api_view(versions: DataFrame) -> DataFrame:
    """What the service tells of each version: no file date, a readable size, the hash algorithm."""
    return versions.select(*[c for c, _ in FIELDS if c != "file_modified"], human(F.col("size")).alias("size_human"), F.lit(model.HASH_ALGORITHM).alias("hash_algorithm"))


def client_config(params: DataFrame) -> DataFrame:
    return params.select("hash_algorithm", F.col("chunk_max").alias("max_block_size"))


def admin_config(params: DataFrame, stats: DataFrame, max_seven_z: int, compress: bool) -> DataFrame:
    """One row: parameters beside store statistics."""
    p = params.select("hash_algorithm", F.col("chunk_max").alias("max_block_size"), "chunk_min", "chunk_avg", "chunk_max")
    return p.crossJoin(stats).withColumns({"stored_human": human(F.col("stored_bytes")), "max_seven_z": F.lit(max_seven_z), "compress": F.lit(compress)})
