"""Blueprints as files: gzip over a header and a recursive node tree (big endian), to and from the node tables."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ChunkParams, ContainerFormat, DecomposeLimits

#: Fixed values of the format.
MAGIC, VERSION = b"JDTBP", 2


@dataclass(frozen=True)
class Blueprint:
    """nodes: (path, kind, format, meta, size) in preorder; refs: (path, seq, hash, length)."""

    archive_hash: bytes
    archive_size: int
    params: ChunkParams
    limits: DecomposeLimits
    nodes: tuple
    refs: tuple


def to_bytes(b: Blueprint) -> bytes:
    p, refs = b.params, {}
    for path, seq, h, n in b.refs:
        refs.setdefault(tuple(path), []).append((seq, h, n))
    kids: dict[tuple, list] = {}
    for x in sorted(b.nodes, key=lambda x: tuple(x[0])):
        kids.setdefault(tuple(x[0])[:-1], []).append(x)

    def node(x) -> bytes:
        path, kind, fmt, meta, size = x
        if kind == "blob":
            r = sorted(refs.get(tuple(path), []))
            return b"\0" + struct.pack(">qi", size, len(r)) + b"".join(h + struct.pack(">i", n) for _, h, n in r)
        c = kids.get(tuple(path), [])
        return b"\1" + struct.pack(">Bqi", fmt, size, len(meta)) + meta + struct.pack(">i", len(c)) + b"".join(map(node, c))

    head = MAGIC + bytes([VERSION]) + b.archive_hash + struct.pack(">qiiiq", b.archive_size, p.min, p.avg, p.max, b.limits.max_seven_z)
    return gzip.compress(head + node(kids[()][0]), mtime=0)


def from_bytes(data: bytes) -> Blueprint:
    """Reads version 1, which has no limit in it (the default holds), and 2; anything else is a ValueError."""
    raw = gzip.decompress(data)
    if raw[:5] != MAGIC or raw[5] not in (1, 2):
        raise ValueError("not a blueprint of version 1 or 2")
    size, low, avg, high = struct.unpack_from(">qiii", raw, 38)
    at, limits = 58, DecomposeLimits()
    if raw[5] == 2:
        limits, at = DecomposeLimits(struct.unpack_from(">q", raw, at)[0]), at + 8
    nodes, refs = [], []

    def node(path: tuple, at: int) -> int:
        tag = raw[at]
        if tag == 0:
            n_bytes, n = struct.unpack_from(">qi", raw, at + 1)
            nodes.append((list(path), "blob", None, None, n_bytes))
            at += 13
            for k in range(n):
                refs.append((list(path), k, raw[at : at + 32], struct.unpack_from(">i", raw, at + 32)[0]))
                at += 36
            return at
        if tag != 1:
            raise ValueError(f"unknown node tag {tag}")
        fmt, n_bytes, m = struct.unpack_from(">Bqi", raw, at + 1)
        at += 14
        nodes.append((list(path), "container", int(ContainerFormat(fmt)), raw[at : at + m], n_bytes))
        (n,) = struct.unpack_from(">i", raw, at + m)
        at += m + 4
        for k in range(n):
            at = node((*path, k), at)
        return at

    try:
        node((0,), at)
    except (struct.error, IndexError) as e:
        raise ValueError("a blueprint that is cut short") from e
    return Blueprint(raw[6:38], size, ChunkParams(low, avg, high), limits, tuple(nodes), tuple(refs))


def write(heads: DataFrame, nodes: DataFrame, refs: DataFrame, params: ChunkParams, limits: DecomposeLimits, folder: str) -> DataFrame:
    """Write folder/<version_id>.bp for each of heads (version_id, sha256, size): version_id, sha256 and bytes of the file. A version's
    nodes and references meet in one task, in order; the file appears whole, in a folder that all executors see."""
    kinds = "version_id string, path array<int>, seq int, kind string, format int, meta binary, size long, hash binary, length int, sha256 string, total long"
    h = heads.select("version_id", F.lit(None).cast("array<int>").alias("path"), F.lit("").alias("kind"), "sha256", F.col("size").alias("total"))
    n = nodes.select("version_id", "path", "kind", "format", "meta", "size")
    r = refs.select("version_id", "path", "seq", "hash", "length")
    rows = h.unionByName(n, allowMissingColumns=True).unionByName(r, allowMissingColumns=True).select(*[x.split()[0] for x in kinds.split(", ")])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import os
        from itertools import groupby

        each = (x for b in batches for x in b.to_pylist())
        for version, group in groupby(each, key=lambda x: x["version_id"]):
            head, mine, parts = None, [], []
            for x in group:
                if x["sha256"] is not None:
                    head = x
                elif x["hash"] is None:
                    mine.append((x["path"], x["kind"], x["format"], x["meta"], x["size"]))
                else:
                    parts.append((x["path"], x["seq"], x["hash"], x["length"]))
            raw = to_bytes(Blueprint(bytes.fromhex(head["sha256"]), head["total"], params, limits, tuple(mine), tuple(parts)))
            path = f"{folder}/{version}.bp"
            with open(f"{path}.{os.getpid()}.tmp", "wb") as f:
                f.write(raw)
            os.replace(f"{path}.{os.getpid()}.tmp", path)
            yield pa.RecordBatch.from_pydict({"version_id": [version], "sha256": [hashlib.sha256(raw).hexdigest()], "bytes": [len(raw)]})

    return rows.repartition("version_id").sortWithinPartitions("version_id", "path", "seq").mapInArrow(make, "version_id string, sha256 string, bytes long")


def parse(files: DataFrame) -> DataFrame:
    """Rows of blueprint files (version_id, content): version_id, path, kind, format, meta, size, seq, hash, length; node
    rows have no hash, block rows have no kind."""
    schema = "version_id string, path array<int>, kind string, format int, meta binary, size long, seq int, hash binary, length int"
    types = (pa.string(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for version, data in zip(b.column("version_id").to_pylist(), b.column("content").to_pylist()):
                x = from_bytes(data)
                rows = [(version, *n, None, None, None) for n in x.nodes] + [(version, p, None, None, None, None, s, h, n) for p, s, h, n in x.refs]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [n.split()[0] for n in schema.replace("array<int>", "a").split(", ")])

    return files.select("version_id", "content").mapInArrow(read, schema)
