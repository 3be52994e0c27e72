"""Token ids in binary files: fixed-size blocks of ids are transposed into byte or bit planes, every plane is compressed
with zstandard, and an index at the end tells where each block and document lies.

File: MAGIC, blocks, index, int64 offset of the index, MAGIC (little endian). Index (zstandard over int64): kind
(8: byte planes, 1: bit planes), block size, number of blocks, documents, ids; for each block its offset and the lengths
of its planes (0: a plane of zeros; 8 * 4 / kind of them); for each document 1 or 0 (has an id), doc_id, number of ids.
The last block may be shorter than the others."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, writing
from .tokens import encoder, parts, vocabulary

MAGIC, BLOCK, LEVEL = b"BLPLANE1", 65_536, 3
VOCABULARY, END = "word_bpe_49k.json", 2


def _codec():
    import zstandard

    return zstandard


def planes(ids: np.ndarray, kind: int = 8) -> list[np.ndarray]:
    """The 4 byte planes (kind 8) or 32 bit planes (kind 1) of uint32 ids."""
    by = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == 8:
        return [np.ascontiguousarray(by[:, k]) for k in range(4)]
    bits = np.unpackbits(by, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little") for k in range(32)]


def unplanes(parts: list[np.ndarray], n: int, kind: int = 8) -> np.ndarray:
    if kind == 8:
        return np.stack(parts, axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(p, bitorder="little")[:n] for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    def __init__(self, out, kind: int = 8, block: int = BLOCK, level: int = LEVEL) -> None:
        self.out, self.kind, self.block, self.at = out, kind, block, len(MAGIC)
        self.press = _codec().ZstdCompressor(level=level)
        self.waiting, self.n, self.blocks, self.docs, self.total = [], 0, [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((int(doc_id is not None), doc_id or 0, n))
        self.waiting.append(ids)
        self.n += n
        self.total += n
        if self.n >= self.block:
            left = b"".join(self.waiting)
            whole = self.n // self.block * self.block * 4
            for i in range(0, whole, self.block * 4):
                self._flush(left[i : i + self.block * 4])
            self.waiting, self.n = [left[whole:]], (len(left) - whole) // 4

    def _flush(self, ids: bytes) -> None:
        parts = [self.press.compress(p.tobytes()) if p.any() else b"" for p in planes(np.frombuffer(ids, "<u4"), self.kind)]
        self.blocks.append([self.at, *map(len, parts)])
        for p in parts:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n:
            self._flush(b"".join(self.waiting))
        head = [self.kind, self.block, len(self.blocks), len(self.docs), self.total]
        index = np.array(head + [x for b in self.blocks for x in b] + [x for d in self.docs for x in d], "<i8")
        self.out.write(self.press.compress(index.tobytes()) + self.at.to_bytes(8, "little") + MAGIC)


class Reader:
    """Documents in order, block by block; blocks can also be read alone by their place in the index."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        tail = file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a whole bit-plane file")
        start = int.from_bytes(tail[:8], "little")
        index = np.frombuffer(_codec().decompress(file.read_at(size - 8 - len(MAGIC) - start, start)), "<i8")
        self.kind, self.block, blocks, docs, self.total = (int(x) for x in index[:5])
        width = 1 + 32 // self.kind
        self.blocks = index[5 : 5 + blocks * width].reshape(-1, width)
        self.docs = index[5 + blocks * width :].reshape(docs, 3)

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.total - k * self.block)
        size = n if self.kind == 8 else (n + 7) // 8
        at, *lengths = (int(x) for x in self.blocks[k])
        parts, data = [], self.file.read_at(sum(lengths), at)
        at = 0
        for length in lengths:
            parts.append(np.frombuffer(_codec().decompress(data[at : at + length]), np.uint8) if length else np.zeros(size, np.uint8))
            at += length
        return unplanes(parts, n, self.kind)

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        have, k = b"", 0
        for known, doc_id, n in self.docs.tolist():
            got = [have] if have else []
            size = len(have)
            while size < n * 4:
                got.append(self.read_block(k).tobytes())
                size += len(got[-1])
                k += 1
            data = b"".join(got)
            have = data[n * 4 :]
            yield doc_id if known else None, data[: n * 4]


def write_tokens(docs: DataFrame, file: str, spaces: str, end: int, kind: int = 8, text: str = "text") -> DataFrame:
    """Encode docs and write them in ascending doc_id order (null first), a file for each range of ids, into a new
    folder in the shared one. Returns the manifest (shard, path, n_docs, n_ids); a shard's number gives its order.

    The texts are dealt by range once; rows that share an id are told apart by a hash of the text, so repeated ids don't
    meet in one file unless the rows are equal. Null texts have only the end id. Files appear whole or not at all, under
    names that don't depend on the attempt, so a lost executor costs a rerun of its shards."""
    folder = f"{shared_dir(docs.sparkSession)}/blockloom-{docs.sparkSession.sparkContext.applicationId}/tokens-{os.urandom(8).hex()}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc, tail = TaskContext.get().partitionId(), encoder(file, spaces), end.to_bytes(4, "little")
        first = next(batches, None)
        if first is None:
            return
        path = f"{folder}/shard-{shard:07d}.planes"
        with writing(path) as out:
            w = Writer(out, kind)
            while first is not None:
                for part in parts(first):
                    for doc_id, x in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                        w.add(doc_id, x + tail)
                first = next(batches, None)
            w.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(w.docs)], "n_ids": [w.total]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(rows.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "token-manifest")


def read_tokens(manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from the files of a manifest, or without the ids where only their checksum
    is wanted. start: ids of all documents before, in file order."""
    from_here = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    m = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(from_here), F.lit(0)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 4 + [pa.binary()] * keep_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as f:
                    rows, size = [], 0
                    for doc_id, ids in Reader(f):
                        n = len(ids) // 4
                        rows.append((doc_id, before, n, zlib.crc32(ids), *([ids] * keep_ids)))
                        before += n
                        size += len(ids) if keep_ids else 64
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = max(1, min(manifest.count(), 10_000))
    return m.repartition(n).mapInArrow(read, schema)


def op8(docs: DataFrame, file: str | None = None) -> DataFrame:
    manifest = write_tokens(docs.select("doc_id", "text"), file or vocabulary(VOCABULARY), "dropped", END)
    return read_tokens(manifest, keep_ids=False)
