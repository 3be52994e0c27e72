"""Merkle fixity audit of WARC records: records are hashed, ordered ranges of them are hashed into a tree with their
places in the file, the roots of two replicas are compared and only branches that differ are descended."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, writing

#: A leaf range covers 2^LEAF_BITS record numbers, an inner node 2^FAN_BITS nodes below it; levels of up to TOP nodes are the driver's.
LEAF_BITS, FAN_BITS, TOP = 8, 4, 4096
#: Bytes read at a time, and bytes of records in a file that is written.
STEP, FILE_BYTES = 1 << 16, 64 << 20


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """One WARC/1.1 response record as text; nulls count as empty."""
    body, page_id = F.coalesce(body, F.lit("")), F.coalesce(page_id.cast("string"), F.lit(""))
    head = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:", page_id, ">\r\nWARC-Target-URI: ", F.coalesce(url, F.lit("")), "\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n")
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head], body, F.lit("\r\n\r\n"))


class _Window:
    """Bytes of a file from `at` on, read as they are asked for; what lies before has been let go."""

    def __init__(self, file) -> None:
        self.file, self.held, self.at = file, bytearray(), 0

    def more(self) -> bool:
        data = self.file.read(STEP)
        self.held += data
        return bool(data)

    def find(self, what: bytes) -> int:
        start = 0
        while (k := self.held.find(what, start)) < 0:
            start = max(0, len(self.held) - len(what) + 1)
            if not self.more():
                return -1
        return k

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out

    def rest(self) -> bytes:
        while self.more():
            pass
        return self.take(len(self.held))


def parse_stream(file) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an open WARC file, plain or one gzip member a record; offsets are those in the file. It is read once, in
    steps, and one record is held at a time. A record that is cut short or damaged ends the walk with what is left."""
    w = _Window(file)
    while w.held or w.more():
        at = w.at
        while len(w.held) < 2 and w.more():
            pass
        if w.held[:2] == b"\x1f\x8b":
            d, out, raw = zlib.decompressobj(31), [], []
            try:
                while not d.eof and (w.held or w.more()):
                    raw.append(w.take(4096))
                    out.append(d.decompress(raw[-1]))
                w.held[:0] = d.unused_data
                w.at -= len(d.unused_data)
                yield at, b"".join(out)
            except zlib.error:
                yield at, b"".join(raw) + w.rest()
            continue
        gap = w.find(b"\r\n\r\n")
        head = bytes(w.held[: max(gap, 0)])
        sizes = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        yield at, w.take(gap + 4 + int(sizes[0]) + 4) if sizes and sizes[0].strip().isdigit() else w.rest()


def parse_warc(data: bytes) -> Iterator[tuple[int, bytes]]:
    return parse_stream(io.BytesIO(data))


def pack_warc(records: list[bytes]) -> bytes:
    return b"".join(gzip.compress(r, mtime=0) for r in records)


def read_warc(files: DataFrame) -> DataFrame:
    """Records of WARC files: (path, number, offset, record). files has path and content, as the binaryFile source reads them, or
    path alone: such a file is opened in its task and read in steps, so it may be of any size. number counts a file's
    records, or comes from its index, `numbers`, where files has one (null beyond its end)."""
    inline, indexed = "content" in files.columns, "numbers" in files.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        types, names = (pa.string(), pa.int64(), pa.int64(), pa.binary()), ["path", "number", "offset", "record"]
        for b in batches:
            for i, path in enumerate(b.column("path").to_pylist()):
                if inline:
                    source = io.BytesIO(b.column("content")[i].as_py() or b"")
                else:
                    system, inner = fs.FileSystem.from_uri(path)
                    source = system.open_input_stream(inner, compression=None)  # members are told apart here
                numbers = b.column("numbers")[i].as_py() if indexed else None
                rows, size = [], 0
                with source:
                    for k, (at, record) in enumerate(parse_stream(source)):
                        rows.append((path, k if numbers is None else numbers[k] if k < len(numbers) else None, at, record))
                        size += len(record)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("path", *["content"] * inline, *["numbers"] * indexed).mapInArrow(walk, "path string, number long, offset long, record binary")


def write_warc(records: DataFrame, tag: str, number: str = "number", record: str = "record") -> DataFrame:
    """Write records in the order of their numbers (null first) as WARC files of one gzip member a record into a new folder in the
    shared one: (path, numbers), a file's index. A file holds about FILE_BYTES of them. Records are dealt by range once; many of one number are told
    apart by a hash. Files appear whole, under names that don't depend on the attempt."""
    spark = records.sparkSession
    folder = f"{shared_dir(spark)}/blockloom-{spark.sparkContext.applicationId}/{tag}-{os.urandom(8).hex()}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), (r for b in batches for r in zip(b.column("number").to_pylist(), b.column("record").to_pylist()))
        first, k = next(rows, None), 0
        while first is not None:
            path, numbers, size = f"{folder}/part-{part:07d}-{k:05d}.warc.gz", [], 0
            with writing(path) as out:
                while first is not None and size < FILE_BYTES:
                    out.write(gzip.compress(first[1], 1, mtime=0))
                    numbers.append(first[0])
                    size += len(first[1])
                    first = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([numbers], pa.list_(pa.int64()))], ["path", "numbers"])
            k += 1

    rows = records.select(F.col(number).cast("long").alias("number"), F.coalesce(F.col(record).cast("binary"), F.lit(b"")).alias("record"))
    rows = rows.repartitionByRange("number", F.xxhash64("record")).sortWithinPartitions("number")
    return materialise(rows.mapInArrow(write, "path string, numbers array<long>"), f"{tag}-files")


def archive(files: DataFrame) -> DataFrame:
    """(number, record) of the files of write_warc."""
    return read_warc(files.repartition(max(1, min(files.count(), 10_000)))).select("number", "record")


def _multiset(digest: Column) -> list[Column]:
    """Sums of four parts of hex digests: equal multisets have equal sums, whatever their order; they sum up map-side."""
    return [F.sum(F.conv(F.substring(digest, 1 + 14 * k, 14), 16, 10).cast("decimal(38,0)")) for k in range(4)]


def record_digests(records: DataFrame, number: str = "number", record: str = "record") -> DataFrame:
    """(number, n, bytes, digest): one row for each record number. The digest is the SHA-256 of the record; of a number
    that occurs more than once the SHA-256 of a sum over all of its records, so a number with a third of all rows is
    summed up before the shuffle like any other. Records without a number or content: number -1, empty."""
    data = F.coalesce(F.col(record).cast("binary"), F.lit("").cast("binary"))
    r = records.select(F.coalesce(F.col(number).cast("long"), F.lit(-1)).alias("number"), F.octet_length(data).cast("long").alias("bytes"), F.sha2(data, 256).alias("digest"))
    s = r.groupBy("number").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("digest").alias("digest"), *[c.alias(f"s{k}") for k, c in enumerate(_multiset(F.col("digest")))])
    many = F.sha2(F.concat_ws(":", "n", "s0", "s1", "s2", "s3").cast("binary"), 256)
    return s.select("number", "n", "bytes", F.when(F.col("n") == 1, F.col("digest")).otherwise(many).alias("digest"))


def _up(below: DataFrame, key: str, bits: int, level: int) -> DataFrame:
    """The nodes over `below`: at most 2^bits children each, hashed in order with their numbers, sizes and counts."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "n", "bytes", "digest")))
    g = below.groupBy(F.shiftright(F.col(key), bits).alias("node")).agg(parts.alias("p"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    text = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["k"], x["n"], x["bytes"], x["digest"])), ";")
    return g.select(F.lit(level).alias("level"), "node", "n", "bytes", F.sha2(text.cast("binary"), 256).alias("digest"))


def _up_local(below: dict[int, tuple], bits: int) -> dict[int, tuple]:
    """_up() for nodes that the driver holds: {node: (n, bytes, digest)}."""
    groups: dict[int, list] = {}
    for k in sorted(below):
        groups.setdefault(k >> bits, []).append((k, *below[k]))
    text = {node: ";".join(":".join(map(str, x)) for x in kids) for node, kids in groups.items()}
    return {node: (sum(x[1] for x in kids), sum(x[2] for x in kids), hashlib.sha256(text[node].encode()).hexdigest()) for node, kids in groups.items()}


class Tree:
    """`records` (record_digests) and `levels`, the node tables from the leaves up, all in the shared folder; `top`: the levels above,
    on the driver, from one of at most TOP nodes to the root (two roots where there are numbers below 0)."""

    def __init__(self, records: DataFrame) -> None:
        self.records = materialise(records, "records")
        self.levels = [materialise(_up(self.records, "number", LEAF_BITS, 0), "merkle-0")]
        self.top: list[dict[int, tuple]] = []

    def wide(self) -> bool:
        return self.levels[-1].count() > TOP

    def grow(self) -> None:
        self.levels.append(materialise(_up(self.levels[-1], "node", FAN_BITS, len(self.levels)), "merkle"))

    def close(self) -> None:
        self.top = [{r.node: (r.n, r.bytes, r.digest) for r in self.levels[-1].collect()}]  # wide() has bounded it
        while set(self.top[-1]) - {0, -1}:
            self.top.append(_up_local(self.top[-1], FAN_BITS))

    def starts(self) -> dict[int, int]:
        """Where the nodes of the highest written level start in the file."""
        out, at = {}, 0
        for node in sorted(self.top[0]):
            out[node] = at
            at += self.top[0][node][1]
        return out


def _differing(a: Tree, b: Tree) -> list[int]:
    """Nodes of the highest written level whose digests differ: from the roots down, below differing nodes only."""
    while len(a.top) < len(b.top):
        a.top.append(_up_local(a.top[-1], FAN_BITS))
    while len(b.top) < len(a.top):
        b.top.append(_up_local(b.top[-1], FAN_BITS))
    bad: set[int] | None = None
    for x, y in zip(reversed(a.top), reversed(b.top)):
        bad = {k for k in {*x, *y} if (bad is None or k >> FAN_BITS in bad) and x.get(k) != y.get(k)}
    return sorted(bad or ())


def _offsets(levels: list[DataFrame], starts: dict[int, int]) -> DataFrame:
    """(node, start) of the leaf ranges: from the highest written level down, a node starts where its parent does plus its elder
    siblings."""
    elder = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # 2^FAN_BITS rows at most
    start = levels[-1].sparkSession.createDataFrame(list(starts.items()), "node long, start long")
    for level in reversed(levels[:-1]):
        here = level.withColumn("up", F.shiftright("node", FAN_BITS)).withColumn("before", F.coalesce(F.sum("bytes").over(elder), F.lit(0)))
        start = here.join(start.withColumnsRenamed({"node": "up", "start": "_s"}), "up").select("node", (F.col("before") + F.col("_s")).alias("start"))
    return start


def fixity_audit(primary: DataFrame, replica: DataFrame, number: str = "number", record: str = "record") -> DataFrame:
    """Damage of a replica: number, status (changed, missing, extra), leaf (its range), offset and length in the primary
    archive (null: not there), expected and found digests. Records lie in the archive in the order of their numbers.

    Equal roots end the audit. Else each level is joined only below the nodes that differed above, and records only
    within leaf ranges that differ. Trees are radix trees over record numbers, so a missing or extra record changes its
    own range, not the ones behind it. Empty inputs are empty trees; repeated records count; a null number is -1, a null
    record an empty one."""
    a, b = Tree(record_digests(primary, number, record)), Tree(record_digests(replica, number, record))
    while a.wide() or b.wide():
        a.grow(), b.grow()
    a.close(), b.close()
    leaf = F.shiftright("number", LEAF_BITS)
    bad = a.records.sparkSession.createDataFrame([(k,) for k in _differing(a, b)], "node long")
    for x, y in zip(reversed(a.levels[:-1]), reversed(b.levels[:-1])):
        above = bad.withColumnRenamed("node", "up")
        left, right = (d.select("node", F.col("digest").alias(c)).withColumn("up", F.shiftright("node", FAN_BITS)).join(above, "up", "left_semi").drop("up") for d, c in ((x, "da"), (y, "db")))
        bad = materialise(left.join(right, "node", "full").filter(~F.col("da").eqNullSafe(F.col("db"))).select("node"), "differing")
    near = bad.withColumnRenamed("node", "leaf")
    left, right = (t.records.withColumn("leaf", leaf).join(near, "leaf", "left_semi") for t in (a, b))
    inside = Window.partitionBy("leaf").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # 2^LEAF_BITS rows at most
    left = left.withColumn("_in", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(_offsets(a.levels, a.starts()).withColumnRenamed("node", "leaf"), "leaf")
    left = left.select("number", (F.col("start") + F.col("_in")).alias("offset"), F.col("bytes").alias("length"), F.col("digest").alias("expected"))
    both = left.join(right.select("number", F.col("digest").alias("found")), "number", "full").filter(~F.col("expected").eqNullSafe(F.col("found")))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return both.select("number", status.alias("status"), leaf.alias("leaf"), "offset", "length", "expected", "found")


def op1(pages: DataFrame) -> DataFrame:
    """The archive of all pages against a replica with planted damage: every 97th record has lost its last byte, every
    193rd is missing, every 389th is followed by a stray one (its number lies in a range of its own). Both are written as WARC
    files and read back. Pages without an id are records without a number; null urls and bodies are empty; repeated
    pages are records like others; an empty table has an empty archive and no damage."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"))
    primary = rows.select(F.col("page_id").alias("number"), warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    kept = primary.filter(F.coalesce(F.col("number") % 193 != 7, F.lit(True)))
    cut = F.when(F.col("number") % 97 == 13, F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    stray = primary.filter(F.col("number") % 389 == 11).select((F.col("number") + (1 << 40)).alias("number"), "record")
    replica = kept.select("number", cut.alias("record")).unionByName(stray)
    return fixity_audit(archive(write_warc(primary, "primary")), archive(write_warc(replica, "replica")))


SQL = """
WITH r AS (SELECT page_id AS number, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
p AS (SELECT number, strlen(record)::BIGINT AS length, sha256(record) AS expected, (sum(strlen(record)) OVER (ORDER BY number) - strlen(record))::BIGINT AS offset FROM r),
q AS (SELECT number, sha256(CASE WHEN number % 97 = 13 THEN left(record, len(record) - 1) ELSE record END) AS found FROM r WHERE number % 193 <> 7
  UNION ALL SELECT number + 1099511627776, sha256(record) FROM r WHERE number % 389 = 11)
SELECT coalesce(p.number, q.number) AS number, CASE WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' ELSE 'changed' END AS status,
  coalesce(p.number, q.number) >> 8 AS leaf, "offset", length, expected, found FROM p FULL JOIN q ON p.number = q.number WHERE expected IS DISTINCT FROM found
"""
