"""Queries on formats and codecs whose results SQL can tell: what went in must come out, and where cuts and checksums
have a closed definition, SQL computes them again. All run over whole tables."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..codecs import cab as cab_codec
from ..codecs import zip as zip_codec
from ..functions import chunker, scalars
from ..model import ChunkParams, DecomposeLimits
from ..operators import rebuild, repack, store
from ..operators.decompose import Decomposed
from ..sources import blueprint, index, scan, wire

PART = 256
CDC = ChunkParams(64, 256, 1024)


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, or on this machine where that is unset and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="blockloom-")
    return f"{base.rstrip('/')}/formats-{uuid.uuid4().hex}"


def _local(spark: SparkSession) -> str:
    path = scratch(spark).removeprefix("file:")
    path = "/" + path.lstrip("/")
    os.makedirs(path, exist_ok=True)
    return path


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def _each(docs: DataFrame, f, schema: str, *columns: str) -> DataFrame:
    """f(row values) gives rows; texts of a batch are worked on one by one."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = [r for row in zip(*(b.column(c).to_pylist() for c in columns)) for r in f(*row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return docs.select(*columns).mapInArrow(run, schema)


def _parts(text: str) -> list[tuple[bytes, bytes]]:
    """(hash, payload) of stretches of PART characters."""
    data = [text[i : i + PART].encode() for i in range(0, len(text), PART)]
    return [(hashlib.sha256(x).digest(), x) for x in data]


def _zip_of(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _members(codec, make):
    """Each text with a second member in an archive: opened, listed, and what each name holds."""

    def f(doc_id, text):
        opened = codec.decompose(make([("text.txt", text.encode()), ("more.txt", (text + " more").encode())]), DecomposeLimits())
        if not opened:
            return [(doc_id, None, None, None, False)]
        meta, parts = opened
        exact = codec.rebuild(meta, parts) == make([("text.txt", text.encode()), ("more.txt", (text + " more").encode())])
        return [(doc_id, name, len(parts[k]), hashlib.sha256(parts[k]).hexdigest(), exact) for name, _, k in codec.listing(meta)]

    return lambda s, d: _each(_docs(s, d), f, "doc_id long, name string, size long, sha256 string, exact boolean", "doc_id", "text")


def _members_sql(where: str) -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (SELECT doc_id, 'text.txt' AS name, text FROM d UNION ALL SELECT doc_id, 'more.txt', text || ' more' FROM d)
SELECT doc_id, name, strlen(text)::BIGINT AS size, sha256(text) AS sha256, true AS exact FROM m WHERE {where}"""


def frames_read(s, d):
    """Blocks of each text as frames, read back by the reader that checks them."""

    def f(doc_id, text):
        raw = b"".join(wire.write_frames(_parts(text), 4 * PART))
        return [(doc_id, k, h.hex(), len(p)) for k, (h, p) in enumerate(wire.read_frames(raw, 4 * PART))]

    return _each(_docs(s, d), f, "doc_id long, seq int, hash string, length int", "doc_id", "text")


def frames_damaged(s, d):
    """What the reader says of streams: every third whole, with a changed byte in the first payload, without the trailer's end."""

    def f(doc_id, text):
        raw = bytearray(b"".join(wire.write_frames(_parts(text), 4 * PART)))
        if doc_id % 3 == 1 and text:
            raw[37] ^= 1
        if doc_id % 3 == 2:
            del raw[-4:]
        try:
            blocks = wire.read_frames(bytes(raw), 4 * PART)
            return [(doc_id, "whole", len(blocks), sum(len(p) for _, p in blocks))]
        except ValueError as e:
            return [(doc_id, "truncated" if "truncated" in str(e) else "changed", None, None)]

    return _each(_docs(s, d), f, "doc_id long, verdict string, frames long, bytes long", "doc_id", "text")


def hash_lists(s, d):
    def f(doc_id, text):
        raw = wire.write_hash_list([h for h, _ in _parts(text)])
        back = wire.read_hash_list(raw)
        return [(doc_id, len(raw), len(back), back[-1].hex() if back else None)]

    return _each(_docs(s, d), f, "doc_id long, bytes long, hashes long, last string", "doc_id", "text")


def gzip_exact(s, d):
    def f(doc_id, text):
        level = doc_id % 10
        raw = wire.gzip(text.encode(), level)
        return [(doc_id, level, hashlib.sha256(wire.gunzip(raw) if level else raw).hexdigest())]

    return _each(_docs(s, d), f, "doc_id long, level long, sha256 string", "doc_id", "text")


def blueprint_round_trip(s, d):
    """A blueprint of each document, a container with an empty blob and the text's blob: written, read, and its references."""

    def f(doc_id, text):
        parts = _parts(text)
        nodes = (([0], "container", 0, b"meta", len(text)), ([0, 0], "blob", None, None, 0), ([0, 1], "blob", None, None, len(text.encode())))
        b = blueprint.Blueprint(hashlib.sha256(text.encode()).digest(), len(text), CDC, DecomposeLimits(doc_id), nodes, tuple(([0, 1], k, h, len(p)) for k, (h, p) in enumerate(parts)))
        back = blueprint.from_bytes(blueprint.to_bytes(b))
        assert back == b
        return [(doc_id, back.limits.max_seven_z, back.nodes[2][4], k, h.hex(), n) for _, k, h, n in back.refs]

    return _each(_docs(s, d), f, "doc_id long, max_seven_z long, size long, seq int, hash string, length int", "doc_id", "text")


def index_round_trip(s, d):
    """An index of a version for each source: saved, loaded, and shown with all fields of the service."""
    v = _docs(s, d).groupBy(F.coalesce("source", F.lit("none")).alias("id")).agg(F.sum(F.octet_length("text")).cast("long").alias("size"), F.count("*").alias("block_refs"), F.countDistinct("text").alias("distinct_blocks"))
    v = v.select(
        "id", F.concat("id", F.lit(".zip")).alias("file_name"), "size", F.sha2("id", 256).alias("sha256"), F.sha2(F.concat("id", F.lit("b")), 256).alias("blueprint_sha256"), F.lit(7).cast("long").alias("blueprint_bytes"),
        "block_refs", "distinct_blocks", F.lit(1).cast("long").alias("containers"), F.lit(0).cast("long").alias("opaque_containers"), F.lit("2024-01-01T00:00:00Z").alias("ingested_at"), F.when(F.col("size") % 2 == 0, F.lit("2024-01-02T00:00:00.000000001Z")).alias("file_modified"),
    )
    path = f"{_local(s)}/index.json"
    index.save(s.createDataFrame(v.collect(), model.VERSIONS), CDC, path)
    params, back = index.load(s, path)
    shown = index.api_view(back).join(back.select("id", "file_modified"), "id")
    return shown.withColumn("chunk_max", F.lit(params.max))


def store_get(s, d):
    """A store in two appends, of even ids and of all; then every hash of ids 3 modulo 7 is asked for."""

    def blocks(docs):
        return _each(docs, lambda text: [(h, len(p), p) for h, p in _parts(text)], "hash binary, length int, payload binary", "text")

    docs = _docs(s, d)
    kept = store.BlockStore(s, scratch(s), CDC)
    kept.append(blocks(docs.filter("doc_id % 2 = 0")))
    kept.append(blocks(docs))
    again = store.BlockStore(s, kept.path, CDC)
    got = again.get(blocks(docs.filter("doc_id % 7 = 3")).select("hash"))
    return got.select(F.lower(F.hex("hash")).alias("hash"), "length", F.sha2("payload", 256).alias("sha256"))


def _nations(s, d):
    return [(r.n_nationkey, r.n_name) for r in s.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()]  # 25 rows


def pack_replay(s, d):
    """A pack of names whose data lost its last byte: the last record is torn, half a record behind it is dropped."""
    folder, names = _local(s), _nations(s, d)
    store.write_pack([(hashlib.sha256(n.encode()).digest(), n.encode()) for _, n in names], folder)
    with open(f"{folder}/index.bin", "ab") as f:
        f.write(bytes(20))
    os.truncate(f"{folder}/data.pack", os.path.getsize(f"{folder}/data.pack") - 1)
    return store.read_pack(s, folder, 2).select(F.lower(F.hex("hash")).alias("hash"), "length", F.col("payload").cast("string").alias("name"))


def directory_scan(s, d):
    """Files named after nations: what the scan lists, and which are candidates."""
    folder = _local(s)
    for k, n in _nations(s, d):
        with open(f"{folder}/{n}{('.zip', '.zip.part', '.cab', '')[k % 4]}", "wb") as f:
            f.write((b"PK\x03\x04" if k % 4 != 2 else b"MSCF") + n.encode() + bytes(10 + k))
    files = scan.list_directory(s, folder)
    c = scan.candidates(files).select("name", "id", "format", "rank")
    slices = [(os.path.basename(r.path), scan.read_slice(r.path, 4, 3).decode()) for r in files.select("path").collect()]
    return files.select("name", "length").join(c, "name", "left").join(s.createDataFrame(slices, "name string, slice string"), "name")


def sinks(s, d):
    """Members in a ZIP of stored entries and in a directory, both read back; one name climbs out and is refused."""
    folder, names = _local(s), _nations(s, d)
    members = [(f"m/{n}.txt", f"{n} {k}".encode()) for k, n in names]
    out = []
    with zipfile.ZipFile(io.BytesIO(repack.write_zip(members))) as z:
        out += [("zip", x.filename, x.file_size, x.CRC, hashlib.sha256(z.read(x)).hexdigest()) for x in z.infolist() if x.compress_type == zipfile.ZIP_STORED]
    try:
        repack.write_dir([("../out", b"")], folder)
        out.append(("dir", "../out", 0, None, None))
    except ValueError:
        pass
    repack.write_dir(members, folder)
    for name, _ in members:
        with open(f"{folder}/{name}", "rb") as f:
            data = f.read()
        out.append(("dir", name, len(data), zipfile.crc32(data), hashlib.sha256(data).hexdigest()))
    rows = s.createDataFrame(out, "sink string, name string, size long, crc long, sha256 string")
    return rows.select("sink", "name", "size", "sha256")


def chunk_params(s, d):
    """Parameters for a wanted average and a limit taken from orders."""
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_custkey") * 37 % 200_000).cast("long").alias("avg"), (F.col("o_orderkey") * 91 % 400_000 + 1024).cast("long").alias("max"))

    def f(key, avg, most):
        p = ChunkParams.of(avg, most)
        strict, lenient = chunker.masks(p)
        return [(key, p.min, p.avg, p.max, f"{strict:016x}", f"{lenient:016x}")]

    return _each(o, f, "o_orderkey long, chunk_min long, chunk_avg long, chunk_max long, strict string, lenient string", "o_orderkey", "avg", "max")


def gear_table(s, d):
    return s.createDataFrame([(k, f"{x:016x}") for k, x in enumerate(chunker.GEAR.tolist())], "k int, word string")


def cdc_turns(s, d):
    """Content-defined blocks of every turn of the conversations."""
    t = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return chunker.chunk(t, CDC, ("conv_id", "turn"), "text", keep=False).select("conv_id", "turn", "seq", "length", F.lower(F.hex("hash")).alias("hash"))


def cdc_pushed(s, d):
    """The same for bytes that arrive in slices of any size."""
    t = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))

    def f(conv, turn, text):
        c, data, at, out = chunker.PushChunker(CDC), text.encode(), 0, []
        while at < len(data):
            n = 1 + (at * 7 + conv) % 700
            out += c.feed(data[at : at + n])
            at += n
        return [(conv, turn, k, len(b), hashlib.sha256(b).hexdigest()) for k, b in enumerate(out + c.close())]

    return _each(t, f, "conv_id long, turn long, seq int, length int, hash string", "conv_id", "turn", "text")


def cab_checksums(s, d):
    t = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return _each(t, lambda c, n, text: [(c, n, scalars.cab_checksum(text.encode(), c))], "conv_id long, turn long, checksum long", "conv_id", "turn", "text")


def mixed_words(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    return _each(o, lambda a, b: [(a, f"{scalars.mix(a, b, 7):016x}")], "o_orderkey long, word string", "o_orderkey", "o_custkey")


_BAD = b"PK\x03\x04" + bytes(40)


def _nested(name: str) -> bytes:
    return _zip_of([("a.txt", name.encode()), ("in.cab", cab_codec.write([("b.txt", (name + " inside").encode())])), ("bad.zip", _BAD)])


def _archives(s, d) -> DataFrame:
    t = s.read.parquet(f"{d}/supplier.parquet").select("s_name")
    return _each(t, lambda n: [(n, _nested(n))], "version_id string, payload binary", "s_name")


def decompose_nodes(s, d):
    """An archive for each supplier, a cabinet and a broken ZIP in it: the nodes, and the digest of what the leaves hold."""
    x = Decomposed(_archives(s, d), scratch(s), CDC)
    blobs = rebuild.concat_blocks(x.refs, x.blocks, ["version_id", "path"]).select("version_id", "path", F.sha2("payload", 256).alias("sha256"))
    path = F.array_join(F.col("path").cast("array<string>"), "/").alias("path")
    nodes = x.nodes.join(blobs, ["version_id", "path"], "left")
    opaque = x.events.filter("event = 'opaque'").groupBy("version_id").agg(F.count("*").alias("opaque"))
    return nodes.select("version_id", path, "depth", "kind", F.when(F.col("kind") == "blob", F.col("size")).alias("size"), "sha256").join(opaque, "version_id")


def rebuild_exact(s, d):
    """The same archives from their blocks again."""
    archives = _archives(s, d)
    x = Decomposed(archives, scratch(s), CDC)
    want = archives.select("version_id", F.sha2("payload", 256).alias("sha256"))
    return rebuild.verify(rebuild.rebuild_versions(x.nodes, x.refs, x.blocks), want, ["version_id"]).select("version_id", "verified")


_B = f"""d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, text, unnest(range(0, (len(text) + {PART - 1}) // {PART})) AS seq FROM d),
b AS (SELECT doc_id, seq::INT AS seq, sha256(substr(text, (seq * {PART} + 1)::BIGINT, {PART})) AS hash, strlen(substr(text, (seq * {PART} + 1)::BIGINT, {PART}))::INT AS length FROM x)"""
_GEAR = "[" + ", ".join(f"{x}::UHUGEINT" for x in chunker.GEAR.tolist()) + "]"
_STRICT, _LENIENT = chunker.masks(CDC)
_CDC_SQL = f"""WITH RECURSIVE g AS MATERIALIZED (SELECT {_GEAR} AS gear),
t AS MATERIALIZED (SELECT conv_id, turn, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, ''))::BIGINT AS n FROM conversations),
r AS (SELECT conv_id, turn, hx, n, 0::BIGINT AS i, 0::BIGINT AS start, 0::UHUGEINT AS fp, NULL::BIGINT AS cut, 0::BIGINT AS cut_from FROM t WHERE n > 0
  UNION ALL SELECT conv_id, turn, hx, n, CASE WHEN c IS NULL THEN j + 1 ELSE c END, CASE WHEN c IS NULL THEN start ELSE c END, CASE WHEN c IS NULL THEN f ELSE 0::UHUGEINT END, c, start FROM (
    SELECT *, CASE WHEN n - start <= {CDC.min} THEN n WHEN j >= least(n, start + {CDC.max}) THEN j WHEN (f & (CASE WHEN j - start < {CDC.avg} THEN {_STRICT}::UHUGEINT ELSE {_LENIENT}::UHUGEINT END)) = 0 THEN j END AS c FROM (
      SELECT *, (fp * 2 + gear[coalesce(try_cast('0x' || substr(hx, 2 * j + 1, 2) AS INT), 0) + 1]) % 18446744073709551616::UHUGEINT AS f FROM (
        SELECT r.*, g.gear, CASE WHEN i - start < {CDC.min} AND n - start > {CDC.min} THEN start + {CDC.min} ELSE i END AS j FROM r, g WHERE start < n)))),
k AS (SELECT conv_id, turn, hx, cut_from, cut FROM r WHERE cut IS NOT NULL)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY cut) - 1)::INT AS seq, (cut - cut_from)::INT AS length, sha256(unhex(substr(hx, 2 * cut_from + 1, 2 * (cut - cut_from)))) AS hash FROM k"""

#: name: (query, SQL)
FORMATS = {
    "zip_members": (_members(zip_codec, _zip_of), _members_sql("true")),
    "cab_members": (_members(cab_codec, cab_codec.write), _members_sql("text <> ''")),
    "frames_read": (frames_read, f"WITH {_B} SELECT * FROM b"),
    "frames_damaged": (
        frames_damaged,
        f"WITH {_B}, c AS (SELECT doc_id, count(*) AS frames, sum(length)::BIGINT AS bytes FROM b GROUP BY doc_id) SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 2 THEN 'truncated' WHEN d.doc_id % 3 = 1 AND text <> '' THEN 'changed' ELSE 'whole' END AS verdict, CASE WHEN verdict = 'whole' THEN coalesce(frames, 0) END AS frames, CASE WHEN verdict = 'whole' THEN coalesce(bytes, 0) END AS bytes FROM d LEFT JOIN c ON c.doc_id = d.doc_id",
    ),
    "hash_lists": (hash_lists, f"WITH {_B}, c AS (SELECT doc_id, count(*) AS n, arg_max(hash, seq) AS last FROM b GROUP BY doc_id) SELECT d.doc_id, 9 + 32 * coalesce(n, 0) AS bytes, coalesce(n, 0) AS hashes, last FROM d LEFT JOIN c ON c.doc_id = d.doc_id"),
    "gzip_exact": (gzip_exact, "SELECT doc_id, doc_id % 10 AS level, sha256(coalesce(text, '')) AS sha256 FROM documents"),
    "blueprint_round_trip": (blueprint_round_trip, f"WITH {_B} SELECT b.doc_id, b.doc_id AS max_seven_z, strlen(text)::BIGINT AS size, seq, hash, length FROM b JOIN d ON b.doc_id = d.doc_id"),
    "index_round_trip": (
        index_round_trip,
        "WITH v AS (SELECT coalesce(source, 'none') AS id, sum(strlen(coalesce(text, '')))::BIGINT AS size, count(*) AS block_refs, count(DISTINCT coalesce(text, '')) AS distinct_blocks FROM documents GROUP BY 1) SELECT id, id || '.zip' AS file_name, size, sha256(id) AS sha256, sha256(id || 'b') AS blueprint_sha256, 7::BIGINT AS blueprint_bytes, block_refs, distinct_blocks, 1::BIGINT AS containers, 0::BIGINT AS opaque_containers, '2024-01-01T00:00:00Z' AS ingested_at, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KiB', floor(size * 100 / 1024.0 + 0.5) / 100) WHEN size < 1073741824 THEN printf('%.2f MiB', floor(size * 100 / 1048576.0 + 0.5) / 100) ELSE printf('%.2f GiB', floor(size * 100 / 1073741824.0 + 0.5) / 100) END AS size_human, 'SHA-256' AS hash_algorithm, CASE WHEN size % 2 = 0 THEN '2024-01-02T00:00:00.000000001Z' END AS file_modified, 1024 AS chunk_max FROM v",
    ),
    "store_get": (store_get, f"WITH {_B} SELECT DISTINCT hash, length, hash AS sha256 FROM b WHERE doc_id % 7 = 3"),
    "pack_replay": (pack_replay, "SELECT sha256(n_name) AS hash, strlen(n_name)::INT AS length, n_name AS name FROM nation WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation)"),
    "directory_scan": (
        directory_scan,
        "WITH f AS (SELECT n_nationkey AS k, n_name || ['.zip', '.zip.part', '.cab', ''][n_nationkey % 4 + 1] AS name, n_name, (14 + strlen(n_name) + n_nationkey)::BIGINT AS length FROM nation), c AS (SELECT * FROM f WHERE k % 4 <> 1 AND length >= 22) SELECT f.name, f.length, c.n_name AS id, CASE WHEN c.k % 4 = 2 THEN 'CAB' WHEN c.k IS NOT NULL THEN 'ZIP' END AS format, CASE WHEN c.k IS NOT NULL THEN 1 END::INT AS rank, substr(f.n_name, 1, 3) AS slice FROM f LEFT JOIN c ON f.k = c.k",
    ),
    "sinks": (sinks, "WITH m AS (SELECT 'm/' || n_name || '.txt' AS name, n_name || ' ' || n_nationkey AS x FROM nation) SELECT sink, name, strlen(x)::BIGINT AS size, sha256(x) AS sha256 FROM m, (VALUES ('zip'), ('dir')) t(sink)"),
    "chunk_params": (
        chunk_params,
        "WITH o AS (SELECT o_orderkey, (o_custkey * 37 % 200000)::BIGINT AS a, (o_orderkey * 91 % 400000 + 1024)::BIGINT AS m FROM orders), v AS (SELECT *, (1::BIGINT << (len(bin(greatest(1024, least(a, m)))) - 1)::BIGINT) AS avg FROM o), b AS (SELECT *, len(bin(avg)) - 1 AS bits FROM v) SELECT o_orderkey, least(avg, greatest(64, avg // 4)) AS chunk_min, avg AS chunk_avg, least(m, greatest(4 * avg, avg + 1)) AS chunk_max, lpad(lower(hex(((1::HUGEINT << (bits + 2)) - 1) << (61 - bits))), 16, '0') AS strict, lpad(lower(hex(((1::HUGEINT << (bits - 2)) - 1) << (65 - bits))), 16, '0') AS lenient FROM b",
    ),
    "gear_table": (
        gear_table,
        f"WITH RECURSIVE r(k, s) AS (SELECT 0, xor({chunker.GEAR_SEED}::HUGEINT, 25214903917::HUGEINT) % 281474976710656 UNION ALL SELECT k + 1, (s * 25214903917 + 11) % 281474976710656 FROM r WHERE k < 512), w AS (SELECT k, s // 65536 AS x FROM r WHERE k > 0), p AS (SELECT (a.k - 1) // 2 AS k, ((a.x * 4294967296 + b.x - CASE WHEN b.x >= 2147483648 THEN 4294967296 ELSE 0 END) + 18446744073709551616) % 18446744073709551616 AS v FROM w a JOIN w b ON b.k = a.k + 1 WHERE a.k % 2 = 1) SELECT k::INT AS k, lpad(lower(hex(v)), 16, '0') AS word FROM p",
    ),
    "cdc_turns": (cdc_turns, _CDC_SQL),
    "cdc_pushed": (cdc_pushed, _CDC_SQL),
    "cab_checksums": (
        cab_checksums,
        "WITH t AS (SELECT conv_id, turn, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n FROM conversations), w AS (SELECT conv_id, turn, hx, n, list_transform(range(0, n // 4), lambda i: ('0x' || substr(hx, 8 * i + 7, 2) || substr(hx, 8 * i + 5, 2) || substr(hx, 8 * i + 3, 2) || substr(hx, 8 * i + 1, 2))::BIGINT) AS words, substr(hx, 8 * (n // 4) + 1) AS rest FROM t) SELECT conv_id, turn, list_reduce(list_prepend(conv_id, list_append(words, CASE WHEN rest = '' THEN 0 ELSE ('0x' || rest)::BIGINT END)), lambda a, x: xor(a, x))::BIGINT AS checksum FROM w",
    ),
    "mixed_words": (
        mixed_words,
        "WITH a AS (SELECT o_orderkey, (o_orderkey::UHUGEINT * 11400714819323198485 % 18446744073709551616 + o_custkey::UHUGEINT * 13787848793156543929 % 18446744073709551616 + 7::UHUGEINT * 10723151780598845931 % 18446744073709551616) % 18446744073709551616 AS x FROM orders), b AS (SELECT o_orderkey, xor(x, x // 1073741824) * 13787848793156543929 % 18446744073709551616 AS x FROM a), c AS (SELECT o_orderkey, xor(x, x // 134217728) * 10723151780598845931 % 18446744073709551616 AS x FROM b) SELECT o_orderkey, lpad(lower(hex(xor(x, x // 2147483648))), 16, '0') AS word FROM c",
    ),
    "decompose_nodes": (
        decompose_nodes,
        f"WITH n AS (SELECT s_name AS version_id, s_name || ' inside' AS inner_text FROM supplier) SELECT version_id, path, depth::INT AS depth, kind, size::BIGINT AS size, sha256, 1::BIGINT AS opaque FROM (SELECT version_id, '0' AS path, 0 AS depth, 'container' AS kind, NULL AS size, NULL AS sha256 FROM n UNION ALL SELECT version_id, '0/0', 1, 'blob', strlen(version_id), sha256(version_id) FROM n UNION ALL SELECT version_id, '0/1', 1, 'container', NULL, NULL FROM n UNION ALL SELECT version_id, '0/1/0', 2, 'blob', strlen(inner_text), sha256(inner_text) FROM n UNION ALL SELECT version_id, '0/2', 1, 'blob', {len(_BAD)}, '{hashlib.sha256(_BAD).hexdigest()}' FROM n)",
    ),
    "rebuild_exact": (rebuild_exact, "SELECT s_name AS version_id, true AS verified FROM supplier"),
}
