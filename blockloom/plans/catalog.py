"""Queries over the driver's tables, by name, and SQL that gives the same rows where there is any.

Leaf payloads are whole texts of documents. v01 is all of them; v02 drops ids 7 modulo 100 and revises ids 5 modulo 33.
Relational operators take any blocks: where SQL must follow, blocks are stretches of GRID characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import cab as cab_codec
from ..codecs import zip as zip_codec
from ..codecs.framing import deflate, probe_level
from ..functions import scalars
from ..functions.chunker import chunk
from ..model import ChunkParams, DecomposeLimits
from ..operators import delta, rebuild, repack, store, tree
from ..sources import index, scan
from .formats import FORMATS

GRID = 256
CDC = ChunkParams(64, 256, 1024)
HEX = "lower(hex(hash))"

#: Inputs in expressions that both Spark and the SQL of a query read.
_NAME = "CASE p_partkey % 16 WHEN 0 THEN '../' || p_name WHEN 1 THEN '/' || p_name WHEN 2 THEN 'c:' || chr(92) || p_name WHEN 3 THEN 'a//' || p_name WHEN 4 THEN './' || p_name WHEN 5 THEN p_name || '/' WHEN 6 THEN chr(9) || chr(10) WHEN 7 THEN ' ' WHEN 8 THEN '' WHEN 9 THEN 'd' || chr(92) || p_name || '.txt' WHEN 10 THEN 'a/../' || p_name WHEN 11 THEN '.' || p_name WHEN 12 THEN p_name || '.zip.PART' WHEN 13 THEN p_name || '.crdownload' WHEN 14 THEN p_name || '.b.zip' ELSE 'd/e ' || p_name END"
_SIZE_TEXT = "CASE o_orderkey % 13 WHEN 0 THEN o_custkey || '' WHEN 1 THEN o_custkey || 'k' WHEN 2 THEN ' ' || o_custkey || '.5 MB ' WHEN 3 THEN o_custkey || ',25g' WHEN 4 THEN o_custkey || 'TiB' WHEN 5 THEN o_custkey || ' kib' WHEN 6 THEN o_custkey || 'ib' WHEN 7 THEN o_custkey || 'b' WHEN 8 THEN 'x' || o_custkey WHEN 9 THEN '' WHEN 10 THEN o_custkey || '..2k' WHEN 11 THEN o_custkey || 'kk' ELSE o_custkey || 'mb' END"
_HEAD = "CASE o_orderkey % 7 WHEN 0 THEN '504B0304140000000800' WHEN 1 THEN '504B0506000000000000' WHEN 2 THEN '4D53434600000000' WHEN 3 THEN '377ABCAF271C0004' WHEN 4 THEN '7F454C4602010100' WHEN 5 THEN '504B01' ELSE '' END"
_ACCEPT = "CASE event_id % 5 WHEN 0 THEN 'gzip' WHEN 1 THEN 'br, GZIP;q=0' WHEN 2 THEN event_type WHEN 3 THEN NULL ELSE 'deflate, ' || event_type || ', gzip' END"
#: Files of a folder, and an index of versions, made of customers.
_FILE = "'a/v' || c_custkey % 700 || CASE c_custkey % 3 WHEN 0 THEN '.7z' WHEN 1 THEN '.zip' ELSE '.cab' END || CASE WHEN c_custkey % 17 = 0 THEN '.part' ELSE '' END AS path, 'v' || c_custkey % 700 || CASE c_custkey % 3 WHEN 0 THEN '.7z' WHEN 1 THEN '.zip' ELSE '.cab' END || CASE WHEN c_custkey % 17 = 0 THEN '.part' ELSE '' END AS name, c_custkey % 700 * 10 AS length, '2024-01-01T00:00:00.' || c_custkey % 7 || 'Z' AS modified"
_INDEXED = "'v' || c_custkey AS id, c_custkey * 10 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN c_custkey % 4 > 0 THEN '2024-01-01T00:00:00.' || c_custkey % 7 || 'Z' END AS file_modified, c_custkey % 13 > 0 AS bp"



def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def _v02(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id") % 100 != 7).withColumn("text", F.when(F.col("doc_id") % 33 == 5, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text")))


def grid(docs: DataFrame, *keep: str) -> DataFrame:
    """Stretches of GRID characters: doc_id, seq, hash, length, payload."""
    cuts = F.when(F.length("text") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / GRID).cast("int")), lambda i: F.substring(F.col("text"), i * GRID + 1, F.lit(GRID))))
    rows = docs.select("doc_id", *keep, F.posexplode(cuts).alias("seq", "part")).withColumn("payload", F.encode("part", "UTF-8"))
    return rows.select("doc_id", *keep, "seq", scalars.sha256(F.col("payload")).alias("hash"), F.octet_length("payload").alias("length"), "payload")


def _ordered(blocks: DataFrame) -> DataFrame:
    """pos: a number that orders a version's blocks by document and place."""
    return blocks.withColumn("pos", F.col("doc_id") * (1 << 24) + F.col("seq"))


def _cdc(docs: DataFrame) -> DataFrame:
    return chunk(docs, CDC, ("doc_id",), "text", keep=False)


def _of(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").selectExpr(*columns)


def _files(spark: SparkSession, d: str) -> DataFrame:
    files = spark.sql(f"SELECT {_FILE} FROM {{c}}", c=spark.read.parquet(f"{d}/customer.parquet"))
    return store.first_version_wins(files.filter(scalars.not_transient(F.col("name"))).withColumn("id", scalars.version_id(F.col("name"))))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).filter("rank = 1")
    known = spark.sql(f"SELECT {_INDEXED} FROM {{c}} WHERE c_custkey < 600", c=spark.read.parquet(f"{d}/customer.parquet"))
    return scan.pending(files, known, known.filter("bp").select("id")).select("id", "path", "action")



def _move(spark, d):
    docs = _docs(spark, d)
    return _ordered(grid(_v02(docs))), grid(docs)


def cdc_blocks(spark, d):
    return _cdc(_docs(spark, d)).select("doc_id", "seq", "length", F.expr(HEX).alias("hash"))


def transfer_metrics(spark, d):
    docs = _docs(spark, d)
    return delta.transfer_metrics(_ordered(_cdc(_v02(docs))), _cdc(docs))


def tree_nodes(spark, d):
    r, n, c = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation", "customer"))
    return r.select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("ordinal")).unionByName(
        n.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").alias("ordinal"))
    ).unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_custkey").cast("int").alias("ordinal")))


def blueprint_stats(spark, d):
    docs = _docs(spark, d)
    blobs = docs.select(F.col("source").alias("version_id"), F.lit("blob").alias("kind"), F.octet_length("text").alias("size"))
    boxes = docs.select(F.col("source").alias("version_id")).distinct().select("version_id", F.lit("container").alias("kind"), F.lit(0).alias("size"))
    return tree.blueprint_stats(blobs.unionByName(boxes), grid(docs, "source").withColumnRenamed("source", "version_id"))


def composite_lookup(spark, d):
    docs = _docs(spark, d)
    odd, all_ = grid(docs.filter("doc_id % 2 = 1")), grid(docs)
    return store.composite(odd, all_).select(F.expr(HEX).alias("hash"), "length", "source")


def request_order(spark, d):
    """All blocks of all documents, asked for in descending order of ids; copies are served again."""
    blocks = grid(_docs(spark, d))
    ask = blocks.select((-F.col("doc_id") * (1 << 24) + F.col("seq")).alias("seq"), "hash")
    return delta.fetch(ask, store.distinct_blocks(blocks)).select("seq", F.expr(HEX).alias("hash"), "length")



def reassemble_verify(spark, d):
    """Every document from its blocks; one without blocks is empty."""
    docs = _docs(spark, d)
    blocks = grid(docs)
    made = rebuild.concat_blocks(blocks.select("doc_id", "seq", "hash"), store.distinct_blocks(blocks), ["doc_id"])
    whole = docs.select("doc_id").join(made, "doc_id", "left").withColumn("payload", F.coalesce("payload", F.lit(b"")))
    return rebuild.verify(whole, docs.select("doc_id", F.sha2("text", 256).alias("sha256")), ["doc_id"])



def frame_verify(spark, d):
    """Every 13th block arrives with a flipped first byte: per document frames, bytes and how many match their hash."""
    f = grid(_docs(spark, d)).withColumn("got", F.when((F.col("doc_id") + F.col("seq")) % 13 == 0, F.concat(F.lit(b"\x00"), F.substring("payload", 2, 1 << 20))).otherwise(F.col("payload")))
    ok = scalars.sha256(F.col("got")) == F.col("hash")
    return f.groupBy("doc_id").agg(F.count("*").alias("frames"), F.sum(F.col("length").cast("long")).alias("bytes"), F.count_if(ok).alias("matching"), (F.count("*") * 37 + 17 + F.sum(F.col("length").cast("long"))).alias("stream_bytes"))


def member_equality(spark, d):
    docs = _docs(spark, d)
    return repack.member_equality(*(x.select(F.concat(F.lit("f"), "doc_id").alias("name"), F.sha2("text", 256).alias("hash")) for x in (docs, _v02(docs))))


def repack_supported(spark, d):
    """Members named after their documents; one name in 50 climbs out, part 3 of a source is missing for ids 11 modulo 400."""
    docs = _docs(spark, d).withColumn("version_id", F.concat("source", F.lit("-"), F.col("doc_id") % 40))
    name = F.when(F.col("doc_id") % 50 == 9, F.concat(F.lit("../"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("f/"), F.col("doc_id").cast("string")))
    return repack.is_supported(docs.select("version_id", name.alias("name"), F.col("doc_id").alias("part_index")), docs.filter("doc_id % 400 != 11").select("version_id", F.col("doc_id").alias("ordinal")))


def version_list(spark, d):
    docs = _docs(spark, d)
    v = docs.groupBy(F.col("source").alias("id")).agg(F.concat(F.col("source"), F.lit(".zip")).alias("file_name"), F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("block_refs"))
    return v.select("id", "file_name", "size", scalars.human(F.col("size")).alias("size_human"), "block_refs", F.lit("SHA-256").alias("hash_algorithm"))


def config_views(spark, d):
    params = spark.createDataFrame([(1, "SHA-256", 16384, 65536, 262144)], "format_version int, hash_algorithm string, chunk_min int, chunk_avg int, chunk_max int")
    return index.admin_config(params, store.store_stats(grid(_docs(spark, d))), 512 << 20, True).join(index.client_config(params), ["hash_algorithm", "max_block_size"])


def _round_trip(spark, d, codec, make):
    """Each text in an archive of its own with a second member: opened, rebuilt, compared."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                data = make([("text.txt", text.encode()), ("copy.txt", text.encode()[::-1])])
                opened = codec.decompose(data, DecomposeLimits())
                out.append((i, len(data), len(opened[1]) if opened else 0, bool(opened) and codec.rebuild(*opened) == data))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["doc_id", "archive_bytes", "parts", "exact"])

    return _docs(spark, d).select("doc_id", "text").mapInArrow(run, "doc_id long, archive_bytes long, parts long, exact boolean")


def _zip_of(members):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def level_probe(spark, d):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), [t.encode() for t in b.column("text").to_pylist()]
            made = [1 + i % 9 for i in ids]
            again = [deflate(t, probe_level(t, deflate(t, m), None)) == deflate(t, m) for t, m in zip(texts, made)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.int64()), pa.array(again, pa.bool_())], ["doc_id", "level", "found"])

    return _docs(spark, d).select("doc_id", "text").mapInArrow(run, "doc_id long, level long, found boolean")


def crc32_payload(spark, d):
    return _docs(spark, d).select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc32"))


def gzip_ratio(spark, d):
    """Bytes of each source's texts as they are and in gzip at level 1."""

    def run(batches):
        import pyarrow as pa

        from ..sources.wire import gzip

        for b in batches:
            texts = [t.encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(gzip(t)) for t in texts], pa.int64())], ["source", "raw", "packed"])

    each = _docs(spark, d).select("source", "text").mapInArrow(run, "source string, raw long, packed long")
    sums = each.groupBy("source").agg(F.sum("raw").alias("raw"), F.sum("packed").alias("packed"))
    return sums.withColumn("compression_ratio", scalars.compression_ratio(F.col("packed"), F.col("raw")))


_GRID_SQL = f"""
d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, source, CASE WHEN doc_id % 33 = 5 THEN text || ' (revised)' ELSE text END AS text FROM d WHERE doc_id % 100 <> 7),
gi AS (SELECT doc_id, source, text, unnest(range(0, (len(text) + {GRID - 1}) // {GRID})) AS seq FROM d),
g AS (SELECT doc_id, source, seq::INT AS seq, substr(text, (seq * {GRID} + 1)::BIGINT, {GRID}) AS part FROM gi),
b AS (SELECT *, sha256(part) AS hash, strlen(part)::INT AS length FROM g),
hi AS (SELECT doc_id, text, unnest(range(0, (len(text) + {GRID - 1}) // {GRID})) AS seq FROM e),
h AS (SELECT doc_id, seq::INT AS seq, substr(text, (seq * {GRID} + 1)::BIGINT, {GRID}) AS part FROM hi),
n AS (SELECT doc_id, seq, sha256(part) AS hash, strlen(part)::INT AS length, doc_id * 16777216 + seq AS pos FROM h)"""
_HUMAN = "CASE WHEN {0} < 1024 THEN format('{{}} B', {0}) WHEN {0} < 1048576 THEN printf('%.2f KiB', floor({0} * 100 / 1024.0 + 0.5) / 100) WHEN {0} < 1073741824 THEN printf('%.2f MiB', floor({0} * 100 / 1048576.0 + 0.5) / 100) WHEN {0} < 1099511627776 THEN printf('%.2f GiB', floor({0} * 100 / 1073741824.0 + 0.5) / 100) ELSE printf('%.2f TiB', floor({0} * 100 / 1099511627776.0 + 0.5) / 100) END"
_SANE = r"(CASE WHEN regexp_matches(name, '^\s*$') OR contains(name, ':') OR regexp_matches(replace(name, '\', '/'), '(^|/)(\.\.?)?(/|$)') THEN NULL ELSE replace(name, '\', '/') END)"
_ID = r"regexp_replace(name, '^(.+)\.[^.]*$', '\1')"
_FILES_SQL = f"f AS (SELECT *, {_ID} AS id FROM (SELECT {_FILE} FROM customer) WHERE name NOT LIKE '%.part'), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path)::INT AS rank FROM f)"
_PENDING_SQL = f"WITH {_FILES_SQL}, i AS (SELECT {_INDEXED} FROM customer WHERE c_custkey < 600), p AS (SELECT o.id, path, CASE WHEN i.id IS NULL THEN 'new' WHEN bp AND size = length AND file_modified IS NULL THEN 'adopt' WHEN bp AND size = length AND file_modified = modified THEN 'skip' ELSE 'reingest' END AS action FROM o LEFT JOIN i ON o.id = i.id WHERE rank = 1)"

#: name: (query, SQL or None)
_CATALOG = {
    "transfer_metrics": (transfer_metrics, None),
    "cdc_blocks": (cdc_blocks, None),
    "block_digest": (lambda s, d: _docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size")), "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS size FROM documents"),
    "grid_blocks": (lambda s, d: grid(_docs(s, d)).select("doc_id", "seq", F.expr(HEX).alias("hash"), "length"), f"WITH {_GRID_SQL} SELECT doc_id, seq, hash, length FROM b"),
    "store_dedup": (lambda s, d: store.distinct_blocks(grid(_docs(s, d))).select(F.expr(HEX).alias("hash"), "length"), f"WITH {_GRID_SQL} SELECT hash, any_value(length) AS length FROM b GROUP BY hash"),
    "store_stats": (lambda s, d: store.store_stats(grid(_docs(s, d))), f"WITH {_GRID_SQL} SELECT count(*) AS chunk_count, sum(length)::BIGINT AS stored_bytes FROM (SELECT DISTINCT hash, length FROM b)"),
    "put_is_new": (
        lambda s, d: store.put_is_new(_ordered(grid(_docs(s, d))).select("doc_id", "seq", "hash", "pos"), "pos").select("doc_id", "seq", "is_new"),
        f"WITH {_GRID_SQL} SELECT doc_id, seq, row_number() OVER (PARTITION BY hash ORDER BY doc_id, seq) = 1 AS is_new FROM b",
    ),
    "store_import": (
        lambda s, d: store.store_import(grid(_docs(s, d).filter("doc_id % 2 = 0")), grid(_docs(s, d))).select(F.expr(HEX).alias("hash"), "length"),
        f"WITH {_GRID_SQL} SELECT DISTINCT hash, length FROM b WHERE hash NOT IN (SELECT hash FROM b WHERE doc_id % 2 = 0)",
    ),
    "composite_lookup": (composite_lookup, f"WITH {_GRID_SQL} SELECT hash, any_value(length) AS length, CASE WHEN bool_or(doc_id % 2 = 1) THEN 0 ELSE 1 END AS source FROM b GROUP BY hash"),
    "distinct_chunks_ordered": (
        lambda s, d: tree.distinct_chunks(_ordered(grid(_docs(s, d), "source")).withColumnRenamed("source", "version_id")).select("version_id", F.expr(HEX).alias("hash"), "length", "first_pos"),
        f"WITH {_GRID_SQL} SELECT source AS version_id, hash, any_value(length) AS length, min(doc_id * 16777216 + seq) AS first_pos FROM b GROUP BY source, hash",
    ),
    "blueprint_order": (
        lambda s, d: tree.in_blueprint_order(grid(_docs(s, d), "source").withColumnRenamed("source", "version_id").select("version_id", "doc_id", "seq"), ["doc_id", "seq"]),
        f"WITH {_GRID_SQL} SELECT source AS version_id, doc_id, seq, (row_number() OVER (PARTITION BY source ORDER BY doc_id, seq) - 1)::INT AS pos FROM b",
    ),
    "blueprint_stats": (
        blueprint_stats,
        f"WITH {_GRID_SQL} SELECT x.source AS version_id, 1::BIGINT AS containers, blobs, coalesce(chunk_refs, 0) AS chunk_refs, coalesce(distinct_chunks, 0) AS distinct_chunks, blob_bytes FROM (SELECT source, count(*) AS blobs, sum(strlen(text))::BIGINT AS blob_bytes FROM d GROUP BY source) x LEFT JOIN (SELECT source, count(*) AS chunk_refs, count(DISTINCT hash) AS distinct_chunks FROM b GROUP BY source) y ON x.source IS NOT DISTINCT FROM y.source",
    ),
    "tree_walk": (
        lambda s, d: tree.walk(tree_nodes(s, d)).select("node_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path")),
        "SELECT 'r' || r_regionkey AS node_id, 0 AS depth, r_regionkey::VARCHAR AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, n_regionkey || '/' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 2, n_regionkey || '/' || n_nationkey || '/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "missing_blocks": (
        lambda s, d: delta.missing_blocks(*_move(s, d)).select(F.expr(HEX).alias("hash"), "length", "first_pos"),
        f"WITH {_GRID_SQL} SELECT hash, any_value(length) AS length, min(pos) AS first_pos FROM n WHERE hash NOT IN (SELECT hash FROM b) GROUP BY hash",
    ),
    "reused_blocks": (
        lambda s, d: delta.reused_blocks(*_move(s, d)).select(F.expr(HEX).alias("hash"), "length", "first_pos"),
        f"WITH {_GRID_SQL} SELECT hash, any_value(length) AS length, min(pos) AS first_pos FROM n WHERE hash IN (SELECT hash FROM b) GROUP BY hash",
    ),
    "blocks_in_request_order": (request_order, f"WITH {_GRID_SQL} SELECT -doc_id * 16777216 + seq AS seq, hash, length FROM b"),
    "transfer_metrics_grid": (
        lambda s, d: delta.transfer_metrics(*_move(s, d)),
        f"""WITH {_GRID_SQL}, o AS (SELECT hash, any_value(length)::BIGINT AS length, hash IN (SELECT hash FROM b) AS have FROM n GROUP BY hash),
m AS (SELECT count(*) AS blocks_needed, count(*) FILTER (NOT have) AS blocks_missing, count(*) FILTER (have) AS blocks_reused, sum(length)::BIGINT AS distinct_bytes, coalesce(sum(length) FILTER (NOT have), 0)::BIGINT AS block_bytes, (SELECT sum(length)::BIGINT FROM n) AS size FROM o)
SELECT *, block_bytes AS transferred_bytes, block_bytes + blocks_missing * 37 + 17 AS wire_bytes, CASE WHEN size = 0 THEN 0 ELSE 1.0::DOUBLE - block_bytes::DOUBLE / size END AS saved_fraction,
CASE WHEN size = 0 THEN 0 ELSE 1.0::DOUBLE - (block_bytes + blocks_missing * 37 + 17)::DOUBLE / size END AS wire_saved_fraction, CASE WHEN block_bytes = 0 THEN 1 ELSE (block_bytes + blocks_missing * 37 + 17)::DOUBLE / block_bytes END AS compression_ratio FROM m""",
    ),
    "reassemble_verify": (reassemble_verify, "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, true AS verified FROM documents"),
    "frame_verify": (
        frame_verify,
        f"WITH {_GRID_SQL} SELECT doc_id, count(*) AS frames, sum(length)::BIGINT AS bytes, count(*) FILTER ((doc_id + seq) % 13 <> 0) AS matching, (count(*) * 37 + 17 + sum(length))::BIGINT AS stream_bytes FROM b GROUP BY doc_id",
    ),
    "member_equality": (
        member_equality,
        "SELECT 'f' || doc_id AS name, doc_id % 100 <> 7 AND doc_id % 33 <> 5 AS equal FROM documents",
    ),
    "repack_supported": (repack_supported, "SELECT source || '-' || doc_id % 40 AS version_id, bool_and(doc_id % 400 <> 11 AND doc_id % 50 <> 9) AS supported FROM documents GROUP BY 1"),
    "version_list": (version_list, f"SELECT *, {_HUMAN.format('size')} AS size_human, 'SHA-256' AS hash_algorithm FROM (SELECT source AS id, source || '.zip' AS file_name, sum(strlen(coalesce(text, '')))::BIGINT AS size, count(*) AS block_refs FROM documents GROUP BY source)"),
    "point_lookup": (lambda s, d: version_list(s, d).filter("id = 'src3'").select("id", "size"), "SELECT source AS id, sum(strlen(coalesce(text, '')))::BIGINT AS size FROM documents WHERE source = 'src3' GROUP BY source"),
    "list_count": (lambda s, d: version_list(s, d).agg(F.count("*").alias("count")), "SELECT count(DISTINCT source) AS count FROM documents"),
    "config_views": (
        config_views,
        f"WITH {_GRID_SQL}, t AS (SELECT count(*) AS chunk_count, sum(length)::BIGINT AS stored_bytes FROM (SELECT DISTINCT hash, length FROM b)) SELECT 'SHA-256' AS hash_algorithm, 262144 AS max_block_size, 16384 AS chunk_min, 65536 AS chunk_avg, 262144 AS chunk_max, chunk_count, stored_bytes, {_HUMAN.format('stored_bytes')} AS stored_human, 536870912 AS max_seven_z, true AS compress FROM t",
    ),
    "container_counters": (
        lambda s, d: tree.container_counters(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("version_id"), F.when(F.col("event_id") % 3 == 0, "opaque").otherwise("container").alias("event"))),
        "SELECT event_type AS version_id, count(*) FILTER (event_id % 3 <> 0) AS containers, count(*) FILTER (event_id % 3 = 0) AS opaque_containers FROM events GROUP BY event_type",
    ),
    "bucket_totals": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").groupBy(scalars.name_bucket(F.col("p_name"), 9).alias("bucket")).agg(F.sum(F.col("p_size").cast("long")).alias("bytes"), F.count("*").alias("files")),
        "WITH h AS (SELECT p_size, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM part) SELECT (((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 9 + 9) % 9)::BIGINT AS bucket, sum(p_size)::BIGINT AS bytes, count(*) AS files FROM h GROUP BY 1",
    ),
    "version_ids": (
        lambda s, d: _of(s, d, "part", "p_partkey", f"{_NAME} AS name").select("p_partkey", scalars.version_id(F.col("name")).alias("id"), scalars.not_transient(F.col("name")).alias("listed")),
        f"SELECT p_partkey, CASE WHEN strpos(reverse(name), '.') = 0 OR strpos(reverse(name), '.') = len(name) THEN name ELSE left(name, len(name) - strpos(reverse(name), '.')) END AS id, NOT (left(name, 1) = '.' OR lower(right(name, 5)) = '.part' OR lower(right(name, 4)) = '.tmp' OR lower(right(name, 11)) = '.crdownload') AS listed FROM (SELECT p_partkey, {_NAME} AS name FROM part)",
    ),
    "sanitise_names": (lambda s, d: _of(s, d, "part", "p_partkey", f"{_NAME} AS name").select("p_partkey", scalars.sanitise(F.col("name")).alias("sane")), f"SELECT p_partkey, {_SANE} AS sane FROM (SELECT p_partkey, {_NAME} AS name FROM part)"),
    "sniff_format": (
        lambda s, d: _of(s, d, "orders", "o_orderkey", f"{_HEAD} AS head", "o_custkey % 50 AS length").select("o_orderkey", scalars.sniff(F.unhex("head"), F.col("length")).alias("format")),
        f"SELECT o_orderkey, CASE WHEN o_custkey % 50 < 22 THEN NULL ELSE ['ZIP', 'ZIP', 'CAB', 'SEVEN_Z', NULL, NULL, NULL][o_orderkey % 7 + 1] END AS format FROM orders",
    ),
    "parse_bytes": (
        lambda s, d: _of(s, d, "orders", "o_orderkey", f"{_SIZE_TEXT} AS text").select("o_orderkey", scalars.parse_bytes(F.col("text")).alias("bytes")),
        "SELECT o_orderkey, floor(CASE o_orderkey % 13 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 1024 WHEN 2 THEN (o_custkey + 0.5) * 1048576 WHEN 3 THEN (o_custkey + 0.25) * 1073741824 WHEN 4 THEN o_custkey * 1099511627776 WHEN 5 THEN o_custkey * 1024 WHEN 7 THEN o_custkey WHEN 12 THEN o_custkey * 1048576 END)::BIGINT AS bytes FROM orders",
    ),
    "human_size": (lambda s, d: _docs(s, d).select("doc_id", scalars.human(F.octet_length("text")).alias("size")), f"SELECT doc_id, {_HUMAN.format('strlen(text)')} AS size FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"),
    "cache_key": (lambda s, d: _docs(s, d).select("doc_id", scalars.cache_key(F.sha2("text", 256), CDC, 512 << 20).alias("key")), "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 24) || '-256-1024-7z536870912' AS key FROM documents"),
    "html_escape": (lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(scalars.escape_html(F.col("html")), 256).alias("escaped")), "SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages"),
    "accepts_gzip": (lambda s, d: _of(s, d, "events", "event_id", f"{_ACCEPT} AS h").select("event_id", scalars.accepts_gzip(F.col("h")).alias("ok")), f"SELECT event_id, coalesce(lower({_ACCEPT}) LIKE '%gzip%', false) AS ok FROM events"),
    "id_collisions": (lambda s, d: _files(s, d).select("path", "id", "rank"), f"WITH {_FILES_SQL} SELECT path, id, rank FROM o"),
    "pending_scan": (_pending, f"{_PENDING_SQL} SELECT * FROM p"),
    "hash_parse": (
        lambda s, d: _docs(s, d).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("xyz")).otherwise(F.sha2("text", 256)).alias("hex")).select("doc_id", scalars.hash_hex(scalars.parse_hash(F.upper("hex"))).alias("hash")),
        "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(coalesce(text, '')) END AS hash FROM documents",
    ),
    "percent_and_seconds": (
        lambda s, d: _docs(s, d).select("doc_id", scalars.percent(F.col("doc_id") / 1024).alias("percent"), scalars.seconds(F.col("doc_id") * 250_000_000).alias("seconds")),
        "SELECT doc_id, printf('%.2f%%', floor(doc_id * 10000 / 1024.0 + 0.5) / 100) AS percent, printf('%.1fs', floor(doc_id * 2.5 + 0.5) / 10) AS seconds FROM documents",
    ),
    "repack_plan": (
        lambda s, d: repack.plan(
            _docs(s, d).select("source", (F.col("doc_id") % 100).alias("k"), "doc_id").select(F.concat("source", F.lit("-"), "k").alias("version_id"), F.concat(F.lit("m\\"), F.col("doc_id").cast("string")).alias("name"), F.col("doc_id").alias("part_index")),
            _docs(s, d).filter("doc_id % 10 != 3").select(F.concat("source", F.lit("-"), F.col("doc_id") % 100).alias("version_id"), F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("content")),
        ).select("version_id", "name", "part_index", "content"),
        "WITH m AS (SELECT source || '-' || doc_id % 100 AS version_id, doc_id, text FROM documents) SELECT version_id, 'm/' || doc_id AS name, doc_id AS part_index, sha256(coalesce(text, '')) AS content FROM m WHERE version_id NOT IN (SELECT version_id FROM m WHERE doc_id % 10 = 3)",
    ),
    "rescan_counts": (
        lambda s, d: _pending(s, d).agg(F.count_if(F.col("action").isin("new", "reingest")).alias("ingested"), F.count("*").alias("total")),
        f"{_PENDING_SQL} SELECT count(*) FILTER (action IN ('new', 'reingest')) AS ingested, count(*) AS total FROM p",
    ),
    "received_totals": (
        lambda s, d: grid(_docs(s, d), "source").groupBy("source").agg(F.count("*").alias("frames"), F.sum(F.col("length").cast("long")).alias("bytes")).withColumn("wire_bytes", F.col("bytes") + scalars.framing_overhead(F.col("frames"))),
        f"WITH {_GRID_SQL} SELECT source, count(*) AS frames, sum(length)::BIGINT AS bytes, (sum(length) + count(*) * 37 + 17)::BIGINT AS wire_bytes FROM b GROUP BY source",
    ),
    "crc32_payload": (crc32_payload, None),
    "gzip_ratio": (gzip_ratio, None),
    "level_probe": (level_probe, "SELECT doc_id, 1 + doc_id % 9 AS level, true AS found FROM documents"),
    "zip_roundtrip": (lambda s, d: _round_trip(s, d, zip_codec, _zip_of), None),
    "cab_roundtrip": (lambda s, d: _round_trip(s, d, cab_codec, cab_codec.write), None),
} | FORMATS


def queries() -> dict:
    return {name: f for name, (f, _) in _CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _CATALOG.items() if sql}
