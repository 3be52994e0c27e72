"""The version store: a folder of archives becomes published versions; a client moves from one to another."""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import time
from datetime import UTC, datetime
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import scalars
from .functions.chunker import DEFAULT_PARAMS
from .model import ChunkParams, DecomposeLimits, RepackMode
from .operators import delta, rebuild, repack, tree
from .operators.decompose import Decomposed
from .operators.store import BlockStore
from .sources import blueprint, index, scan


class VersionStore:
    """path/blocks (Parquet), path/blueprints/<id>.bp, path/nodes, path/refs (Parquet by version), path/index.json.

    A version is published by its line in the index, which is written last: a failure before leaves nothing to be seen.
    Nothing is ever deleted. `path` is a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, archives: str, params: ChunkParams = DEFAULT_PARAMS, limits: DecomposeLimits = DecomposeLimits(), verify: bool = True, force: bool = False) -> None:
        self.spark, self.path, self.archives, self.params, self.limits, self.verify = spark, path.rstrip("/"), archives, params, limits, verify
        if force:
            for x in ("blueprints", "nodes", "refs", "index.json"):
                shutil.rmtree(f"{self.path}/{x}", ignore_errors=True) if x != "index.json" else os.path.exists(f"{self.path}/{x}") and os.remove(f"{self.path}/{x}")
        os.makedirs(f"{self.path}/blueprints", exist_ok=True)
        self.store = BlockStore(spark, f"file://{self.path}", params, force)
        if not os.path.exists(f"{self.path}/index.json"):
            index.save(spark.createDataFrame([], model.VERSIONS), params, f"{self.path}/index.json")

    def versions(self) -> DataFrame:
        return index.load(self.spark, f"{self.path}/index.json")[1].orderBy("id")

    def version(self, id_: str):
        return self.versions().filter(F.col("id") == id_).first()

    def nodes(self, *ids: str) -> DataFrame:
        return self.spark.read.schema(model.NODES).parquet(f"file://{self.path}/nodes").filter(F.col("version_id").isin(*ids))

    def refs(self, *ids: str) -> DataFrame:
        return self.spark.read.schema(model.BLOCK_REFS).parquet(f"file://{self.path}/refs").filter(F.col("version_id").isin(*ids))

    def blueprint(self, id_: str) -> bytes:
        with open(f"{self.path}/blueprints/{id_}.bp", "rb") as f:
            return f.read()

    def pending(self) -> DataFrame:
        have = [(n[:-3],) for n in os.listdir(f"{self.path}/blueprints") if n.endswith(".bp")]
        found = scan.candidates(scan.list_directory(self.spark, self.archives)).filter("rank = 1")
        return scan.pending(found, self.versions(), self.spark.createDataFrame(have, "id string"))

    def rescan(self) -> dict:
        """Ingest what is new or changed, take over dates of versions that have none; {ingested, total}."""
        rows = self.pending().collect()  # a row for each file of the folder
        todo, now = [r for r in rows if r.action in ("new", "reingest")], datetime.now(UTC).isoformat().replace("+00:00", "Z")
        old = {r.id: r.asDict() for r in self.versions().collect()}
        for r in rows:
            if r.action == "adopt":
                old[r.id]["file_modified"] = r.modified
        if todo:
            old |= {v["id"]: v for v in self._ingest(todo, now)}
        names = [x.split()[0] for x in model.VERSIONS.split(", ")]
        index.save(self.spark.createDataFrame([tuple(v[n] for n in names) for v in old.values()], model.VERSIONS), self.params, f"{self.path}/index.json")
        return {"ingested": len(todo), "total": len(old)}

    def _ingest(self, files: list, now: str) -> list[dict]:
        spark, scratch = self.spark, f"{self.path}/scratch-{os.getpid()}-{time.time_ns()}"
        try:
            table = spark.createDataFrame([(r.id, r.path) for r in files], "id string, path string")
            archives = scan.payloads(table)
            d = Decomposed(archives, f"file://{scratch}", self.params, self.limits)
            digests = archives.select("version_id", F.sha2("payload", 256).alias("sha256"))
            if self.verify:
                bad = rebuild.verify(rebuild.rebuild_versions(d.nodes, d.refs, d.blocks), digests, ["version_id"]).filter("NOT verified").first()
                if bad:
                    raise ValueError(f"{bad.version_id} can't be rebuilt exactly")
            self.store.append(d.blocks)
            ids = [r.id for r in files]
            for name, rows in (("nodes", d.nodes), ("refs", d.refs)):
                rows.write.mode("append").parquet(f"file://{self.path}/{name}")
            stats = {r.version_id: r for r in tree.blueprint_stats(d.nodes, d.refs).collect()}
            events = {r.version_id: r for r in tree.container_counters(d.events).collect()}
            sha = {r.version_id: r.sha256 for r in digests.collect()}
            heads = spark.createDataFrame([(r.id, sha[r.id], r.length) for r in files], "version_id string, sha256 string, size long")
            written = {r.version_id: r for r in blueprint.write(heads, d.nodes, d.refs, self.params, self.limits, f"{self.path}/blueprints").collect()}
            out = []
            for r in files:
                bp, s, e = written[r.id], stats[r.id], events.get(r.id)
                out.append({
                    "id": r.id, "file_name": r.name, "size": r.length, "sha256": sha[r.id], "blueprint_sha256": bp.sha256, "blueprint_bytes": bp.bytes, "block_refs": s.chunk_refs,
                    "distinct_blocks": s.distinct_chunks, "containers": e.containers if e else 0, "opaque_containers": e.opaque_containers if e else 0, "ingested_at": now, "file_modified": r.modified,
                })
            assert {v["id"] for v in out} == set(ids)
            return out
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    def send(self, ask: DataFrame) -> DataFrame:
        """hash, length, payload for a request (seq, hash); a hash that isn't there fails the query."""
        return delta.fetch(ask, self.store.find(ask)).select("hash", "length", "payload")

    def rebuild(self, id_: str) -> bytes:
        """The archive, verified."""
        b = blueprint.from_bytes(self.blueprint(id_))
        return rebuild_blueprint(self.spark, b, self.store.blocks())


def _tables(spark: SparkSession, b: blueprint.Blueprint) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame([("v", p, len(p) - 1, k, f, m, s) for p, k, f, m, s in b.nodes], model.NODES)
    return nodes, spark.createDataFrame([("v", p, s, h, n) for p, s, h, n in b.refs], model.BLOCK_REFS)


def rebuild_blueprint(spark: SparkSession, b: blueprint.Blueprint, *sources: DataFrame) -> bytes:
    from .operators.store import composite

    nodes, refs = _tables(spark, b)
    data = bytes(rebuild.rebuild_versions(nodes, refs, composite(*sources, wanted=refs)).first().payload)
    if hashlib.sha256(data).digest() != b.archive_hash:
        raise ValueError("the rebuilt archive has another digest")
    return data


def open_full(server: VersionStore, id_: str) -> BinaryIO:
    """The archive as a stream: the file it came from where that is still the published one, else rebuilt and verified."""
    info = server.version(id_)
    path = os.path.join(server.archives, info.file_name)
    if os.path.exists(path):
        f = open(path, "rb")
        if hashlib.file_digest(f, "sha256").hexdigest() == info.sha256:
            f.seek(0)
            return f
        f.close()
    return io.BytesIO(server.rebuild(id_))


def fetch_full(server: VersionStore, id_: str) -> bytes:
    with open_full(server, id_) as f:
        return f.read()


def fetch_delta(server, base: bytes, id_: str, cache: str, mode: RepackMode = RepackMode.ORIGINAL, target: str | None = None, keep: bool = False) -> dict:
    """Move from `base` to a version of `server`, a VersionStore or a client.Remote: index the base by the publisher's own parameters (or find it indexed
    under its cache key), fetch what is missing, rebuild, hand the cache over to the new version's key. Returns metrics
    and, in the original shape, the archive."""
    spark, info, raw = server.spark, server.version(id_), server.blueprint(id_)
    if hashlib.sha256(raw).hexdigest() != info.blueprint_sha256:
        raise ValueError("the blueprint is not the published one")
    b, t0 = blueprint.from_bytes(raw), time.perf_counter_ns()

    def key(digest: bytes) -> str:
        return f"{digest.hex()[:24]}-{b.params.avg}-{b.params.max}-7z{b.limits.max_seven_z}"

    here = os.path.join(cache, key(hashlib.sha256(base).digest()))
    local = BlockStore(spark, f"file://{here}", b.params)
    if not local.count():
        local.append(Decomposed(spark.createDataFrame([("base", bytearray(base))], "version_id string, payload binary"), f"file://{here}/scratch", b.params, b.limits).blocks)
        shutil.rmtree(f"{here}/scratch", ignore_errors=True)
    t1 = time.perf_counter_ns()
    nodes, refs = _tables(spark, b)
    need = tree.in_blueprint_order(refs, ["path", "seq"])
    missing = delta.missing_blocks(need, local.blocks())
    ask = missing.select(F.col("first_pos").alias("seq"), "hash")
    got = server.send(ask)
    incoming = BlockStore(spark, f"file://{cache}/incoming-{id_}", b.params)
    try:
        if incoming.append(got) + incoming.count() < missing.count():
            raise ValueError("fewer blocks came than were asked for")
        m = delta.transfer_metrics(need, local.blocks(), info.size, info.blueprint_bytes).first().asDict()
        t2 = time.perf_counter_ns()
        sources = (local.blocks(), incoming.blocks())
        out = {"mode": mode.value}
        members = _members(spark, b, nodes, refs, sources) if mode is not RepackMode.ORIGINAL else None
        if members is None:  # asked for, or not possible otherwise
            out = {"mode": RepackMode.ORIGINAL.value, "archive": rebuild_blueprint(spark, b, *sources)}
        else:
            out |= repack.repack(members, mode, target)
        t3 = time.perf_counter_ns()
        new = os.path.join(cache, key(b.archive_hash))
        if out["mode"] == RepackMode.ORIGINAL.value and new != here and not os.path.exists(new):
            if keep:
                shutil.copytree(here, new)
            else:
                local.import_from(incoming.blocks())
                os.rename(here, new)
            if keep:
                BlockStore(spark, f"file://{new}", b.params).import_from(incoming.blocks())
    finally:
        shutil.rmtree(f"{cache}/incoming-{id_}", ignore_errors=True)
    return m | out | {"index_nanos": t1 - t0, "download_nanos": t2 - t1, "rebuild_nanos": t3 - t2}


def _members(spark, b, nodes, refs, sources) -> list[tuple[str, bytes]] | None:
    """(name, bytes) of the top container's members, nested archives whole; None where it can't be listed safely."""
    root = next(n for n in b.nodes if len(n[0]) == 1)
    if root[1] != "container":
        return None
    from .codecs import sevenz
    from .operators.store import composite

    lines = sevenz.listing(root[3]) if root[2] == model.ContainerFormat.SEVEN_Z else repack.listing(root[2], root[3])
    kids = [n for n in b.nodes if len(n[0]) == 2]
    names = [(scalars.sanitise_name(n), k) for n, _, k in lines]
    if not names or any(n is None or k >= len(kids) for n, k in names):
        return None
    below = nodes.filter("depth > 0").select(F.concat(F.lit("p"), F.col("path")[1].cast("string")).alias("version_id"), F.expr("slice(path, 2, size(path))").alias("path"), (F.col("depth") - 1).alias("depth"), "kind", "format", "meta", "size")
    parts = refs.filter("size(path) > 1").select(F.concat(F.lit("p"), F.col("path")[1].cast("string")).alias("version_id"), F.expr("slice(path, 2, size(path))").alias("path"), "seq", "hash", "length")
    made = {r.version_id: bytes(r.payload) for r in rebuild.rebuild_versions(below, parts, composite(*sources, wanted=parts)).toLocalIterator()}
    return [(n, made[f"p{k}"]) for n, k in names]
