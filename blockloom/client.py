"""A client over HTTP: the documents of a server, whole archives, and moving from a base archive to a version.

    client list | info --version ID | config | hash --file FILE
    client fetch --version ID --out FILE [--base FILE --cache DIR --rebuild-as original|zip|extract --keep-base-cache]
    all but hash: [--server URL --no-compress --ca FILE --cert FILE --key FILE]
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import ssl
import urllib.request
import uuid
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import service
from .model import BLOCKS, RepackMode
from .sources import wire
from .versions import fetch_delta

#: Hashes of one request, and bytes of blocks that are held before they are written.
REQUEST, HELD = 100_000, 32 << 20
ROWS = pa.schema([("hash", pa.binary()), ("length", pa.int32()), ("payload", pa.binary())])


class Remote:
    """A publisher behind a URL: what fetch_delta asks of one (version, blueprint, send). Blocks that come are written to
    `cache`, a folder that driver and executors share. wire_bytes counts blocks as they came, before they are unpacked."""

    def __init__(self, spark: SparkSession | None, url: str, cache: str = "", tls: ssl.SSLContext | None = None, compress: bool = True, timeout: float = 600) -> None:
        self.spark, self.url, self.cache, self.tls, self.timeout, self.wire_bytes = spark, url.rstrip("/"), cache, tls, timeout, 0
        self.received: list[str] = []
        self.headers = {"Accept-Encoding": "gzip"} if compress else {}

    def _open(self, path: str, body: bytes | None = None):
        return urllib.request.urlopen(urllib.request.Request(self.url + path, body, self.headers), timeout=self.timeout, context=self.tls)

    def _json(self, path: str) -> dict:
        with self._open(path) as r:
            return json.load(r)

    def versions(self) -> dict:
        return self._json("/api/versions")

    def info(self, id_: str) -> dict:
        return self._json(f"/api/versions/{id_}")

    def config(self) -> dict:
        return self._json("/api/config")

    def version(self, id_: str) -> SimpleNamespace:
        v = self.info(id_)
        return SimpleNamespace(id=id_, sha256=v["sha256"], size=v["size"], blueprint_sha256=v["blueprintSha256"], blueprint_bytes=v["blueprintBytes"])

    def blueprint(self, id_: str) -> bytes:
        with self._open(f"/api/versions/{id_}/blueprint") as r:
            raw = r.read()
            if hashlib.sha256(raw).hexdigest() != r.headers[service.H_BLUEPRINT]:
                raise ValueError("the blueprint is not the one that its header names")
        self._id = id_
        return raw

    def _frames(self, response) -> Iterator[tuple[bytes, bytes]]:
        counted = wire.Counting(response)
        try:
            yield from wire.frames(wire.plain(counted, response.headers["Content-Encoding"]), int(response.headers[service.H_MAX] or self.config()["maxBlockSize"]))
        finally:
            self.wire_bytes += counted.count

    def send(self, ask: DataFrame) -> DataFrame:
        """hash, length, payload for a request (seq, hash). The hashes are the blueprint's, which is in memory already; blocks
        are written as they come, at most HELD bytes and one block at a time are in memory."""
        hashes = [bytes(r.hash) for r in ask.orderBy("seq").select("hash").toLocalIterator()]
        folder = os.path.join(self.cache, f"received-{uuid.uuid4().hex}")
        os.makedirs(folder)
        self.received.append(folder)
        for i in range(0, len(hashes), REQUEST):
            part = hashes[i : i + REQUEST]
            with self._open(f"/api/versions/{self._id}/blocks", wire.write_hash_list(part)) as r:
                got = self._write(self._frames(r), f"{folder}/{i:012d}.parquet")
            if got != part:
                raise ValueError("other blocks came than were asked for")
        if not hashes:
            return self.spark.createDataFrame([], BLOCKS)
        return self.spark.read.schema(BLOCKS).parquet(f"file://{folder}")

    @staticmethod
    def _write(frames: Iterator[tuple[bytes, bytes]], path: str) -> list[bytes]:
        seen, held, size = [], [], 0

        def flush() -> None:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ROWS)], schema=ROWS))

        with pq.ParquetWriter(path, ROWS, compression="zstd") as out:
            for h, payload in frames:
                seen.append(h)
                held.append((h, len(payload), payload))
                size += len(payload)
                if size >= HELD:
                    flush()
                    held, size = [], 0
            if held:
                flush()
        return seen

    def forget(self) -> None:
        """Delete the blocks that came; the tables that send() gave are gone with them."""
        while self.received:
            shutil.rmtree(self.received.pop())

    def fetch_full(self, id_: str, out: str) -> dict:
        """Write a whole archive; it appears under its name only when its digest is the published one."""
        digest, size = hashlib.sha256(), 0
        try:
            with self._open(f"/api/versions/{id_}/full") as r, open(out + ".part", "wb") as f:
                want = r.headers[service.H_ARCHIVE]
                for _, payload in self._frames(r):
                    f.write(payload)
                    digest.update(payload)
                    size += len(payload)
            if digest.hexdigest() != want:
                raise ValueError("the archive has another digest")
            os.replace(out + ".part", out)
        finally:
            if os.path.exists(out + ".part"):
                os.remove(out + ".part")
        return {"size": size, "wire_bytes": self.wire_bytes}

    def fetch(self, base: str, id_: str, out: str, mode: RepackMode = RepackMode.ORIGINAL, keep: bool = False) -> dict:
        """Move from a base archive to a version; returns metrics, `wire_bytes` as counted."""
        with open(base, "rb") as f:
            data = f.read()
        try:
            m = fetch_delta(self, data, id_, self.cache, mode, None if mode is RepackMode.ORIGINAL else out, keep)
        finally:
            self.forget()
        if archive := m.pop("archive", None):
            with open(out + ".part", "wb") as f:
                f.write(archive)
            os.replace(out + ".part", out)
        return m | {"wire_bytes": self.wire_bytes + m["transferred_bytes"] - m["block_bytes"]}


def main(argv: list[str]) -> int:
    command, o = argv[0] if argv else "", service.options(argv[1:])
    if command == "hash":
        with open(o["file"], "rb") as f:
            print(hashlib.file_digest(f, "sha256").hexdigest(), o["file"], sep="  ")
        return 0
    if command not in ("list", "info", "config", "fetch"):
        print(__doc__)
        return 1
    url = o.get("server", "http://localhost:8080")
    cache = os.path.abspath(o.get("cache", "client-cache"))
    remote = Remote(None, url, cache, service.client_tls(o.get("ca"), o.get("cert"), o.get("key")) if url.startswith("https:") else None, "no-compress" not in o)
    if command == "fetch" and "base" in o:
        os.makedirs(cache, exist_ok=True)
        remote.spark = SparkSession.builder.getOrCreate()
        said = remote.fetch(o["base"], o["version"], o["out"], RepackMode(o.get("rebuild-as", "original")), "keep-base-cache" in o)
    else:
        said = {"list": remote.versions, "config": remote.config, "info": lambda: remote.info(o["version"]), "fetch": lambda: remote.fetch_full(o["version"], o["out"])}[command]()
    print(json.dumps(said, indent=2, default=str))
    return 0
