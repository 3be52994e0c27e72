"""A thin HTTP shell around a version store: two ports, JSON documents, block streams. Operators do the work."""

from __future__ import annotations

import hashlib
import html
import json
import ssl
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import chunker
from .functions.scalars import parse_size
from .operators import delta
from .sources import index, wire
from .versions import VersionStore, open_full

#: Fixed values of the interface: media types and header names.
BLOCKS, BLUEPRINT = "application/x-jdt-blocks", "application/x-jdt-blueprint"
H_ARCHIVE, H_BLUEPRINT, H_SIZE, H_MAX = "X-JDT-Archive-SHA256", "X-JDT-Blueprint-SHA256", "X-JDT-Archive-Size", "X-JDT-Max-Block-Size"


def _camel(row: dict) -> dict:
    names = dict(index.FIELDS) | {"size_human": "sizeHuman", "hash_algorithm": "hashAlgorithm"}
    return {names[k]: v for k, v in row.items()}


class Service:
    """Answers (status, type, headers, body) for a request; `admin` tells which port it came in by."""

    def __init__(self, store: VersionStore, compress: int = 1) -> None:
        self.store, self.compress = store, compress

    def answer(self, method: str, path: str, body: bytes = b"", accept: str | None = None, admin: bool = False):
        parts = [p for p in path.split("?")[0].split("/") if p]
        if parts == ["health"]:
            return self._text(200, "ok")
        if admin and not parts:
            return 200, "text/html; charset=utf-8", {}, self._page()
        if parts == ["api", "config"]:
            return self._json(self._admin_config() if admin else self._client_config())
        if admin and parts == ["api", "rescan"]:
            return self._json(self.store.rescan()) if method == "POST" else self._text(405, "use POST")
        if parts[:2] != ["api", "versions"] or len(parts) > 4:
            return self._text(404, "not found")
        if len(parts) == 2:
            rows = [_camel(r.asDict()) for r in index.api_view(self.store.versions()).collect()]
            return self._json({"hashAlgorithm": model.HASH_ALGORITHM, "count": len(rows), "versions": rows})
        info = self.store.version(parts[2])
        if info is None:
            return self._text(404, f"unknown version: {parts[2]}")
        if len(parts) == 3:
            return self._json(_camel(index.api_view(self.store.versions().filter(F.col("id") == parts[2])).first().asDict()))
        headers = {H_ARCHIVE: info.sha256}
        if parts[3] == "blueprint":
            return 200, BLUEPRINT, headers | {H_BLUEPRINT: info.blueprint_sha256}, self.store.blueprint(info.id)
        if parts[3] == "blocks":
            return self._stream(self._blocks(body), accept, headers) if method == "POST" else self._text(405, "use POST")
        if parts[3] == "full":
            return self._stream(self._full(info), accept, headers | {H_SIZE: str(info.size), H_MAX: str(self.store.params.max)})
        return self._text(404, "not found")

    def _blocks(self, body: bytes) -> Iterator[bytes]:
        """Blocks in the order asked for, one partition at a time; where one isn't there the answer is an error before anything is sent."""
        spark, hashes = self.store.spark, wire.read_hash_list(body)
        ask = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(hashes)], "seq int, hash binary")
        if self.store.store.contains(ask.select("hash").distinct()).count() < len(set(hashes)):
            raise ValueError("a block that the store doesn't have")
        rows = delta.fetch(ask, self.store.store.find(ask)).orderBy("seq").toLocalIterator()
        return wire.write_frames(((bytes(r.hash), bytes(r.payload)) for r in rows), self.store.params.max)

    def _full(self, info) -> Iterator[bytes]:
        """The archive's bytes, cut as they are read: of its file they are never held whole."""

        def blocks() -> Iterator[tuple[bytes, bytes]]:
            cutter = chunker.PushChunker(self.store.params)
            with open_full(self.store, info.id) as f:
                while data := f.read(1 << 20):
                    yield from ((hashlib.sha256(b).digest(), b) for b in cutter.feed(data))
            yield from ((hashlib.sha256(b).digest(), b) for b in cutter.close())

        return wire.write_frames(blocks(), self.store.params.max)

    def _stream(self, parts: Iterator[bytes], accept: str | None, headers: dict):
        if self.compress and accept and "gzip" in accept.lower():
            return 200, BLOCKS, headers | {"Content-Encoding": "gzip"}, wire.gzip_stream(parts, self.compress)
        return 200, BLOCKS, headers, parts

    def _client_config(self) -> dict:
        return {"hashAlgorithm": model.HASH_ALGORITHM, "maxBlockSize": self.store.params.max}

    def _admin_config(self) -> dict:
        s, p = self.store.store.stats().first(), self.store.params
        return self._client_config() | {"chunkMin": p.min, "chunkAvg": p.avg, "chunkMax": p.max, "storedBlocks": s.chunk_count, "storedBytes": s.stored_bytes, "maxSevenZBytes": self.store.limits.max_seven_z, "compress": bool(self.compress), "compressLevel": self.compress}

    def _page(self) -> bytes:
        """The administrator's page: what the store holds and a line for each version; every value is escaped."""
        names = [c for c, _ in index.FIELDS if c != "file_modified"] + ["size_human"]
        rows = index.api_view(self.store.versions()).collect()
        lines = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}" for c in names) for r in rows)
        config = "".join(f"<tr><th>{html.escape(k)}<td>{html.escape(str(v))}" for k, v in self._admin_config().items())
        head = "".join(f"<th>{c.replace('_', ' ')}" for c in names)
        return f"<!doctype html><title>versions</title><table>{config}</table><table><tr>{head}{lines}</table>".encode()

    @staticmethod
    def _json(x) -> tuple:
        return 200, "application/json", {}, json.dumps(x).encode()

    @staticmethod
    def _text(status: int, text: str) -> tuple:
        return status, "text/plain; charset=utf-8", {}, text.encode()


def serve(service: Service, host: str = "127.0.0.1", port: int = 0, admin: bool = False, tls: ssl.SSLContext | None = None) -> ThreadingHTTPServer:
    """Start a port in a thread; the server's shutdown() ends it."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _do(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, kind, headers, data = service.answer(method, self.path, body, self.headers.get("Accept-Encoding"), admin)
                first = b"" if isinstance(data, bytes) else next(data, b"")
            except Exception as e:  # the boundary of a request: the client gets a 500, the server lives on
                status, kind, headers, data = 500, "text/plain; charset=utf-8", {}, f"error: {type(e).__name__}".encode()
            whole = isinstance(data, bytes)
            self.send_response(status)
            length = {"Content-Length": str(len(data))} if whole else {"Transfer-Encoding": "chunked"}
            for k, v in ({"Content-Type": kind} | length | headers).items():
                self.send_header(k, v)
            self.end_headers()
            if whole:
                self.wfile.write(data)
                return
            try:
                for part in chain([first], data):
                    if part:
                        self.wfile.write(f"{len(part):x}\r\n".encode() + part + b"\r\n")
                self.wfile.write(b"0\r\n\r\n")
            except Exception:  # the status is sent: the stream stays without its end, which the client sees
                self.close_connection = True

        def do_GET(self) -> None:
            self._do("GET")

        def do_POST(self) -> None:
            self._do("POST")

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    if tls:
        server.socket = tls.wrap_socket(server.socket, server_side=True)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def server_tls(cert: str, key: str, client_ca: str | None = None) -> ssl.SSLContext:
    """TLS 1.2 or later; with client_ca clients must show a certificate of it."""
    c = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
    c.minimum_version = ssl.TLSVersion.TLSv1_2
    c.load_cert_chain(cert, key)
    if client_ca:
        c.load_verify_locations(client_ca)
        c.verify_mode = ssl.CERT_REQUIRED
    return c


def client_tls(ca: str | None = None, cert: str | None = None, key: str | None = None) -> ssl.SSLContext:
    c = ssl.create_default_context(cafile=ca)
    c.minimum_version = ssl.TLSVersion.TLSv1_2
    if cert:
        c.load_cert_chain(cert, key)
    return c


def options(argv: list[str]) -> dict[str, str]:
    """--name value, --name=value, or a flag, which is "true"; names don't mind case."""
    out, i = {}, 0
    while i < len(argv):
        if not argv[i].startswith("--"):
            raise ValueError(f"not an option: {argv[i]}")
        name, eq, value = argv[i][2:].partition("=")
        if not eq:
            value = "true"
            if i + 1 < len(argv) and not argv[i + 1].startswith("--"):
                i += 1
                value = argv[i]
        out[name.lower()] = value
        i += 1
    return out


def main(argv: list[str]) -> int:
    """server --store DIR --archives DIR [--port N --admin-port N --avg SIZE --max SIZE --cert FILE --key FILE --client-ca FILE],
    gen --out DIR --count N --start SIZE [--outer zip|cab|7z --seven-z], client list|info|config|fetch|hash (see blockloom.client)."""
    command = argv[0] if argv else ""
    o = options(argv[1:]) if command != "client" else {}
    if command == "gen":
        from . import generator

        outer = o.get("outer", "zip")
        spark = SparkSession.builder.getOrCreate() if outer == "7z" or "seven-z" in o else None
        for k, files in enumerate(generator.manifests(int(o.get("count", "3")), parse_size(o.get("start", "12MB")), seven_z="seven-z" in o)):
            with open(f"{o['out']}/v{k + 1:02d}.{outer}", "wb") as f:
                f.write(generator.archive(files, outer, spark=spark))
        return 0
    if command == "client":
        from . import client

        return client.main(argv[1:])
    if command == "server":
        params = model.ChunkParams.of(parse_size(o.get("avg", "64k")), parse_size(o.get("max", "4m")))
        store = VersionStore(SparkSession.builder.getOrCreate(), o["store"], o["archives"], params, force="force-reindex" in o)
        print(store.rescan())
        service = Service(store, int(o.get("level", "1")))
        tls = server_tls(o["cert"], o["key"], o.get("client-ca")) if "cert" in o else None
        serve(service, port=int(o.get("port", "8080")), tls=tls)
        serve(service, port=int(o.get("admin-port", "8081")), admin=True, tls=tls)
        threading.Event().wait()
    print(main.__doc__)
    return 1


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
