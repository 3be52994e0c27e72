import hashlib
import json
import subprocess
import threading
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from blockloom import client, generator, service
from blockloom.model import ChunkParams, RepackMode
from blockloom.sources import wire
from blockloom.versions import VersionStore


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("published")
    (d / "in").mkdir()
    chain = [generator.archive(m) for m in generator.manifests(2, 900_000)]
    for k, data in enumerate(chain):
        (d / "in" / f"v0{k + 1}.zip").write_bytes(data)
    store = VersionStore(spark, str(d / "store"), str(d / "in"), ChunkParams.of(4096, 65536))
    store.rescan()
    server = service.serve(service.Service(store))
    yield chain, f"http://127.0.0.1:{server.server_address[1]}", store
    server.shutdown()


@pytest.mark.parametrize("compress", [True, False])
def test_full_and_delta_over_http(spark, published, tmp_path, compress):
    chain, url, _ = published
    full = client.Remote(spark, url, compress=compress)
    said = full.fetch_full("v01", str(tmp_path / "v01.zip"))
    assert (tmp_path / "v01.zip").read_bytes() == chain[0] and said["size"] == len(chain[0])
    assert compress or said["wire_bytes"] > len(chain[0])
    (tmp_path / "cache").mkdir()
    r = client.Remote(spark, url, str(tmp_path / "cache"), compress=compress)
    m = r.fetch(str(tmp_path / "v01.zip"), "v02", str(tmp_path / "v02.zip"))
    assert (tmp_path / "v02.zip").read_bytes() == chain[1] and 0 < m["blocks_missing"] < m["blocks_needed"]
    assert m["wire_bytes"] < len(chain[1]) and [x.name for x in (tmp_path / "cache").iterdir() if x.name.startswith("received")] == []
    again = client.Remote(spark, url, str(tmp_path / "cache")).fetch(str(tmp_path / "v02.zip"), "v02", str(tmp_path / "x"), RepackMode.EXTRACT)
    assert again["blocks_missing"] == 0 and again["mode"] == "extract" and (tmp_path / "x" / "manifest.txt").exists()


def test_full_is_rebuilt_when_its_file_is_gone(spark, published, tmp_path):
    chain, url, store = published
    moved, store.archives = store.archives, str(tmp_path)
    try:
        client.Remote(spark, url).fetch_full("v02", str(tmp_path / "out.zip"))
    finally:
        store.archives = moved
    assert (tmp_path / "out.zip").read_bytes() == chain[1]


def test_commands(published, tmp_path, capsys):
    chain, url, store = published
    assert service.main(["client", "list", "--server", url]) == 0 and json.loads(capsys.readouterr().out)["count"] == 2
    assert service.main(["client", "info", "--server", url, "--version", "v02"]) == 0 and json.loads(capsys.readouterr().out)["size"] == len(chain[1])
    assert service.main(["client", "config", "--server", url]) == 0 and json.loads(capsys.readouterr().out)["maxBlockSize"] == store.params.max
    out = str(tmp_path / "f.zip")
    assert service.main(["client", "fetch", "--server", url, "--version", "v01", "--out", out, "--no-compress"]) == 0
    capsys.readouterr()
    assert service.main(["client", "hash", "--file", out]) == 0 and capsys.readouterr().out.split()[0] == hashlib.sha256(chain[0]).hexdigest()
    assert service.main(["client", "nope"]) == 1


@pytest.mark.parametrize("how", ["cut", "no trailer", "wrong digest"])
def test_bad_streams_leave_nothing(tmp_path, how):
    block = b"x" * 1000
    raw = b"".join(wire.write_frames([(hashlib.sha256(block).digest(), block)], 4096))
    sent = {"cut": raw[:500], "no trailer": raw[:-17], "wrong digest": raw}[how]

    class H(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            for k, v in ((service.H_ARCHIVE, "00" * 32), (service.H_MAX, "4096")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(sent)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with pytest.raises(ValueError, match="digest" if how == "wrong digest" else "truncated"):
            client.Remote(None, f"http://127.0.0.1:{server.server_address[1]}").fetch_full("v", str(tmp_path / "out"))
    finally:
        server.shutdown()
    assert list(tmp_path.iterdir()) == []


def test_a_failure_in_a_stream_ends_it_without_its_end():
    class Broken:
        def answer(self, *args):
            def parts():
                yield b"first"
                raise OSError("gone")

            return 200, "x/y", {}, parts()

    server = service.serve(Broken())
    try:
        with pytest.raises(Exception, match="IncompleteRead"), urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/") as r:
            r.read()
    finally:
        server.shutdown()


def test_tls(tmp_path):
    cert, key = str(tmp_path / "c.pem"), str(tmp_path / "k.pem")
    made = subprocess.run(["openssl", "req", "-x509", "-newkey", "rsa:2048", "-nodes", "-days", "2", "-subj", "/CN=127.0.0.1", "-addext", "subjectAltName=IP:127.0.0.1", "-keyout", key, "-out", cert], capture_output=True)
    if made.returncode:
        pytest.skip("no openssl command here")

    class Config:
        def answer(self, *args):
            return 200, "application/json", {}, b'{"maxBlockSize": 1}'

    server = service.serve(Config(), tls=service.server_tls(cert, key, client_ca=cert))
    url = f"https://127.0.0.1:{server.server_address[1]}"
    try:
        assert client.Remote(None, url, tls=service.client_tls(cert, cert, key)).config() == {"maxBlockSize": 1}
        for tls in (service.client_tls(cert), service.client_tls()):  # no certificate of its own; a server it doesn't trust
            with pytest.raises(OSError):
                client.Remote(None, url, tls=tls).config()
    finally:
        server.shutdown()


def test_seven_z_in_the_generator(spark):
    files = generator.manifests(1, 700_000, seven_z=True)[0]
    assert sum(f.bucket == "SEVENZ" for f in files) >= 2 and not any(f.bucket == "SEVENZ" for f in generator.manifests(1, 700_000)[0])
    data = generator.archive(files, "7z", spark=spark)
    assert data[:6] == b"7z\xbc\xaf\x27\x1c" and generator.archive(files, "7z", spark=spark) == data
    with pytest.raises(ValueError):
        generator.archive(files)
