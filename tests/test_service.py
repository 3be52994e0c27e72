import hashlib
import json
import urllib.error
import urllib.request

import pytest

from blockloom import generator, service
from blockloom.model import ChunkParams
from blockloom.sources import blueprint, wire
from blockloom.versions import VersionStore


def get(url, data=None, **headers):
    with urllib.request.urlopen(urllib.request.Request(url, data, headers)) as r:
        return r.read(), dict(r.headers)


def test_ports_documents_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = generator.archive(generator.manifests(1, 400_000)[0])
    (tmp_path / "in" / "v01.zip").write_bytes(data)
    s = service.Service(VersionStore(spark, str(tmp_path / "store"), str(tmp_path / "in"), ChunkParams.of(4096, 65536)))
    public, admin = service.serve(s), service.serve(s, admin=True)
    a, b = (f"http://127.0.0.1:{x.server_address[1]}" for x in (public, admin))
    try:
        assert get(a + "/health")[0] == b"ok"
        for url, body, code in ((a + "/api/rescan", b"", 404), (a + "/", None, 404), (b + "/api/rescan", None, 405), (a + "/api/versions/nope", None, 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(url, body)
            assert e.value.code == code
        assert json.loads(get(b + "/api/rescan", b"")[0]) == {"ingested": 1, "total": 1}
        listed = json.loads(get(a + "/api/versions")[0])
        assert listed["count"] == 1 and listed["versions"][0]["sha256"] == hashlib.sha256(data).hexdigest() and "fileModified" not in listed["versions"][0]
        assert json.loads(get(a + "/api/versions/v01")[0])["sizeHuman"].endswith("KiB")
        assert set(json.loads(get(a + "/api/config")[0])) == {"hashAlgorithm", "maxBlockSize"} and len(json.loads(get(b + "/api/config")[0])) == 10
        raw, headers = get(a + "/api/versions/v01/blueprint")
        assert headers[service.H_BLUEPRINT] == hashlib.sha256(raw).hexdigest()
        hashes = [h for _, _, h, _ in blueprint.from_bytes(raw).refs][:5]
        body, headers = get(a + "/api/versions/v01/blocks", wire.write_hash_list([*hashes, hashes[0]]), **{"Accept-Encoding": "gzip"})
        assert headers["Content-Encoding"] == "gzip" and [h for h, _ in wire.read_frames(wire.gunzip(body), 65536)] == [*hashes, hashes[0]]
        with pytest.raises(urllib.error.HTTPError) as e:
            get(a + "/api/versions/v01/blocks", wire.write_hash_list([bytes(32)]))
        assert e.value.code == 500
        full, headers = get(a + "/api/versions/v01/full")
        assert b"".join(p for _, p in wire.read_frames(full, 65536)) == data and headers[service.H_SIZE] == str(len(data))
        assert b"v01" in get(b + "/")[0]
    finally:
        public.shutdown()
        admin.shutdown()


def test_options():
    assert service.options(["--Port", "80", "--x=1", "--flag"]) == {"port": "80", "x": "1", "flag": "true"}
    with pytest.raises(ValueError):
        service.options(["x"])


def test_generator_command(tmp_path):
    assert service.main(["gen", "--out", str(tmp_path), "--count", "1", "--start", "300k"]) == 0 and (tmp_path / "v01.zip").exists()
