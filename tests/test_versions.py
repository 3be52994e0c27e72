import hashlib

import pytest

from blockloom import generator
from blockloom.codecs import sevenz
from blockloom.functions.chunker import java_random_bytes
from blockloom.model import ChunkParams, DecomposeLimits, RepackMode
from blockloom.operators import rebuild
from blockloom.operators.decompose import Decomposed
from blockloom.versions import VersionStore, fetch_delta

PARAMS = ChunkParams.of(4096, 65536)


def test_chain_delta_restart_and_handover(spark, tmp_path):
    (tmp_path / "in").mkdir()
    chain = [generator.archive(m) for m in generator.manifests(2, 1_500_000)]
    for k, data in enumerate(chain):
        (tmp_path / "in" / f"v0{k + 1}.zip").write_bytes(data)
    s = VersionStore(spark, str(tmp_path / "store"), str(tmp_path / "in"), PARAMS)
    assert s.rescan() == {"ingested": 2, "total": 2} and s.rescan() == {"ingested": 0, "total": 2}
    v = s.version("v02")
    assert v.sha256 == hashlib.sha256(chain[1]).hexdigest() and v.containers >= 7 and s.version("nope") is None
    assert s.rebuild("v01") == chain[0]
    again = VersionStore(spark, str(tmp_path / "store"), str(tmp_path / "in"), PARAMS)
    assert [r.sha256 for r in again.versions().collect()] == [hashlib.sha256(x).hexdigest() for x in chain]
    with pytest.raises(ValueError):
        VersionStore(spark, str(tmp_path / "store"), str(tmp_path / "in"), ChunkParams.of(8192, 65536))
    m = fetch_delta(s, chain[0], "v02", str(tmp_path / "cache"))
    assert m["archive"] == chain[1] and m["saved_fraction"] > 0.5 and m["blocks_reused"] > 0
    z = fetch_delta(s, chain[1], "v02", str(tmp_path / "cache"), RepackMode.ZIP, str(tmp_path / "out.zip"))
    assert z["blocks_missing"] == 0 and z["mode"] == "zip" and z["entries"] > 5
    (tmp_path / "in" / "v01.zip").write_bytes(chain[1])
    assert {r.id: r.action for r in s.pending().collect()} == {"v01": "reingest", "v02": "skip"}


def test_seven_z_opens_exactly_or_stays_closed(spark, tmp_path):
    entries = [{"name": f"m{i}.bin", "data": java_random_bytes(i + 1, 3000) + bytes(5000), "stream": True} for i in range(3)]
    path = str(tmp_path / "x.7z")
    sevenz.write(spark, entries, "LZMA2", path)
    data = open(path, "rb").read()
    meta, parts = sevenz.decompose(spark, data)
    assert parts == [x["data"] for x in entries] and sevenz.rebuild(spark, meta, parts) == data
    assert [n for n, *_ in sevenz.listing(meta)] == ["m0.bin", "m1.bin", "m2.bin"]
    assert sevenz.decompose(spark, data, DecomposeLimits(len(data))) and sevenz.decompose(spark, data, DecomposeLimits(len(data) - 1)) is None
    assert sevenz.decompose(spark, data[:40] + bytes(60)) is None
    rows = spark.createDataFrame([("seven", bytearray(data)), ("zip", bytearray(generator.pack_zip([("in.7z", data), ("t", b"text" * 99)])))], "version_id string, payload binary")
    d = Decomposed(rows, str(tmp_path / "scratch"), ChunkParams(64, 256, 1024))
    assert d.nodes.filter("format = 2").count() == 2
    made = {r.version_id: hashlib.sha256(bytes(r.payload)).hexdigest() for r in rebuild.rebuild_versions(d.nodes, d.refs, d.blocks).collect()}
    assert made == {r.version_id: hashlib.sha256(bytes(r.payload)).hexdigest() for r in rows.collect()}


def test_generator_is_deterministic():
    a, b = (generator.manifests(3, 1_000_000) for _ in range(2))
    assert a == b and generator.content(a[0][0]) == generator.content(b[0][0])
    f = a[0][0]
    one, two = generator.content(f), generator.content(generator.replace(f, revision=1))
    assert len(one) == len(two) == f.size
